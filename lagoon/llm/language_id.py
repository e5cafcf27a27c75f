"""Operator 7: language identification by family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.storage import materialize

#: Language families; a language not listed is a family of its own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}

#: Hashed byte n-grams: this many features for n-grams of 1 to 3 bytes.
DIMENSIONS = 1 << 13

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[*range(0x21), *range(0x30, 0x3A)]] = 32


def features(texts: list[bytes]) -> np.ndarray:
    """Unit-length rows of square-rooted byte n-gram counts of whole texts (A-Z lower-cased, digits and controls as blanks)."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for row, text in zip(out, texts):
        b = _LOWER[np.frombuffer(b" " + text + b" ", dtype=np.uint8)].astype(np.uint32)
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * np.uint32(65_599) + b[2:]
        counts = np.bincount(b, minlength=DIMENSIONS).astype(np.float32)
        counts += np.bincount((two * np.uint32(2_654_435_761)) >> np.uint32(19), minlength=DIMENSIONS)
        counts += np.bincount((three * np.uint32(2_246_822_519)) >> np.uint32(19), minlength=DIMENSIONS)
        counts[32] = 0
        np.sqrt(counts, out=row)
        row /= np.maximum(np.sqrt((row * row).sum()), np.float32(1e-12))
    return out


def _svm(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, penalty: float = 1e-4) -> np.ndarray:
    """Linear SVM weights (the last one the bias) by averaged Pegasos steps on small batches; y is -1 or 1."""
    x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32)))
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1], dtype=np.float32)
    total, steps = np.zeros(x.shape[1], dtype=np.float64), 0
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1 / (penalty * (step + 1_000))
            wrong = at[(x[at] @ w) * y[at] < 1]
            w *= 1 - rate * penalty
            if len(wrong):
                w += (rate / len(at)) * ((y[wrong] * balance[wrong]) @ x[wrong])
            if epoch >= epochs // 2:
                total += w
                steps += 1
    return (total / max(1, steps)).astype(np.float32)


@dataclass
class Model:
    """Family classifiers one against the rest, and for each family its pairs of languages."""

    families: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)
    scale: float = 4.0

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's probability times the language's share of pairwise votes."""
        x = features(texts)
        x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32)))
        names = list(self.families)
        margin = self.scale * (x @ self.family_weights.T)
        chance = 1 / (1 + np.exp(-margin))
        best = margin.argmax(axis=1)
        sure = chance[np.arange(len(x)), best]
        langs = np.empty(len(x), dtype=object)
        score = np.empty(len(x))
        for k, name in enumerate(names):
            at = np.flatnonzero(best == k)
            if not len(at):
                continue
            members = self.families[name]
            votes, belief = np.zeros((len(at), len(members))), np.ones((len(at), len(members)))
            for i, j, w in self.pairs.get(name, []):
                p = 1 / (1 + np.exp(-self.scale * (x[at] @ w)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                belief[:, i] = np.minimum(belief[:, i], p)
                belief[:, j] = np.minimum(belief[:, j], 1 - p)
            pick = (votes + 0.5 * belief).argmax(axis=1)
            langs[at] = [members[i] for i in pick]
            score[at] = sure[at] * belief[np.arange(len(at)), pick]
        return langs.tolist(), np.clip(score, 0.0, 1.0)


def train(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, seed: int = 42) -> Model | None:
    """A model from labelled rows of features; None without any."""
    if not langs:
        return None
    y = np.array(langs, dtype=object)
    home = {lang: name for name, members in families.items() for lang in members}
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        groups.setdefault(home.get(lang, f"only-{lang}"), []).append(lang)
    names = np.array([home.get(lang, f"only-{lang}") for lang in langs], dtype=object)
    weights = [_svm(x, np.where(names == g, 1, -1).astype(np.float32), seed) if len(groups) > 1 else np.eye(1, x.shape[1] + 1, x.shape[1], dtype=np.float32)[0] for g in groups]
    model = Model(groups, np.stack(weights))
    for g, members in groups.items():
        model.pairs[g] = []
        for (i, a), (j, b) in combinations(enumerate(members), 2):
            at = np.flatnonzero((y == a) | (y == b))
            model.pairs[g].append((i, j, _svm(x[at], np.where(y[at] == a, 1, -1).astype(np.float32), seed)))
    return model


def training_rows(docs: DataFrame, per_language: int, most: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The labelled rows of each language with the least seeded hashes: ``per_language`` of them, fewer where languages are so many that ``most`` rows would be passed.

    Rows repeated whole count once. A threshold twice as high as needed is passed by about twice as many rows as wanted, whatever
    the size of the table; only those are ranked.
    """
    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    hashed = labelled.select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.lit(42), F.col(id_col), text_col).alias("h"), F.col(text_col).cast("binary").alias("text")
    )
    counts = materialize(hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    wanted = max(1, min(per_language, most // max(1, counts.count())))
    share = (2.0 * wanted + 100) / F.greatest(F.col("n"), F.lit(1))
    few = hashed.join(counts, "lang").filter(F.col("h") / 2.0**64 + 0.5 < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return few.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("__n", rank).filter(F.col("__n") <= wanted).select("lang", "text")


def _collect_features(rows: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Features of whole texts, made on the executors; only the entries that aren't zero are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                packed = []
                for row in features(part.column(1).to_pylist()):
                    where = np.flatnonzero(row)
                    packed.append(where.astype(np.uint16).tobytes() + row[where].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["lang", "packed"])

    found = rows.mapInArrow(run, "lang string, packed binary").toPandas().sort_values(["lang", "packed"])
    x = np.zeros((len(found), DIMENSIONS), dtype=np.float32)
    for row, packed in zip(x, found["packed"]):
        n = len(packed) // 6
        row[np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed, np.float32, n, 2 * n)
    return x, found["lang"].tolist()


def identify(
    docs: DataFrame,
    holdout: int = 5,
    per_language: int = 600,
    most: int = 12_000,
    families: dict[str, tuple[str, ...]] = FAMILIES,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    names: tuple[str, str, str] = ("held_out", "lang_pred", "score"),
) -> DataFrame:
    """``docs`` with three columns more, ``held_out, lang_pred, score`` if not named otherwise: the language of every whole text.

    The model learns from rows with text and language whose crc32 of the id as text leaves a
    remainder other than 0 by ``holdout``; it is fitted on a sample of at most ``per_language`` of them
    in each language and ``most`` in all (the documented bounds), those of the least seeded hashes, whole texts each. Predictions use the text alone, whole. A null text, one without letters, and every text
    when there is nothing to learn from give ``und`` with score 0. A null id is never held out.
    Columns named like the new ones are replaced.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % holdout == 0, F.lit(False))
    sample = training_rows(docs.filter(~held), per_language, most, id_col, text_col, lang_col)
    model = train(*_collect_features(sample), families, seed)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def told(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        for texts in columns:
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts) if fitted else 0, 256):
                some = [(i, x) for i, x in enumerate(texts.slice(start, 256).to_pylist(), start) if x is not None]
                if not some:
                    continue
                got, score = fitted.predict([x for _, x in some])
                for (i, _), lang in zip(some, got):
                    langs[i] = lang
                scores[[i for i, _ in some]] = score
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])

    kept = docs.select(*[c for c in docs.columns if c not in names], held.alias(names[0]))
    # the text alone goes to Python, and its language alone comes back; a filter of the language must not run it twice
    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary"))
    return kept.withColumn("__told", told.asNondeterministic()(lettered)).select(
        *kept.columns, F.col("__told.lang").alias(names[1]), F.col("__told.score").alias(names[2])
    )
