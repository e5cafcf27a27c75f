"""Operator 2: perplexity under an interpolated modified Kneser-Ney model of trusted text, cut by language's quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.heads import frequent
from lagoon.storage import materialize

#: Grams are runs of this many bytes, packed into a long; a text is framed by order - 1 starts and one end.
ORDER = 5
_START, _END = 2, 3
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:33] = 32
_CLASS[65:91] += 32
_CLASS[48:58] = 48


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all texts, and how many each text has: one for each byte that is left and one for the end.

    A-Z are lower-cased, digits are one class, runs of blanks and controls are one blank.
    """
    frame, tail = bytes([_START]) * (ORDER - 1), bytes([_END])
    raw = np.frombuffer(b"".join(x for t in texts for x in (frame, t, tail)), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1]))
    out = _CLASS[raw]
    edges = (first[:, None] + np.arange(ORDER - 1)).ravel()
    ends = first + sizes + ORDER - 1
    out[edges] = _START
    out[ends] = _END
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    counted = keep.copy()
    counted[edges] = False
    n = np.add.reduceat(counted, first, dtype=np.int64) if len(texts) else np.empty(0, np.int64)
    out, counted = out[keep].astype(np.int64), counted[keep]
    code = out.copy()
    for k in range(1, ORDER):
        code[k:] |= out[:-k] << (8 * k)
    return code[counted], n


def _small(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of the batch's texts of about ``limit`` bytes together, with the first one's row."""
    texts, at, size = batch.column(column).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def count_grams(docs: DataFrame, text_col: str, trusted: Column) -> DataFrame:
    """``g, n, t``: every gram of all texts, how often it stands in all and in trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), dtype=bool)
            for at, texts in _small(batch, 0, 4 << 20):
                code, n = grams_of(texts)
                mine = np.repeat(good[at : at + len(texts)], n)
                g, c = np.unique(code, return_counts=True)
                tg, tc = np.unique(code[mine], return_counts=True)
                t = np.zeros(len(g), dtype=np.int64)
                t[np.searchsorted(g, tg)] = tc
                keys.append(g)
                held.append(np.stack((c, t)))
                size += len(g)
                if size > 3_000_000:
                    keys, held = _merged(keys, held)
                    size = len(keys[0])
                    if size > 2_000_000:
                        yield _gram_batch(keys[0], held[0])
                        keys, held, size = [], [], 0
        if keys:
            keys, held = _merged(keys, held)
            yield _gram_batch(keys[0], held[0])

    made = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), trusted).mapInArrow(run, "g long, n long, t long")
    return materialize(made.groupBy("g").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))


def _merged(keys: list[np.ndarray], held: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, value = np.concatenate(keys), np.concatenate(held, axis=1)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[:, order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return [key[first]], [np.add.reduceat(value, first, axis=1)]


def _gram_batch(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(value[0]), pa.array(value[1])], names=["g", "n", "t"])


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from how many grams have counts 1 to 4."""
    r = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [r[f"n{k}"] for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return [0.5, 0.75, 0.9]  # too few grams for the estimate
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def gram_probabilities(grams: DataFrame) -> DataFrame:
    """``g, n, logp``: log10 of the interpolated probability of each gram's last byte after its others.

    Each order joins the next lower one: counts of grams, counts of their contexts and the shorter
    gram's probability are tables keyed alike, dealt by hash over all tasks. The highest order counts
    occurrences in trusted text, lower ones count different grams that end so, but for grams that begin with the frame:
    nothing else stands before those, so their occurrences count.
    """
    counts = {ORDER: grams.filter("t > 0").select("g", F.col("t").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << (8 * k)) - 1
        gram = F.col("g").bitwiseAND(F.lit(mask))
        framed = F.shiftright(gram, 8 * (k - 1)) == _START
        ends = counts[k + 1].groupBy(gram.alias("g"), framed.alias("framed")).agg(F.count("*").alias("n"), F.sum("c").alias("c"))
        counts[k] = ends.select("g", F.when(F.col("framed"), F.col("c")).otherwise(F.col("n")).alias("c"))
    counts = {k: materialize(v) for k, v in counts.items()}
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[k])
        c = F.coalesce(F.col("c"), F.lit(0))
        off = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = (
            counts[k]
            .groupBy(F.shiftright("g", 8).alias("h"))
            .agg(
                F.sum("c").alias("s"),
                (d1 * F.count_if(F.col("c") == 1) + d2 * F.count_if(F.col("c") == 2) + d3 * F.count_if(F.col("c") > 2)).alias("left"),
            )
        )
        mask = (1 << (8 * k)) - 1
        asked = grams.select(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).distinct()
        joined = asked.join(counts[k], "g", "left").join(context, F.shiftright("g", 8) == F.col("h"), "left")
        if lower is None:
            joined = joined.withColumn("p0", F.lit(1 / 256))
        else:
            joined = joined.join(lower.withColumnRenamed("g", "l"), F.col("g").bitwiseAND(F.lit(mask >> 8)) == F.col("l"))
        p = F.when(F.col("s").isNull(), F.col("p0")).otherwise((c - off) / F.col("s") + F.col("left") / F.col("s") * F.col("p0"))
        lower = materialize(joined.select("g", p.alias("p0")))
    return materialize(grams.join(lower, "g").select("g", "n", F.log10("p0").alias("logp")))


class _Lookup:
    """Grams to log probabilities: four small open tables, each for what found its place taken in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 2).bit_length())
        self.tables = []
        for level in range(4):
            slots = np.full(1 << self.bits, -1, dtype=np.int64)
            logs = np.zeros(1 << self.bits, dtype=np.float32)
            at = self._slot(keys, level)
            slots[at] = keys
            here = slots[at] == keys
            logs[at[here]] = values[here]
            self.tables.append((slots, logs))
            keys, values = keys[~here], values[~here]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        odd = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)[level]
        return ((keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which keys are absent."""
        slots, logs = self.tables[0]
        at = self._slot(keys, 0)
        value, miss = logs[at].astype(np.float64), slots[at] != keys
        value[miss] = 0
        left = np.flatnonzero(miss)
        for level in range(1, 4):
            if not len(left):
                break
            slots, logs = self.tables[level]
            at = self._slot(keys[left], level)
            hit = slots[at] == keys[left]
            value[left[hit]] = logs[at[hit]]
            left = left[~hit]
        absent = np.zeros(len(keys), dtype=bool)
        absent[left] = True
        return value, absent


def perplexities(docs: DataFrame, model: DataFrame, text_col: str = "text", head: int = 1 << 20) -> DataFrame:
    """``docs`` without its text, with ``n_tokens, log10_prob, perplexity`` (per byte) of each whole text.

    The ``head`` most frequent grams are broadcast (12 bytes each); all others of a text go to a
    shuffle join with the model, so every gram of every text counts.
    """
    spark = docs.sparkSession
    top = frequent(model, "n", head).select("g", "logp").toArrow()
    shared = spark.sparkContext.broadcast((top["g"].to_numpy(), top["logp"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Lookup(*shared.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            last = batch.num_columns - 1
            rows, tokens, near, far, times = [], [], [], [], []
            for _, texts in _small(batch, last):
                code, n = grams_of(texts)
                value, absent = find(code)
                start = np.concatenate(([0], np.cumsum(n)[:-1]))
                near.append(np.add.reduceat(value, start))
                tokens.append(n)
                owner = np.repeat(np.arange(len(texts)), n)[absent]
                mine = code[absent]
                edge = np.searchsorted(owner, np.arange(len(texts) + 1))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    g, c = np.unique(mine[a:b], return_counts=True) if b > a else (mine[:0], mine[:0])
                    far.append(g)
                    times.append(c)
                rows += range(row + 1, row + 1 + len(texts))
                row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(last)), pa.array(rows, pa.int64()), pa.array(np.concatenate(tokens or [[]]), pa.int64()), pa.array(np.concatenate(near or [[]]), pa.float64()), pa.array(far, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:last], "__row", "n_tokens", "__near", "__far", "__times"],
            )

    kept = docs.drop(text_col, "n_tokens", "log10_prob", "perplexity")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in (("__row", T.LongType()), ("n_tokens", T.LongType()), ("__near", T.DoubleType()), ("__far", longs), ("__times", longs)))])
    near = materialize(docs.select(*kept.columns, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text")).mapInArrow(run, schema))
    rest = near.select("__row", F.explode(F.arrays_zip("__far", "__times")).alias("z")).select(F.col("__row").alias("__r"), F.col("z.__far").alias("g"), F.col("z.__times").alias("times"))
    found = rest.join(model.select("g", "logp"), "g").groupBy("__r").agg(F.sum(F.col("logp") * F.col("times")).alias("__logs"))
    return (
        near.drop("__far", "__times")
        .join(found, F.col("__row") == F.col("__r"), "left")
        .withColumn("log10_prob", F.col("__near") + F.coalesce("__logs", F.lit(0.0)))
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")))
        .drop("__row", "__near", "__r", "__logs")
    )


def quality_filter(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.99,
    slack: float = 1.25,
    smooth: int = 4000,
    folds: int = 5,
    most: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``id_col, lang_col, trusted, n_tokens, log10_prob, perplexity, threshold, kept`` for each row of ``docs``.

    Trusted texts are those labelled with quality 1 and not toxic. The model counts all of those whose
    crc32 of the id as text isn't 0 by ``folds``; the others, which it hasn't seen, set the thresholds. A text of n bytes
    lies z = (log10 perplexity - m) / sqrt(1/n + 1/``smooth``) from its language's mean m: the longer it is, the
    less chance and topic move its perplexity. A language's limit is ``slack`` times the ``quantile`` of its z (to 0.001, from a
    histogram, so the same in every run), and ``threshold`` the perplexity that it means for the text. A language without
    such texts, and a null one, takes mean and quantile over all of them. Texts above their threshold aren't kept; with no trusted
    text at all, all are. Null texts are empty. Up to ``most`` trusted ids are broadcast; beyond that
    the ids are joined by a shuffle.
    """
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__good")).filter("__good IS NOT NULL").distinct()
    good = materialize(good)
    if good.count() <= most:
        good = F.broadcast(good)
    given = docs.select(id_col, text_col, lang_col).join(good, F.col(id_col) == F.col("__good"), "left").withColumn("trusted", F.col("__good").isNotNull()).drop("__good")
    unseen = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    model = gram_probabilities(count_grams(given, text_col, F.col("trusted") & ~unseen))
    scored = materialize(perplexities(given.select(id_col, lang_col, "trusted", text_col), model, text_col).withColumn("__lang", F.col(lang_col)))
    sure = scored.filter(F.col("trusted") & unseen)
    mean = -F.sum("log10_prob") / F.sum("n_tokens")
    level = F.log10("perplexity")
    spread = F.sqrt(1.0 / F.col("n_tokens") + 1.0 / smooth)

    def limits(rows: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, m, z``: the mean and the limit of each group; histograms have one row for each bin of a bounded scale."""
        joined = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))  # one row
        bins = joined.groupBy(*keys, F.ceil((level - F.col("m")) / spread * 1000).alias("__bin")).agg(F.count("*").alias("n"), F.max("m").alias("m"))
        by = Window.partitionBy(*(keys or [F.lit(0)]))
        upto = F.sum("n").over(by.orderBy("__bin")) >= quantile * F.sum("n").over(by)
        return bins.withColumn("__hit", upto).filter("__hit").groupBy(*keys).agg(F.max("m").alias("m"), (F.min("__bin") / 1000 * slack).alias("z"))

    own = limits(sure, sure.filter("__lang IS NOT NULL").groupBy("__lang").agg(mean.alias("m")), ["__lang"]).withColumnsRenamed({"m": "__m", "z": "__z"})
    every = limits(sure, sure.agg(mean.alias("m")), [])
    return (
        scored.join(own, "__lang", "left")
        .crossJoin(F.broadcast(every.agg(F.max("m").alias("__m0"), F.max("z").alias("__z0"))))  # one row
        .withColumn("threshold", F.pow(F.lit(10.0), F.coalesce("__m", "__m0") + F.coalesce("__z", "__z0") * spread))
        .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
        .select(id_col, lang_col, "trusted", "n_tokens", "log10_prob", "perplexity", "threshold", "kept")
    )
