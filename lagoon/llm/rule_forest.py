"""Operator 11: quality rules, and an isolation forest over their statistics for what no single rule shows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.storage import discard, materialize

#: What is counted in each text, in the order of the columns.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_upper", "n_digits", "n_marks", "n_flagged"]

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\t\n\v\f\r "
_INSIDE = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b"!?"


def _among(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: np.ndarray, doc: np.ndarray, docs: int, window: int = 8) -> np.ndarray:
    """For each document its words that lie in a run of ``window`` (a power of 2) words which occurs in it twice or more.

    ``words`` holds exact numbers of the words, ``doc`` the document of each; runs are numbered by doubling, so that nothing rests on hashes.
    """
    code, width = words.astype(np.int64), 1
    while width < window and len(code) > width:
        code = code[:-width] * (code.max() + 1) + code[width:]
        code = np.unique(code, return_inverse=True)[1].reshape(-1)
        width *= 2
    if width < window:
        return np.zeros(docs, np.int64)
    start = doc[: len(code)]
    whole = np.flatnonzero(start == doc[window - 1 :])
    if not len(whole):
        return np.zeros(docs, np.int64)
    _, at, n = np.unique(start[whole] * (code.max() + 1) + code[whole], return_inverse=True, return_counts=True)
    hit = whole[n[at.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


def rule_counts(texts: list[bytes], flagged: frozenset[bytes] = frozenset()) -> np.ndarray:
    """``COUNTS`` of each whole text: rows of int64. Words are runs of anything but ASCII blanks; ``flagged`` holds words without marks at their ends, A-Z in lower case."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    codes: dict[bytes, int] = {}
    numbers: list[np.ndarray] = []
    for row, text in zip(out, texts):
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        mine = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        numbers.append(mine)
        row[:] = (
            len(words), len(text) - _among(text, _INSIDE + _BLANKS), _among(text, _SYMBOLS), len(lines) - len(set(lines)), 0, len(lines), len(set(words)),
            _among(text, _LETTERS), _among(text, _UPPER), _among(text, _DIGITS), _among(text, _MARKS), 0,
        )
    if flagged:
        bad = np.fromiter((bare(w) in flagged for w in codes), bool, len(codes))
        out[:, 11] = [bad[x].sum() if len(x) else 0 for x in numbers]
    sizes = out[:, 0]
    if sizes.sum():
        out[:, 4] = repeated_words(np.concatenate(numbers), np.repeat(np.arange(len(texts)), sizes), len(texts))
    return out


def bare(word: bytes) -> bytes:
    """A word in lower case (A-Z) without the marks around it."""
    return word.lower().strip(b".,;:!?\"'()[]{}" + _SYMBOLS)


def features(counts: np.ndarray) -> np.ndarray:
    """Statistics between 0 and 1 that depend little on a text's length."""
    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words, lines, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_letters"], 1)
    chars = np.maximum(c["word_chars"], 1)

    def upto(x: np.ndarray, half: float) -> np.ndarray:
        return x / (x + half)

    return np.column_stack(
        (
            upto(c["n_symbols"] / words, 0.05),
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            upto(chars / words, 6),
            c["n_upper"] / letters,
            upto(c["n_marks"] / words, 0.05),
            np.minimum(c["n_digits"] / chars, 1),
            1 - np.log(np.maximum(c["n_distinct"], 1) + 1) / np.log(words + 1),
            upto(c["n_flagged"], 0.5),
            upto(c["n_flagged"] / words, 0.003),
        )
    )


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of a failed search in a binary tree of ``n`` keys: what a leaf of ``n`` rows still hides."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays over all nodes: the feature and cut of each, its lower child (the upper one follows), and the path length of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over that of a random tree: near 1 for what is cut off at once."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                down = self.child[at]
                at = np.where(down < 0, at, down + (x[every, self.feature[at]] >= self.cut[at]))
            total += self.path[at]
        usual = max(float(expected_path(self.sample)), 1.0)
        return 2.0 ** (-total / (len(self.roots) * usual))


def grow(x: np.ndarray, trees: int, sample: int, depth: int, seed: int) -> Forest:
    """A forest over the rows of ``x`` (values from 0 to 1), each tree over ``sample`` of them.

    A split takes any feature and any value of the node's cell, not only values between its rows' extremes: so what
    no row shows is cut off early, also along a statistic that is 0 in all of them.
    """
    feature, cut, child, path, roots = [], [], [], [], []

    def node() -> int:
        for held, value in ((feature, 0), (cut, 0.0), (child, -1), (path, 0.0)):
            held.append(value)
        return len(feature) - 1

    rng = np.random.default_rng(seed)
    for _ in range(trees):
        rows = x[rng.permutation(len(x))[:sample]]
        roots.append(node())
        todo = [(roots[-1], rows, np.zeros(x.shape[1]), np.ones(x.shape[1]), 0)]
        while todo:
            at, mine, low, high, level = todo.pop()
            if len(mine) == 0 or level == depth:
                path[at] = level + float(expected_path(len(mine)))
                continue
            f = int(rng.integers(x.shape[1]))
            value = float(rng.uniform(low[f], high[f]))
            feature[at], cut[at] = f, value
            child[at] = node()
            node()
            under = mine[:, f] < value
            top, bottom = low.copy(), high.copy()
            bottom[f], top[f] = value, value
            todo.append((child[at], mine[under], low, bottom, level + 1))
            todo.append((child[at] + 1, mine[~under], top, high, level + 1))
    return Forest(np.array(feature, np.int8), np.array(cut), np.array(child, np.int32), np.array(path, np.float32), np.array(roots, np.int32), depth, min(sample, len(x)))


def _counted(batches: Iterator[pa.RecordBatch], flagged: frozenset[bytes], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Each batch (id, text) with ``COUNTS`` in place of the text, some megabytes of text at a time."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        cuts = np.cumsum([len(x) for x in texts]) // most
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1):
            counts = rule_counts([texts[i] for i in at], flagged)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at[0] if len(at) else 0, len(at)), *map(pa.array, counts.T)], names=["id", *COUNTS])


def _pairs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Distinct ``toxic, word, before`` of each batch (toxic, text): bare words of up to ``longest`` bytes and the word before each."""
    for batch in batches:
        found: set[tuple[bool, bytes, bytes]] = set()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = [bare(w)[: longest + 1] for w in (text or b"").split()]
            found.update((toxic, w, b) for b, w in zip([b"", *words], words) if 0 < len(w) <= longest)
        rows = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.bool_()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["toxic", "word", "before"])


def _least(rows: DataFrame, keys: list[str], classes: Column, bound: int, seed: int) -> DataFrame:
    """Of each class (a column of few values) the rows of the least seeded hashes, ``bound`` at most: rows of equal ``keys`` come together or not at all.

    A hash is placed by its logarithm in 16ths of a halving, so that a thousand counts for each class decide.
    """
    share = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) + 1) / F.lit(2.0**53)
    step = F.floor(-F.log2(share) * 16).cast("int")
    held = rows.withColumn("class", classes).withColumn("step", step).filter("class IS NOT NULL")
    counts: dict = {}
    for r in held.groupBy("class", "step").count().collect():
        counts.setdefault(r["class"], []).append((r["step"], r["count"]))
    fits = F.lit(False)
    for name, found in counts.items():
        upto, cut = 0, None
        for value, n in sorted(found, reverse=True):
            upto += n
            if upto > bound:
                break
            cut = value
        if cut is not None:
            fits = fits | ((F.col("class") == name) & (F.col("step") >= cut))
    return held.filter(fits).drop("step")


def flagged_words(
    docs: DataFrame, marks: DataFrame, per_class: int, most: int = 2_000, times: float = 20.0, share: float = 0.03, longest: int = 64, seed: int = 42
) -> frozenset[bytes]:
    """Words typical of toxic texts: the ``most`` commonest that are ``times`` as common there as in trusted ones and met by ``share`` of the toxic rows.

    Learned from the texts of up to ``per_class`` toxic and as many trusted ids of ``marks`` (id, toxic, bad). A word counts once for each different word before it, so copies of a text don't add up.
    """
    ids = _least(marks.filter("toxic OR NOT bad"), ["id"], F.col("toxic"), per_class, seed).select(F.col("id").alias("key"), "toxic")
    ids = materialize(ids)
    rows = ids.filter("toxic").count()
    if not rows:
        return frozenset()
    texts = docs.join(F.broadcast(ids), F.col("id") == F.col("key")).select("toxic", "text")  # 2 * per_class ids at most
    met = texts.mapInArrow(lambda b: _pairs(b, longest), "toxic boolean, word binary, before binary").distinct()
    words = materialize(met.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")))
    total = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total["t"]:
        return frozenset()
    often = (F.col("t") / total["t"]) >= times * (F.col("c") + 0.5) / ((total["c"] or 0) + 1)
    found = words.filter(often & (F.col("t") >= max(2.0, share * rows))).orderBy(F.desc("t"), "word").limit(most).select("word").collect()
    discard(ids)
    discard(words)
    return frozenset(bytes(r["word"]) for r in found)


def threshold_of(counts: list[tuple[int, bool, int]], loss: float, cost: float) -> int | None:
    """The bin from which on rows go, of counts (bin, bad, rows); None where no trusted row can tell.

    It loses at most ``loss`` of the trusted rows, and of those cuts is the one where the share of bad rows caught less ``cost`` times the share of trusted ones lost is best (the highest of several); without bad rows, the lowest.
    """
    good, bad = sum(n for _, b, n in counts if not b), sum(n for _, b, n in counts if b)
    if not good:
        return None
    lost = caught = 0.0
    best, at = 0.0, 1001
    for value in sorted({v for v, _, _ in counts}, reverse=True):
        lost += sum(n for v, b, n in counts if v == value and not b) / good
        caught += sum(n for v, b, n in counts if v == value and b) / max(bad, 1)
        if lost > loss:
            break
        gain = caught - cost * lost
        if gain > best or not bad:
            best, at = gain, value
    return at


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 5_000,
    fitted: int = 50_000,
    trees: int = 200,
    sample: int = 256,
    depth: int = 12,
    loss: float = 0.005,
    cost: float = 10.0,
    folds: int = 5,
    most: int = 4_000_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``COUNTS``, ``base_failed, score, threshold, kept`` for each row of ``docs``.

    Counts are taken over whole texts (null: empty). ``base_failed``: fewer than 20 words, or over 30 % of the words in runs of eight that the text repeats. The other rows are scored by
    an isolation forest over statistics of the counts, grown on trusted rows (all labels of the id have quality 1 and none is toxic): up to ``fitted`` of the
    least seeded hashes, and ``per_class`` ids of trusted and of toxic rows for the words that it flags; without trusted rows it grows on all rows. Ids
    whose crc32 as text is 0 by ``folds`` take no part in that; all labelled rows among them set the threshold, see ``threshold_of``. Rows with a score from the threshold on, and those of
    ``base_failed``, aren't kept; without labelled rows the threshold is null and only ``base_failed`` counts. Up to ``most`` labelled ids are broadcast; beyond that they meet the counts in a shuffle join, which adaptive execution splits for hot ids.
    """
    toxic, quality = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("quality")
    given = labels.select(F.col(id_col).alias("id"), toxic.alias("toxic"), (toxic | F.coalesce(quality == 0, F.lit(False))).alias("bad"), quality.isNotNull().alias("known"))
    marks = given.filter("id IS NOT NULL AND (known OR toxic)").groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("bad").alias("bad"))
    unseen = F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0
    marks = materialize(marks.withColumn("unseen", unseen))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    flagged = flagged_words(texts, marks.filter("NOT unseen"), per_class, seed=seed)
    id_type = texts.schema["id"].dataType.simpleString()
    counted = texts.mapInArrow(lambda b: _counted(b, flagged), f"id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    known = marks.select(F.col("id").alias("key"), "bad", "unseen")
    known = F.broadcast(known) if marks.count() <= most else known
    counted = materialize(counted.withColumn("base_failed", failed).join(known, F.col("id") == F.col("key"), "left").drop("key"))

    able = counted.filter("NOT base_failed")
    trusted = able.filter("NOT bad AND NOT unseen")
    drawn = _least(trusted, ["id", *COUNTS], F.lit(0), fitted, seed).select(*COUNTS).collect()
    if not drawn:
        drawn = _least(able, ["id", *COUNTS], F.lit(0), fitted, seed).select(*COUNTS).collect()
    drawn.sort()
    forest = grow(features(np.array(drawn, np.int64).reshape(-1, len(COUNTS))), trees, sample, depth, seed)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(i).to_numpy() for i in range(1, len(COUNTS) + 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(features(counts)))], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    scored = materialize(counted.mapInArrow(score, f"{fields}, score double"))
    place = F.floor(F.col("score") * 1000).cast("int")
    bins = scored.filter("unseen AND bad IS NOT NULL AND NOT base_failed").groupBy(place.alias("bin"), "bad").count().collect()
    limit = threshold_of([(r["bin"], r["bad"], r["count"]) for r in bins], loss, cost)
    kept = ~F.col("base_failed") & (place < F.lit(limit) if limit is not None else F.lit(True))
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "score", (F.lit(limit) / 1000).cast("double").alias("threshold"), kept.alias("kept"))
