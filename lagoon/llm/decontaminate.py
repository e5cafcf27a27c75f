"""Operator 6: benchmark decontamination by seeds of word pairs, counted against what a copy keeps, and Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.rows import shielded
from lagoon.storage import materialize

#: ASCII punctuation and controls part words, as white space does; letters beyond ASCII stay.
_BLANK = bytes(32 if not (48 <= c < 58 or 97 <= c < 123 or c >= 128) else c for c in (c + 32 if 65 <= c < 91 else c for c in range(256)))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (in any script) words of letters, digits and bytes beyond ASCII."""
    text = text or b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_BLANK).split()


def _gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` word hashes."""
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ ids[k : len(ids) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Seeds:
    """N-grams of the test items as fixed-size bitmaps, one for each class of items; built once in each task.

    A bitmap has 16 bits for each seed, from 2^22 to 2^25 in all: what passes wrongly is dropped by the exact
    join on the seed's hash.
    """

    def __init__(self, width: int, classes: list[tuple[int, int, int, int, int, bytes]]):
        self.shift = np.uint64(64 - width)
        self.classes = [(*c[:-1], np.unpackbits(np.frombuffer(c[-1], dtype=np.uint8), bitorder="little").astype(bool)) for c in classes]
        self.cache: dict[bytes, int] = {}

    def runs(self, tokens: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """``class, start, end, hashes``: windows of the tokens in which hits lie as close as in a copy, with their hashes."""
        cache, digest = self.cache, xxhash.xxh64_intdigest
        if len(cache) > 2_000_000:
            cache.clear()
        for w in set(tokens).difference(cache):
            cache[w] = digest(w)
        ids = np.fromiter((cache[w] for w in tokens), dtype=np.uint64, count=len(tokens))
        made: dict[int, np.ndarray] = {}
        for kind, n, need, near, reach, bits in self.classes:
            if len(ids) < n:
                continue
            if n not in made:
                made[n] = _gram_hashes(ids, n)
            at = np.flatnonzero(bits[(made[n] >> self.shift).astype(np.int64)])
            if len(at) < need:
                continue
            close = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= near)
            if not len(close):
                continue
            # every hit among ``need`` close ones
            inside = np.zeros(len(at) + 1, dtype=np.int64)
            inside[close] += 1
            inside[close + need] -= 1
            at = at[np.cumsum(inside[:-1]) > 0]
            for run in np.split(at, np.flatnonzero(np.diff(at) > reach) + 1):
                yield kind, max(0, int(run[0]) - reach), min(len(tokens), int(run[-1]) + n + reach), np.unique(made[n][run].view(np.int64))


def item_grams(items: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """``item, n, need, near, reach, class, hash``: every seed of every item, and how many of them each copy keeps.

    A copy with m words matched and e edits scores m - e, at least T = threshold * words rounded up. The m
    words stand in at most e + 1 runs, so at least m - e - 1 >= T - 1 pairs of neighbouring words
    survive whatever the edits are, within the m + e <= 2 * words - T words that the copy covers. Where T is 1
    the seeds are the single words. An item of fewer than ``n`` words is one gram that must stand whole.
    """
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words_of(text)
                if tokens:
                    words = len(tokens)
                    least = max(1, int(np.ceil(threshold * words - 1e-9)))
                    k, need, reach = (words, 1, words) if words < n else (1, 1, 2 * words) if least == 1 else (2, least - 1, 2 * words - least)
                    ids = np.array([xxhash.xxh64_intdigest(w) for w in tokens], dtype=np.uint64)
                    for h in _gram_hashes(ids, k).view(np.int64).tolist():
                        # items of one gram length whose needs lie within a factor of two share a bitmap
                        for col, v in zip(cols, (item, k, need, max(0, reach - k), reach, 64 * k + need.bit_length(), h)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["item", "n", "need", "near", "reach", "class", "hash"])

    given = items.select(F.col(id_col), F.col(text_col).cast("binary")).filter(F.col(text_col).isNotNull())
    return given.mapInArrow(run, f"item {kind}, n long, need long, near long, reach long, class long, hash long")


def _classes(grams: DataFrame) -> tuple[int, list[tuple[int, int, int, int, int, bytes]]]:
    """The bits' width w, and ``class, n, need, near, reach`` with 2^w bits of each class, set where a gram's hash begins so."""
    width = min(25, max(22, int(16 * grams.count()).bit_length()))
    at = f"shiftrightunsigned(hash, {64 - width})"
    words = grams.select("class", F.expr(f"shiftrightunsigned({at}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("b")).groupBy("class", "w").agg(F.bit_or("b").alias("b"))
    bounds = grams.groupBy("class", "n").agg(F.min("need"), F.max("near"), F.max("reach")).orderBy("class").collect()
    bits = {row["class"]: np.zeros(1 << (width - 6), dtype=np.int64) for row in bounds}
    for row in words.toLocalIterator():
        bits[row["class"]][row["w"]] = row["b"]
    return width, [(*row, bits[row["class"]].tobytes()) for row in bounds]


def align(window: list[bytes], item: list[bytes], match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Smith-Waterman: best local score of ``item`` in ``window``, and the words of the window it covers, [start, end)."""
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in window])
    b = [ids.setdefault(w, len(ids)) for w in item]
    columns = np.arange(len(a) + 1)
    score = np.zeros(len(a) + 1, dtype=np.int64)
    origin = columns.copy()
    best, start, end = 0, 0, 0
    for w in b:
        diagonal = score[:-1] + np.where(a == w, match, mismatch)
        up = score[1:] + gap
        down = np.maximum(diagonal, up)
        begun = np.where(diagonal >= up, origin[:-1], origin[1:])
        fresh = down <= 0
        down[fresh] = 0
        begun = np.where(fresh, columns[1:], begun)
        # gaps in the item: the best of what stands to the left, less the way
        level = np.concatenate(([0], down)) - gap * columns
        reach = np.maximum.accumulate(level)
        last = np.maximum.accumulate(np.where(level == reach, columns, 0))
        score = np.maximum(reach + gap * columns, 0)
        origin = np.concatenate(([0], begun))[last]
        origin = np.where(score == 0, columns, origin)
        k = int(score.argmax())
        if score[k] > best:
            best, start, end = int(score[k]), int(origin[k]), k
    return best, start, end


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    n: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``id_col, item_col, score, start, end``: each document that holds a copy of an item, with the best one.

    ``score`` is the best local alignment of an item's words with the document's (Smith-Waterman: match 1,
    mismatch and gap -1) over the item's words: 1 for a whole copy, less for each edit; pairs from
    ``threshold`` on are returned, ``start`` and ``end`` in words of the document. Every pair of neighbouring words of
    an item is a seed, and a document's words are aligned with an item wherever as many of its seeds lie
    together as any copy from ``threshold`` on keeps (see ``item_grams``), so no copy is lost, however it was edited.
    Windows meet items by the items' rarest seeds, of which any such copy keeps one; a pair of words that all items share joins nothing.
    Documents are scanned once, by bitmaps of fixed size; the windows found are joined to the items by seed hash in a
    shuffle join.

    Items with null or empty text match nothing, as do null and empty documents; items of fewer
    than ``n`` words are a single seed that must stand whole. Repeated rows give their results once for each id.
    """
    grams = materialize(item_grams(items, item_col, item_text, n, threshold))
    if grams.isEmpty():
        named = [docs.schema[id_col], items.schema[item_col], T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
        return docs.sparkSession.createDataFrame([], T.StructType(named))
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).filter(F.col(text_col).isNotNull())

    width, classes = _classes(grams)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Seeds(width, classes)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words_of(text)
                for group, a, b, hashes in found.runs(tokens):
                    for col, v in zip(out, (doc, group, a, b" ".join(tokens[a:b]), hashes.tolist())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))],
                names=[id_col, "class", "offset", "window", "hashes"],
            )

    met = materialize(given.mapInArrow(windows, f"`{id_col}` {kind}, class long, offset long, window binary, hashes array<long>").withColumn("w", F.monotonically_increasing_id()))
    # a window with ``need`` of an item's seeds has one of its rarest seeds, all but need - 1 of them: those alone are joined
    often = grams.groupBy("class", "hash").agg(F.count_distinct("item").alias("items"))
    ranked = grams.join(often, ["class", "hash"]).withColumn("rank", F.row_number().over(Window.partitionBy("item", "class").orderBy("items", "hash")))
    lead = ranked.withColumn("seeds", F.count("*").over(Window.partitionBy("item", "class"))).filter("rank <= seeds - need + 1")
    whole = grams.groupBy("item", "class").agg(F.collect_list("hash").alias("seeds"), F.min("need").alias("need"))
    pairs = (
        met.select("w", "class", F.explode("hashes").alias("hash"))
        .join(lead.select("class", "hash", "item").distinct(), ["class", "hash"])
        .select("w", "class", "item")
        .distinct()
        .join(met.select("w", "hashes"), "w")
        .join(whole, ["item", "class"])
        .filter("size(filter(seeds, s -> array_contains(hashes, s))) >= need")
        .select("w", "item")
    )
    texts = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("item_text")).filter("item_text IS NOT NULL").distinct()
    candidates = pairs.join(met.select("w", id_col, "offset", "window"), "w").join(texts, "item").select(id_col, "offset", "window", "item", "item_text")
    item_kind = items.schema[item_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for window, text in zip(batch["window"], batch["item_text"]):
                item = words_of(bytes(text))
                best, a, b = align(bytes(window).split(), item)
                got.append((best / len(item), a, b))
            made = pd.DataFrame(got, columns=["score", "start", "end"])
            yield pd.DataFrame(
                {id_col: batch[id_col], item_col: batch["item"], "score": made["score"], "start": made["start"] + batch["offset"].to_numpy(), "end": made["end"] + batch["offset"].to_numpy()}
            )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = candidates.repartition(parts).mapInPandas(score, f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, start long, end long")
    return (
        scored.filter(F.col("score") >= threshold)
        .groupBy(id_col, item_col)
        .agg(F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end"))).alias("best"))
        .select(id_col, item_col, "best.score", "best.start", "best.end")
    )


@shielded
def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` without the rows whose own text holds a copy of a test item; all columns as they were, whatever the ids are."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    bad = contaminated(numbered, items, threshold, id_col="__row", text_col=text_col, **names).select("__row").distinct()
    return numbered.join(bad, "__row", "left_anti").drop("__row")
