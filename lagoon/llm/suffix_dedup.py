"""Operator 9: removal of repeated byte strings, found by suffix order over shards of candidate regions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.induced_sort import repeated
from lagoon.storage import materialize

_ODD = np.uint64(0x9E3779B97F4A7C15)


def segments(text: bytes, length: int, gram: int = 32) -> np.ndarray | None:
    """Rows (hash, first start, last start, twice): the starts of ``length``-byte strings by their least ``gram``-byte hash.

    The least hash inside a string depends on the string alone, so equal strings have equal hashes.
    ``twice`` is 1 where the region holds that hash more than once, so that strings may repeat inside
    it. None if the text is shorter than ``length``.
    """
    if len(text) < length:
        return None
    h = (np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * _ODD
    h ^= h >> np.uint64(29)
    width = 1
    while width < gram:
        step = min(width, gram - width)
        h = (h[: len(h) - step] * np.uint64(0xBF58476D1CE4E5B9)) ^ ((h[step:] << np.uint64(31)) | (h[step:] >> np.uint64(33)))
        h *= _ODD
        h ^= h >> np.uint64(29)
        width += step
    grams, inside, width = h, length - gram + 1, 1
    while width < inside:
        step = min(width, inside - width)
        h = np.minimum(h[: len(h) - step], h[step:])
        width += step
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    last = np.append(first[1:], len(h)) - 1
    twice = [np.count_nonzero(grams[a:b] == v) > 1 for a, b, v in zip(first.tolist(), (last + inside).tolist(), h[first])]
    return np.stack((h[first].view(np.int64), first, last, np.array(twice, dtype=np.int64)))


def _candidates(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``h``: hashes of regions at two places, or twice in a region; copies of a whole text are one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places = [], []
            for text in batch.column(0).to_pylist():
                found = segments(text or b"", length)
                if found is not None:
                    seed = np.frombuffer(hashlib.md5(text).digest()[:8], dtype=np.uint64)
                    place = ((found[1].astype(np.uint64) + seed) * _ODD).view(np.int64)
                    again = found[3] == 1
                    hashes += [found[0], found[0][again]]
                    places += [place, ~place[again]]
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], names=["h", "place"])

    made = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "h long, place long")
    return made.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a != b").select("h")


def _pieces(docs: DataFrame, text_col: str, length: int, wanted: DataFrame, most: int) -> DataFrame:
    """``h, piece, bytes, uid, start``: the regions of every text whose hash is wanted, ``piece`` a digest of the bytes."""
    spark = docs.sparkSession
    given = docs.select(F.col(text_col).cast("binary").alias("t"))
    schema = "h long, piece binary, bytes binary, uid binary, start long"

    def cut(text: bytes, found: np.ndarray) -> Iterator[tuple]:
        uid = hashlib.md5(text).digest()
        for h, a, b in found[:3].T.tolist():
            part = text[a : b + length]
            yield h, hashlib.md5(part).digest(), part, uid, a

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows:
            held.append(row)
            size += len(row[2])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    names, kinds = ["h", "piece", "bytes", "uid", "start"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    if wanted.count() <= most:
        shared = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in wanted.toLocalIterator()], dtype=np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            want = shared.value

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for text in batch.column(0).to_pylist():
                        found = segments(text or b"", length) if len(want) else None
                        if found is not None:
                            at = np.minimum(np.searchsorted(want, found[0]), len(want) - 1)
                            yield from cut(text, found[:, want[at] == found[0]])

            yield from batches_of(rows())

        return given.mapInArrow(run, schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                found = segments(text or b"", length)
                if found is not None:
                    uid = hashlib.md5(text).digest()
                    out += [(h, uid, [h, a, b]) for h, a, b in found[:3].T.tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["h", "uid", "cut"])

    marked = given.mapInArrow(mark, "h long, uid binary, cut array<long>").distinct().join(wanted, "h").groupBy("uid").agg(F.collect_list("cut").alias("cuts"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield from cut(text, np.array(cuts, dtype=np.int64).T)

        yield from batches_of(rows())

    texts = given.filter("t IS NOT NULL").withColumn("uid", F.unhex(F.md5("t")))
    return texts.join(marked, "uid").select("t", "cuts").mapInArrow(take, schema)


def repeated_starts(docs: DataFrame, text_col: str = "text", length: int = 400, shard_bytes: int = 2 << 20, hot: int = 4_000, most: int = 8_000_000, memory: int = 128 << 20) -> DataFrame:
    """``uid, spans``: for each text (by MD5) the ranges [first, last] of starts of strings that also start elsewhere.

    A text's strings fall into regions by their least inner hash; only regions whose hash stands at
    two places can hold repeats. Equal regions are joined first. The rest is dealt by hash into
    shards of about ``shard_bytes``, whose suffixes and common prefixes are sorted by induction; the regions of one hash are one
    shard whatever their size, and beyond ``memory`` its sort goes on in files.
    A hash with more than ``hot`` different regions isn't sorted in one shard: its single strings are
    joined by digest, which no task needs whole. The wanted hashes are broadcast up to ``most`` of
    them (8 bytes each) and joined beyond that.
    """
    wanted = materialize(_candidates(docs, text_col, length))
    pieces = materialize(_pieces(docs, text_col, length, wanted, most))
    place = F.xxhash64("uid", "start")
    distinct = pieces.groupBy("piece", "h").agg(F.first("bytes").alias("bytes"), F.min(place).alias("a"), F.max(place).alias("b"))
    distinct = materialize(distinct.select("piece", "h", "bytes", (F.col("a") != F.col("b")).alias("many")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = distinct.groupBy("h").count().filter(F.col("count") > hot).select("h")
    dealt = distinct.join(crowded, "h", "left_anti").repartition(parts, "h").sortWithinPartitions("h").select("h", "piece", "bytes", "many")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > shard_bytes and row[0] != held[-1][0]:
                    yield _sorted(held, length, memory)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield _sorted(held, length, memory)

    ranges = dealt.mapInArrow(sort, "piece binary, first long, last long")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, text, many in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = len(text) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.md5(text[i : i + length]).digest() for i in range(n)], pa.binary()), pa.array([piece] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([many] * n, pa.bool_())],
                    names=["string", "piece", "at", "many"],
                )

    strings = distinct.join(crowded, "h").select("piece", "bytes", "many").mapInArrow(single, "string binary, piece binary, at long, many boolean")
    often = strings.groupBy("string").agg(F.count("*").alias("n"), F.max("many").alias("many")).filter("n > 1 OR many").select("string")
    # starts of a piece that follow each other are one range
    by = Window.partitionBy("piece").orderBy("at")
    runs = strings.join(often, "string").select("piece", "at").withColumn("run", F.col("at") - F.row_number().over(by))
    hot_ranges = runs.groupBy("piece", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")
    found = ranges.unionByName(hot_ranges)
    spans = pieces.select("piece", "uid", "start").distinct().join(found, "piece").select(
        "uid", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("span")
    )
    return spans.groupBy("uid").agg(F.collect_list("span").alias("spans"))


def _sorted(rows: list[tuple], length: int, memory: int) -> pa.RecordBatch:
    """Ranges of repeated starts of the pieces of one shard."""
    out: list[tuple] = []
    for (_, piece, text, many), at in zip(rows, repeated([r[2] for r in rows], length, memory)):
        if many:
            out.append((piece, 0, len(text) - length))
        elif len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            out += [(piece, a, b) for a, b in zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.append(cut, len(at) - 1)].tolist())]
    cols = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], names=["piece", "first", "last"])


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``id_col, n_bytes, kept, spans``: each text without the bytes of strings that also start anywhere else.

    ``spans`` are the maximal removed runs [start, end) in bytes; ``kept`` (binary) is the rest. Texts
    that stand in several rows are removed whole from ``length`` bytes on. Strings are judged on the
    input; null texts are empty, texts shorter than ``length`` stay, an empty table gives no rows,
    null ids are rows like others.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    given = docs.select(F.col(id_col), text.alias("__text"), F.unhex(F.md5(text)).alias("__uid"))
    copies = given.groupBy("__uid").agg(F.count("*").alias("__copies"))
    found = repeated_starts(docs, text_col, length, **options).withColumnRenamed("uid", "__u")
    facts = copies.join(found, F.col("__uid") == F.col("__u"), "left").drop("__u")
    facts = materialize(facts.filter("__copies > 1 OR spans IS NOT NULL").withColumnRenamed("__uid", "__u"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, runs = [], []
            for text, copies, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if (copies or 0) > 1 and len(text) >= length:
                    cuts = [(0, len(text))]
                else:
                    cuts = []
                    for s in sorted((s["first"], s["last"] + length) for s in spans or ()):
                        if cuts and s[0] <= cuts[-1][1]:
                            cuts[-1] = (cuts[-1][0], max(cuts[-1][1], s[1]))
                        else:
                            cuts.append(s)
                edges = [0, *(x for c in cuts for x in c), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                runs.append([{"start": a, "end": b} for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[id_col, "n_bytes", "kept", "spans"],
            )

    joined = given.join(facts, F.col("__uid") == F.col("__u"), "left").select(id_col, "__text", "__copies", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
