"""Recordings pinned at a length: a later read gives the same lines or says why it can't, whatever was appended since."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.sources.ranges import RECORD_BYTES, listed, opened, split_lines

CHUNK = 4 << 20

PIN = "file string, size bigint, chunk bigint, start bigint, end bigint, sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range (file, size, chunk, start, end) with the file's length now and the range's digest; null where it can't be read."""
    for batch in batches:
        now, digest = [], []
        for name, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
            try:
                with opened(name) as file:
                    now.append(file.size())
                    data = file.read_at(end - start, start) if now[-1] >= end else None
                digest.append(None if data is None else hashlib.sha256(data).hexdigest())
            except FileNotFoundError:
                now.append(None)
                digest.append(None)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(now, pa.int64()), pa.array(digest, pa.string())], names=["file", "size", "chunk", "start", "end", "now", "found"])


def _read(ranges: DataFrame) -> DataFrame:
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("file", "size", "chunk", "start", "end").repartition(parts, "file", "chunk")
    return dealt.mapInArrow(_digests, "file string, size bigint, chunk bigint, start bigint, end bigint, now bigint, found string")


def pin(spark: SparkSession, path: str, pattern: str = "*.jsonl", chunk: int = CHUNK) -> DataFrame:
    """``file, size, chunk, start, end, sha256``: the recordings below a folder as they are now, one row for each ``chunk`` bytes.

    The listing gives the lengths; chunks are read by tasks of their own, so a long file is digested by many. An empty file has one empty chunk.
    """
    files = spark.createDataFrame(listed(path, pattern), "file string, size bigint")
    cut = files.withColumn("chunk", F.explode(F.expr(f"sequence(0L, greatest(0L, (size - 1) div {chunk}))")))
    ranges = cut.select("file", "size", "chunk", (F.col("chunk") * chunk).alias("start"), F.least((F.col("chunk") + 1) * chunk, "size").alias("end"))
    return _read(ranges).select("file", "size", "chunk", "start", "end", F.col("found").alias("sha256"))


def revision(pins: DataFrame) -> DataFrame:
    """``file, size, revision``: one digest for each pinned file, over the digests of its chunks in order."""
    chain = F.array_sort(F.collect_list(F.struct("chunk", "sha256")))  # 64 characters for each chunk
    return pins.groupBy("file", "size").agg(chain.alias("c")).select("file", "size", F.sha2(F.concat_ws("", "c.sha256"), 256).alias("revision"))


def verify(pins: DataFrame) -> DataFrame:
    """``file, size, now, state``: what became of each pinned file.

    ``same``, ``grown`` (all pinned bytes are there and more follow), ``changed`` (a pinned chunk has other bytes), ``truncated`` (shorter than the pin), or ``missing``.
    """
    told = _read(pins).join(pins.select("file", "chunk", "sha256"), ["file", "chunk"])
    by_file = told.groupBy("file", "size").agg(F.min("now").alias("now"), F.bool_and(F.col("found").eqNullSafe(F.col("sha256"))).alias("equal"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") < F.col("size"), "truncated").when(~F.col("equal"), "changed").when(F.col("now") > F.col("size"), "grown").otherwise("same")
    return by_file.select("file", "size", "now", state.alias("state"))


def _lines(batches: Iterator[pa.RecordBatch], most: int, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Lines that begin in each range, whole also where they go on beyond it, but never beyond the pinned length."""
    for batch in batches:
        for name, size, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            with opened(name) as file:
                before = max(0, start - 1)
                data = file.read_at(end - before, before)
                at = end
                while at < size and data[-1:] != b"\n":  # the last line goes on
                    more = file.read_at(min(step, size - at), at)
                    cut = more.find(b"\n") + 1 or len(more)
                    data += more[:cut]
                    at += cut
            skip = 0
            if start:
                skip = data.find(b"\n") + 1 or len(data)
            rows = list(split_lines(data[skip:], before + skip, most))
            columns = list(zip(*rows)) or [()] * 4
            text = [None if x is None else x.decode("utf-8", "replace") for x in columns[2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(text, pa.string()), pa.array(columns[3], pa.string())],
                names=["file", "start", "end", "value", "reason"],
            )


def lines_of(ranges: DataFrame, most: int = RECORD_BYTES) -> DataFrame:
    """``file, start, end, value, reason``: lines that begin in ranges (file, size, chunk, start, end) of files."""
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("file", "size", "chunk", "start", "end").repartition(parts, "file", "chunk")
    return dealt.mapInArrow(lambda b: _lines(b, most), "file string, start bigint, end bigint, value string, reason string")


def replay(pins: DataFrame, most: int = RECORD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lines, refused)``: the pinned lines of files that still hold them, and the state of the others.

    Bytes appended after the pin are outside the replay. A file that was shortened, or changed within the pinned length, gives no line.
    """
    state = verify(pins)
    sound = state.filter(F.col("state").isin("same", "grown")).select("file")
    return lines_of(pins.join(sound, "file", "left_semi"), most), state.filter(~F.col("state").isin("same", "grown"))


def page(pins: DataFrame, cursors: DataFrame, size: int, most: int = RECORD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lines, next)``: the lines before each file's cursor in the last ``size`` bytes before it, and the cursors of the page before.

    ``cursors``: file, end and, from the second page on, bytes. Only the pinned chunks that a page touches are read and checked; where one of them has changed the page is refused: ``next`` has ``state`` changed,
    truncated or missing and no lines come. A line that begins before the page belongs to the page before; a page inside one
    long line is empty, and the next one reaches twice as far back (``bytes``). ``end`` is null after the first page of the file.
    """
    reach = F.greatest(F.coalesce("bytes", F.lit(size)), F.lit(size)) if "bytes" in cursors.columns else F.lit(size)
    asked = cursors.filter("end IS NOT NULL").select("file", F.col("end").alias("until"), reach.cast("long").alias("bytes"))
    window = pins.join(asked, "file").withColumn("since", F.greatest(F.lit(0), F.col("until") - F.col("bytes")))
    touched = window.filter((F.col("start") < F.col("until")) & (F.col("end") > F.col("since")))
    state = verify(touched.select("file", "size", "chunk", "start", "end", "sha256")).select("file", F.when(F.col("state").isin("same", "grown"), "read").otherwise(F.col("state")).alias("state"))
    sound = state.filter("state = 'read'").select("file")
    ranges = touched.join(sound, "file", "left_semi").select("file", F.col("until").alias("size"), "chunk", F.greatest("start", "since").alias("start"), F.least("end", "until").alias("end"))
    lines = lines_of(ranges, most)
    first = lines.groupBy("file").agg(F.min("start").alias("first"))
    spans = window.select("file", "since", "until", "bytes").distinct()
    after = state.join(spans, "file").join(first, "file", "left")
    goes_on = (F.col("state") == "read") & (F.col("since") > 0)
    return lines, after.select(
        "file", "state", F.when(goes_on, F.coalesce("first", "until")).alias("end"), F.when(goes_on, F.when(F.col("first").isNull(), F.col("bytes") * 2).otherwise(size)).cast("long").alias("bytes")
    )
