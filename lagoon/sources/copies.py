"""Evidence kept byte for byte: where each JSON value of a recording lies, and copies named by their digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions.json_spans import value_spans
from lagoon.sources.ranges import RECORD_BYTES, opened

SPANS = "file string, record bigint, pointer string, start bigint, end bigint, sha256 string"


def _spans(batches: Iterator[pa.RecordBatch], deepest: int, most: int) -> Iterator[pa.RecordBatch]:
    """Values of the records at (file, start, end), as they lie in the file."""
    for batch in batches:
        rows: list[tuple] = []
        for name, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if end - start > most:
                continue
            with opened(name) as file:
                data = file.read_at(end - start, start)
            for depth, pointer, a, b in value_spans(data, deepest):
                if depth >= 0:
                    rows.append((name, start, pointer, start + a, start + b, hashlib.sha256(data[a:b]).hexdigest()))
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "record", "pointer", "start", "end", "sha256"])


def index_values(records: DataFrame, deepest: int = 8, most: int = RECORD_BYTES) -> DataFrame:
    """``file, record, pointer, start, end, sha256``: each value down to ``deepest`` levels of each record (file, start, end), by byte of the file; ``pointer`` is its JSON pointer.

    Bytes are read from the file, so what an index says holds of the file itself whatever a parser made of it. Records beyond ``most`` bytes have no rows.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.select("file", "start", "end").repartition(parts, "file", "start")
    return dealt.mapInArrow(lambda b: _spans(b, deepest, most), SPANS)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        for name, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                with opened(name) as file:
                    held.append(file.read_at(end - start, start))
            except FileNotFoundError:
                held.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.binary())], names=["file", "start", "end", "sha256", "content"])


def copies(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(copies, refused)``: ``sha256, bytes, content`` of each different value of an index, once, and the spans whose bytes are no longer those of the index.

    Spans of one digest are one copy, taken from the first file that holds it; of a value with a third of all spans one is read. A span that has changed
    since gives no copy: it is refused with its file and place.
    """
    first = index.groupBy("sha256").agg(F.min(F.struct("file", "start", "end")).alias("at")).select("at.file", "at.start", "at.end", "sha256")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = first.repartition(parts, "sha256").mapInArrow(_contents, "file string, start bigint, end bigint, sha256 string, content binary")
    told = F.sha2("content", 256).eqNullSafe(F.col("sha256"))
    return read.filter(told).select("sha256", F.octet_length("content").cast("bigint").alias("bytes"), "content"), read.filter(~told).select("file", "start", "end", "sha256")


def changed_spans(index: DataFrame) -> DataFrame:
    """Spans of an index whose bytes in the file are others now."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = index.select("file", "start", "end", "sha256").repartition(parts, "file", "start").mapInArrow(_contents, "file string, start bigint, end bigint, sha256 string, content binary")
    return read.filter(~F.sha2("content", 256).eqNullSafe(F.col("sha256"))).drop("content")
