"""Rows of a table kept apart: from each other when ids repeat or are null, and from the operators' own columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shielded(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a step from a table to its own rows: columns whose names begin with ``__``, as the steps' own do, bear other names meanwhile."""

    @wraps(step)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        other: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                name = f"kept{c}"
                while name.lower() in taken:
                    name = f"kept_{name}"
                taken.add(name.lower())
                other[c] = name
        if not other:
            return step(docs, *args, **options)
        out = step(docs.withColumnsRenamed(other), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task never holds ten thousand texts as objects beside the batch; what Arrow keeps for later is given back at the end."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def occurrences(rows: DataFrame, key: str, row: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2... for the rows of each ``key``, the same numbers whatever tasks the rows lie in.

    ``row`` is a written ``monotonically_increasing_id``. A key's rows are counted by the partition that numbered them; only the
    counts meet, and numbers are given inside a partition, so a key with a third of all rows stays spread. Keys that occur once take no part in a window.
    """
    part = F.shiftrightunsigned(row, 33)
    counts = rows.groupBy(F.col(key).alias("__key"), part.alias("__at")).agg(F.count("*").alias("__in"))
    of_key = Window.partitionBy("__key")
    before = F.coalesce(F.sum("__in").over(of_key.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = counts.select("__key", "__at", before.alias("__before"), F.sum("__in").over(of_key).alias("__all")).filter("__all > 1")
    placed = rows.withColumn("__part", part).join(many, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy(row))
    repeated = placed.filter("__before IS NOT NULL").withColumn(name, (F.col("__before") + inside - 1).cast("long"))
    alone = placed.filter("__before IS NULL").withColumn(name, F.lit(0).cast("long"))
    return repeated.select(*rows.columns, name).unionByName(alone.select(*rows.columns, name))
