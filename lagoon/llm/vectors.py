"""Columns of vectors as exact integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """True for a vector that isn't null and holds neither nulls nor non-finite components."""
    return F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(value: Column, scale: int) -> Column:
    """Each component times ``scale`` in double precision, floored."""
    return F.transform(value, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usual_length(rows: DataFrame, vector_col: str, multiple: int = 1) -> int:
    """The commonest length of vectors, among those above 0 that ``multiple`` divides; of two as common the longer, and 0 without any."""
    n = F.size(vector_col)
    found = rows.filter((n > 0) & (n % multiple == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def safe_component(length: int) -> int:
    """Components below this bound keep the squared distance of two vectors of ``length``, and their inner product, within 62 bits."""
    return 1 << ((60 - max(length, 1).bit_length()) // 2)
