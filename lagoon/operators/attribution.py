"""Consumption of sessions attributed to work: segments between edges of evidence, and layers over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.works import evidence_edges, sweep


def segments(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, segment, from, to, works``: the timeline cut at every edge of its spans, with the work that covers each piece.

    The segment before the first edge (from null) and after the last (to null) are there too; the
    first is covered by nothing. Edges pass once in order, with the set of open works (see ``works.sweep``).
    """
    kind = spans.schema["from"].dataType
    edges = evidence_edges(spans.withColumn("tier", F.lit("bound")), None, keys)
    none = spans.limit(0).select(*keys, F.col("from").alias("at"), F.lit(0).cast("bigint").alias("request"))
    cut, _ = sweep(edges, none, keys)
    ends = [F.timestamp_micros(c).cast(kind).alias(n) for c, n in (("from_us", "from"), ("to_us", "to"))]
    return cut.select(*keys, "segment", *ends, F.transform("covers", lambda c: c["work"]).alias("works"))


def reasons(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``reason`` a segment isn't one item's: before the first, after the last, between, or overlap; null if it is."""
    by = Window.partitionBy(*keys)
    covered = F.when(F.size("works") > 0, F.col("segment"))
    marked = pieces.withColumns({"__first": F.min(covered).over(by), "__last": F.max(covered).over(by)})
    reason = (
        F.when(F.size("works") == 1, None)
        .when(F.size("works") > 1, "overlap")
        .when(F.col("__first").isNull() | (F.col("segment") < F.col("__first")), "before-first-item")
        .when(F.col("segment") > F.col("__last"), "after-last-item")
        .otherwise("between-items")
    )
    return marked.withColumn("reason", reason).drop("__first", "__last")


def layers(pieces: DataFrame, keys: list[str], requests: str = "requests") -> DataFrame:
    """Requests by work and by what is left: the conserving share, and the even split of overlapped segments."""
    judged = reasons(pieces, keys)
    n = F.size("works")
    spread = judged.withColumn("__n", n).select("*", F.posexplode_outer("works").alias("__i", "work"))
    even = F.when(F.col("__n") > 1, F.expr(f"{requests} div __n + CAST(__i < {requests} % __n AS BIGINT)")).otherwise(F.when(F.col("__n") == 1, F.col(requests)).otherwise(0))
    whole = F.when(F.col("__n") == 1, F.col(requests)).otherwise(0)
    left = F.when(F.col("__n") == 0, F.col(requests)).otherwise(0)
    return spread.groupBy("work").agg(F.sum(whole).alias("conserving"), F.sum(even).alias("allocated"), F.sum(left).alias("unattributed"))
