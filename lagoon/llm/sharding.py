"""Operator 8: contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.storage import materialize


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` that are named ``id_col`` or ``text``-derived, with a shard for each row.

    Rows are laid in order of ``id_col`` (null first; ties by text, then any order). A row's size is
    its text's UTF-8 bytes (null: none) plus ``overhead``. Range partitions give totals, the totals'
    running sum gives each partition its offset, and a window inside the partition gives each row
    its place in the whole. A row goes to the shard that holds the middle of its bytes, so shard
    boundaries lie at equal targets and shards are contiguous. Only one row for each partition and
    one for each shard ever meet in a single task.

    Returns ``id_col, size, text_crc32, shard, slot``; ``slot`` counts rows in a shard from 0.
    An empty table gives no rows; null texts have checksum 0; equal rows may swap places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__h"),
        F.rand(7).alias("__r"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_first(), F.col("__h"), F.col("__r")]
    laid = materialize(sized.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = laid.groupBy("__part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("bytes").over(whole).alias("__total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each partition: bounded by the partition count, never by the data
    placed = (
        laid.withColumns({"__sum": F.sum("size").over(inside), "__row": F.row_number().over(inside)})
        .join(F.broadcast(offsets), "__part")
        .withColumn("__at", F.col("__rows_before") + F.col("__row") - 1)
        .withColumn("__middle", 2 * (F.col("__bytes_before") + F.col("__sum")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"__middle * {shards} div (2 * __total)"), F.lit(shards - 1)).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("__at").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("__at") - F.col("__first")).alias("slot")
    )
