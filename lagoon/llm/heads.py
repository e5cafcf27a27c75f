"""The most frequent rows of a table of counts, within a bound, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequent(table: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of the highest counts: all from the least cut on that leaves at most ``limit`` rows.

    Cuts are steps of a thousandth in the logarithm of the count, so one small histogram (some ten
    thousand rows at most) decides, ties stay together, and nothing but the chosen rows is gathered.
    """
    step = F.floor(F.log(F.greatest(F.col(count), F.lit(1))) * 1000)
    sizes = table.groupBy(step.alias("__step")).agg(F.count("*").alias("__n"))
    upto = sizes.withColumn("__upto", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__step"))))
    cut = upto.filter(F.col("__upto") <= limit).agg(F.min("__step")).first()[0]
    return table.filter(step >= cut) if cut is not None else table.limit(0)
