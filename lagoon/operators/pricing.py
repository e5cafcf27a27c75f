"""List prices: lookup by id, alias or undated id, validity, terms by time and length, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("uncached_input", "cache_read", "output")


def undated(model: Column) -> Column:
    """A model id without the date it ends in."""
    return F.regexp_replace(model, r"-\d{8}$", "")


def price_of(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests with the price row of their model that is valid at their time, or ``price_reason``.

    ``prices`` (model, aliases, from, until, price columns) is looked up by id, then alias, then by
    the id without its date. Price lists have a few rows for each model; Spark broadcasts them while
    they are below its own limit.
    """
    names = prices.withColumn("__name", F.explode(F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>"))))).withColumnsRenamed(
        {"model": "__listed", "from": "__from", "until": "__until"}
    ).drop("aliases")
    known = names.select(F.col("__name").alias("__k")).distinct()
    keyed = requests.join(known, F.col("model") == F.col("__k"), "left").withColumn("__key", F.when(F.col("__k").isNotNull(), F.col("model")).otherwise(undated(F.col("model")))).drop("__k")
    listed = keyed.join(known.withColumnRenamed("__k", "__l"), F.col("__key") == F.col("__l"), "left")
    valid = (F.col("__from").isNull() | (F.col("__from") <= F.col("at"))) & (F.col("__until").isNull() | (F.col("at") < F.col("__until")))
    joined = listed.join(names, (F.col("__key") == F.col("__name")) & valid, "left")
    reason = F.when(F.col("__l").isNull(), "unlisted-model").when(F.col("__name").isNull(), "outside-validity")
    return joined.withColumn("price_reason", reason).drop("__key", "__l", "__name", "__from", "__until")


def price_plain(priced: DataFrame) -> DataFrame:
    """``amount_micro``: tokens times price (in millionths a million); 0 tokens need no price; ``missing`` counts categories without."""
    amount, missing = F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in CATEGORIES:
        t, p = F.col(c), F.col(f"p_{c}")
        amount = amount + F.when(t > 0, F.coalesce(t * p, F.lit(0))).otherwise(0)
        missing = missing + F.when(t.isNull() | ((t > 0) & p.isNull()), 1).otherwise(0)
    return priced.withColumns({"amount_micro": amount, "missing": missing})


def ttl_bounds(priced: DataFrame, tokens: str = "cache_write", short: str = "p_write_5m", long: str = "p_write_1h") -> DataFrame:
    """``low, high``: cache writes of unknown life lie between the short and the long price; null without both."""
    both = F.col(short).isNotNull() & F.col(long).isNotNull()
    t = F.coalesce(F.col(tokens), F.lit(0))
    return priced.withColumns(
        {"low": F.when(t == 0, F.lit(0).cast("long")).when(both, t * F.least(short, long)), "high": F.when(t == 0, F.lit(0).cast("long")).when(both, t * F.greatest(short, long))}
    )


def long_context(priced: DataFrame, counted: Column, threshold: int, price: str, dearer: str, inclusive: bool = True) -> DataFrame:
    """``rate``: the dearer price for requests of more than ``threshold`` counted tokens, or of as many if ``inclusive``."""
    passed = counted >= threshold if inclusive else counted > threshold
    return priced.withColumns({"is_long": passed, "rate": F.when(passed, F.col(dearer)).otherwise(F.col(price))})


def in_hours(at: Column, start_minute: int, end_minute: int, weekdays: tuple[int, ...] | None = None) -> Column:
    """Whether a time is in a daily window [start, end), on given weekdays (Monday 0) or all.

    An end that isn't after the start is the next day's: the window belongs to the day it opens on, and equal ends make a whole day.
    """
    minute = F.hour(at) * 60 + F.minute(at)
    day = F.weekday(at)
    if start_minute < end_minute:
        opened = F.when((minute >= start_minute) & (minute < end_minute), day)
    else:
        opened = F.when(minute >= start_minute, day).when(minute < end_minute, (day + 6) % 7)
    return opened.isNotNull() if weekdays is None else F.coalesce(opened.isin(*weekdays), F.lit(False))


def scd2_merge(current: DataFrame, fetched: DataFrame, now: str, key: str = "model", value: str = "price") -> DataFrame:
    """Price history after a fetch: a changed price closes its open row at ``now`` and opens one, new models open one."""
    at = F.lit(now).cast("timestamp_ntz")
    new = fetched.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    joined = current.join(new, F.col(key) == F.col("__k"), "left")
    changed = F.col("until").isNull() & F.col("__k").isNotNull() & ~F.col("__v").eqNullSafe(F.col(value))
    kept = joined.withColumn("until", F.when(changed, at).otherwise(F.col("until"))).select(key, value, "from", "until")
    open_now = current.filter("until IS NULL").select(F.col(key).alias("__o"), F.col(value).alias("__p"))
    opened = new.join(open_now, F.col("__k") == F.col("__o"), "left").filter(~F.col("__v").eqNullSafe(F.col("__p")) | F.col("__o").isNull())
    return kept.unionByName(opened.select(F.col("__k").alias(key), F.col("__v").alias(value), at.alias("from"), F.lit(None).cast("timestamp_ntz").alias("until")))
