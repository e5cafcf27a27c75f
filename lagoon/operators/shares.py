"""Whole numbers divided without loss, and how much of a quota each session used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apportion(weights: DataFrame, keys: list[str], weight: str, total: int, order: str) -> DataFrame:
    """Shares of ``total`` by largest remainder, ties to the earlier; with no weight at all the first takes everything."""
    by = Window.partitionBy(*keys)
    summed = weights.withColumn("__sum", F.sum(weight).over(by)).withColumn("__pos", F.row_number().over(by.orderBy(order)))
    exact = summed.withColumns(
        {"__floor": F.expr(f"CASE WHEN __sum > 0 THEN ({total} * {weight}) div __sum ELSE 0 END"), "__rest": F.expr(f"CASE WHEN __sum > 0 THEN ({total} * {weight}) % __sum ELSE 0 END")}
    )
    left = exact.withColumn("__left", F.lit(total) - F.sum("__floor").over(by)).withColumn("__rank", F.row_number().over(by.orderBy(F.desc("__rest"), "__pos")))
    share = F.when(F.col("__sum") > 0, F.col("__floor") + (F.col("__rank") <= F.col("__left")).cast("long")).otherwise(F.when(F.col("__pos") == 1, F.lit(total)).otherwise(0))
    return left.withColumn("share", share.cast("long")).drop("__sum", "__pos", "__floor", "__rest", "__left", "__rank")


def even_split(parts: DataFrame, keys: list[str], amount: str, order: str) -> DataFrame:
    """An amount split evenly over a group's rows; the first ones get what is left."""
    by = Window.partitionBy(*keys)
    n, i = F.count("*").over(by), F.row_number().over(by.orderBy(order)) - 1
    counted = parts.withColumns({"__n": n, "__i": i})
    return counted.withColumn("share", F.expr(f"{amount} div __n + CAST(__i < {amount} % __n AS BIGINT)")).drop("__n", "__i")


def conserved(parts: DataFrame, whole: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Whether parts add up to the whole: null with requests makes the sum unknown, null without counts 0."""
    summed = parts.groupBy(*keys).agg(
        F.when(F.count_if(F.col(counter).isNull() & (F.col("requests") > 0)) == 0, F.coalesce(F.sum(counter), F.lit(0))).alias("parts")
    )
    both = whole.select(*keys, F.col(counter).alias("whole")).join(summed, keys, "left")
    status = F.when(F.col("parts").isNull() | F.col("whole").isNull(), "unestablished").when(F.col("parts") == F.col("whole"), "conserved").otherwise("not-conserved")
    return both.withColumn("status", status)


def quota_chains(observations: DataFrame, pool: list[str], percent: str = "percent", jitter_s: int = 60) -> DataFrame:
    """Chains of a pool's observations, one for each window period: ``chain, stale, rise``.

    ``observations``: pool, at, percent, resets_at. They are made distinct and stand by time, then percent. A reset more than
    ``jitter_s`` seconds from the one before begins a period, as does a reset recorded on one of two alone. Inside
    a period with a recorded reset a percent below the highest before it is stale: an old snapshot that belongs to no
    chain. Where no reset is recorded a fall begins a chain. ``rise`` is what the chain's next observation adds.
    """
    by = Window.partitionBy(*pool).orderBy("at", percent)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    seen = observations.select(*pool, "at", percent, "resets_at").distinct()
    before = F.lag("resets_at").over(by)
    apart = F.abs(F.unix_micros(F.col("resets_at").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) >= (jitter_s + 1) * 1_000_000
    begins = F.when(F.row_number().over(by) == 1, False).when(F.col("resets_at").isNull() & before.isNull(), F.col(percent) < F.lag(percent).over(by)).otherwise(F.coalesce(apart, F.lit(True)))
    placed = seen.withColumn("__new", begins.cast("long")).withColumn("chain", F.sum("__new").over(upto)).drop("__new")
    inside = Window.partitionBy(*pool, "chain").orderBy("at", percent)
    highest = F.max(percent).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    judged = placed.withColumn("stale", F.coalesce(F.col("resets_at").isNotNull() & (F.col(percent) < highest), F.lit(False)))
    live = Window.partitionBy(*pool, "chain", "stale").orderBy("at", percent)
    return judged.withColumn("rise", F.when(~F.col("stale"), F.lead(percent).over(live) - F.col(percent)))


def chain_intervals(chains: DataFrame, pool: list[str], percent: str = "percent") -> DataFrame:
    """``pool, chain, interval, start, end, rise``: the steps between a chain's observations, stale ones aside."""
    by = Window.partitionBy(*pool, "chain").orderBy("at", percent)
    steps = chains.filter("NOT stale").select(*pool, "chain", F.row_number().over(by).cast("long").alias("interval"), F.col("at").alias("start"), F.lead("at").over(by).alias("end"), "rise")
    return steps.filter("end IS NOT NULL")


def plateau_bounds(chains: DataFrame, pool: list[str], weights: DataFrame, percent: str = "percent") -> DataFrame:
    """``pool, estimate, at_least, at_most``: the percent that a share of each interval stands for, within rounding.

    ``weights``: pool, chain, interval, share. An observation's coefficient is the share of the interval before it
    less that of the one after. A whole percent may stand for half a point less or more, and a run of one whole percent
    moves together: what it can add ranges over the sums of its coefficients from any of its places to its end.
    """
    by = Window.partitionBy(*pool, "chain").orderBy("at", percent)
    numbered = chains.filter("NOT stale").withColumn("__i", F.row_number().over(by).cast("long"))
    shares = weights.select(*pool, "chain", F.col("interval").alias("__k"), F.col("share").alias("__w"))
    spread = (
        numbered.join(shares.withColumnsRenamed({"__k": "__i", "__w": "__after"}), [*pool, "chain", "__i"], "left")
        .join(shares.withColumn("__i", F.col("__k") + 1).drop("__k").withColumnRenamed("__w", "__before"), [*pool, "chain", "__i"], "left")
        .withColumns({"__c": F.coalesce("__before", F.lit(0.0)) - F.coalesce("__after", F.lit(0.0)), "__whole": F.col(percent) == F.floor(percent)})
    )
    begins = F.coalesce((~(F.col("__whole") & F.lag("__whole").over(by) & (F.lag(percent).over(by) == F.col(percent)))).cast("long"), F.lit(1))
    runs = spread.withColumn("__b", begins).withColumn("__run", F.sum("__b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(*pool, "chain", "__run").orderBy("at", percent).rowsBetween(0, Window.unboundedFollowing)
    suffix = runs.withColumn("__s", F.sum("__c").over(down))
    whole = F.bool_and("__whole")
    each = suffix.groupBy(*pool, "chain", "__run").agg(
        F.sum(F.col("__c")).alias("__all"), F.min("__s").alias("__low"), F.max("__s").alias("__high"), whole.alias("__whole"), F.min(percent).alias("__p"),
        F.sum(F.coalesce(F.col("__after") * F.col("rise"), F.lit(0.0))).alias("__e"),
    )
    half = F.when(F.col("__whole"), 0.5).otherwise(0.0)
    base = (F.col("__p") - half) * F.col("__all")
    least = F.when(F.col("__whole"), F.least(F.lit(0.0), "__low")).otherwise(0.0)
    most = F.when(F.col("__whole"), F.greatest(F.lit(0.0), "__high")).otherwise(0.0)
    return each.groupBy(*pool).agg(F.sum("__e").alias("estimate"), F.greatest(F.lit(0.0), F.sum(base + least)).alias("at_least"), F.sum(base + most).alias("at_most"))


def smoothed_shares(parts: DataFrame, pool: list[str]) -> DataFrame:
    """``pool, chain, session, percent``: a session's share of a period's tokens times the rise over the intervals that held any.

    ``parts``: pool, chain, interval, session, tokens, rise (one row for each session and interval with use).
    """
    whole = parts.groupBy(*pool, "chain", "interval").agg(F.sum("tokens").alias("__t"), F.max("rise").alias("__r"))
    period = whole.filter("__t > 0").groupBy(*pool, "chain").agg(F.sum("__t").alias("__all"), F.sum("__r").alias("__rise"))
    spent = parts.groupBy(*pool, "chain", "session").agg(F.sum("tokens").alias("__spent"))
    return spent.join(period, [*pool, "chain"]).select(*pool, "chain", "session", (F.col("__rise") * F.col("__spent") / F.col("__all")).alias("percent"))


def lane_rates(lanes: DataFrame, keys: list[str], now: str, running_minutes: int = 15) -> DataFrame:
    """For each group: lanes counted and left out, median, 90th percentile and maximum of percent and tokens, tokens a percent.

    ``lanes``: keys, session, percent, tokens, last_activity. A lane is left out if its last activity is unknown or within ``running_minutes``
    of ``now`` (it may still run) or if it has no percent. The median is the mean of the middle two, the 90th percentile nearest rank.
    """
    live = F.col("last_activity").isNull() | (F.col("last_activity") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {running_minutes} MINUTE"))
    judged = lanes.withColumn("__out", live | F.col("percent").isNull())
    by = Window.partitionBy(*keys).orderBy("percent", "session")
    n = F.count("*").over(Window.partitionBy(*keys))
    kept = judged.filter("NOT __out").withColumns({"__k": F.row_number().over(by), "__n": n})
    middle = F.avg(F.when((F.col("__k") * 2 >= F.col("__n")) & (F.col("__k") * 2 <= F.col("__n") + 2), F.col("percent")))
    figures = kept.groupBy(*keys).agg(
        F.count("*").alias("lanes"),
        middle.alias("median"),
        F.min(F.when(F.col("__k") * 10 >= F.col("__n") * 9, F.col("percent"))).alias("p90"),
        F.max("percent").alias("max"),
        F.when(F.sum("percent") > 0, F.sum("tokens") / F.sum("percent")).alias("tokens_per_percent"),
    )
    left = judged.groupBy(*keys).agg(F.count_if("__out").alias("excluded"))
    return left.join(figures, keys, "left").withColumn("lanes", F.coalesce("lanes", F.lit(0)))


def allowance_shares(intervals: DataFrame, uses: DataFrame, pool: str = "pool") -> DataFrame:
    """Each session's part of each interval's rise, by its tokens in (start, end]; what nobody used stays without session.

    Uses meet intervals by pool and day, so a pool that holds most of the rows is spread over its
    days; an interval has one row for each day it touches.
    """
    daily = intervals.select(pool, "interval", "start", "end", "rise", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("__day"))
    met = uses.withColumn("__day", F.to_date("at")).join(daily, [pool, "__day"]).filter((F.col("at") > F.col("start")) & (F.col("at") <= F.col("end")))
    by_session = met.groupBy(pool, "interval", "session").agg(F.sum("tokens").alias("tokens"), F.max("rise").alias("rise"))
    whole = by_session.groupBy(pool, "interval").agg(F.sum("tokens").alias("__whole"))
    shared = by_session.join(whole, [pool, "interval"]).withColumn("share", F.when(F.col("__whole") > 0, F.col("rise") * F.col("tokens") / F.col("__whole")))
    unused = intervals.join(whole, [pool, "interval"], "left_anti")
    return shared.select(pool, "interval", "session", "tokens", "share").unionByName(
        unused.select(pool, "interval", F.lit(None).cast("long").alias("session"), F.lit(0).cast("long").alias("tokens"), F.col("rise").alias("share"))
    )


def forecast(plans: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """``need, remaining, fits``: planned lanes times the percent a lane takes against what is left of the pool.

    ``plans``: keys, lanes, used (percent; whole ones may be half a point off). ``rates``: keys, low and
    high percent of a lane. ``fits`` is yes if even the most needed fits in the least left, no if the
    least needed is above the most left, else maybe; unmeasured where no rate is known.
    """
    half = F.when(F.col("used") == F.floor("used"), 0.5).otherwise(0.0)
    met = plans.join(rates, keys, "left").withColumns({
        "need_low": F.col("lanes") * F.col("low"), "need_high": F.col("lanes") * F.col("high"),
        "left_low": F.greatest(F.lit(0.0), 100.0 - F.col("used") - half), "left_high": F.least(F.lit(100.0), 100.0 - F.col("used") + half),
    })
    fits = (
        F.when(F.col("low").isNull() | F.col("high").isNull(), "unmeasured")
        .when(F.col("need_high") <= F.col("left_low"), "yes")
        .when(F.col("need_low") > F.col("left_high"), "no")
        .otherwise("maybe")
    )
    return met.select(*keys, "lanes", "used", "need_low", "need_high", "left_low", "left_high", fits.alias("fits"))


def measured_lanes(chains: DataFrame, uses: DataFrame, sessions: DataFrame, pool: str = "pool") -> DataFrame:
    """``pool, session, percent, tokens, last_activity``: what each session took of a pool's recorded rises, by its tokens in each of their intervals.

    ``chains`` as of ``quota_chains`` by the pool alone; ``uses``: pool, session, at, tokens; ``sessions``: session, last_activity. A session without use in any interval is no lane.
    """
    steps = chain_intervals(chains, [pool]).select(pool, F.expr("chain * 4294967296 + interval").alias("interval"), "start", "end", "rise")
    shared = allowance_shares(steps, uses, pool).filter("session IS NOT NULL")
    each = shared.groupBy(pool, "session").agg(F.sum("share").alias("percent"), F.sum("tokens").alias("tokens"))
    return each.join(sessions.select("session", "last_activity"), "session", "left").select(pool, "session", "percent", "tokens", "last_activity")


def measured_forecast(observations: DataFrame, uses: DataFrame, sessions: DataFrame, plans: DataFrame, now: str, pool: str = "pool") -> DataFrame:
    """``forecast`` of planned lanes (pool, lanes) from a pool's own records: chains, their intervals, what sessions took of them, the rates of finished lanes, and the newest percent.

    A lane is taken to need between the median and the 90th percentile of those that have ended. A pool with no finished lane is unmeasured; one without an observation has no row.
    """
    chains = quota_chains(observations, [pool])
    rates = lane_rates(measured_lanes(chains, uses, sessions, pool), [pool], now).select(pool, F.col("median").alias("low"), F.col("p90").alias("high"))
    newest = chains.filter("NOT stale").groupBy(pool).agg(F.max_by("percent", F.struct("at", "percent")).alias("used"))
    return forecast(plans.join(newest, pool), rates, [pool])
