"""Requests in spans of time and in ranges of requests; windows; quota windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.lineage import root_of


def place_requests(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """Requests with the spans [from, to) that hold them; those in none have span -1, untimed ones -2.

    ``spans``: span_id, from, to; null ends are open. Both sides are dealt by day, open ends up to the first and last request,
    so any number of spans meets the requests by key; a request may stand in several.
    """
    ends = requests.agg(F.min("at").alias("__first"), F.max("at").alias("__last"))
    opened = spans.select("span_id", "from", "to").crossJoin(F.broadcast(ends))  # the ends are one row
    begin, stop = F.greatest(F.to_date("from"), F.to_date("__first")), F.least(F.to_date("to"), F.to_date("__last"))
    days = opened.filter(begin <= stop).select("span_id", "from", "to", F.explode(F.sequence(begin, stop)).alias("__day"))
    hit = (F.col("from").isNull() | (F.col("at") >= F.col("from"))) & (F.col("to").isNull() | (F.col("at") < F.col("to")))
    dated = requests.withColumn("__on", F.to_date("at"))
    joined = dated.join(days, (F.col("__on") == F.col("__day")) & hit, "left")
    return joined.withColumn("span_id", F.when(F.col("at").isNull(), -2).otherwise(F.coalesce("span_id", F.lit(-1)))).drop("from", "to", "__on", "__day")


def span_usage(requests: DataFrame, spans: DataFrame, counters: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Consumption of each span and of the remainder."""
    return place_requests(requests, spans).groupBy("span_id").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in counters])


def request_range(requests: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Requests numbered first to last, both included; an end may be open."""
    n = F.col("ordinal")
    return requests.filter((n >= first if first is not None else F.lit(True)) & (n <= last if last is not None else F.lit(True)))


def window_usage(requests: DataFrame, sessions: DataFrame, start: str, end: str, dims: list[str]) -> DataFrame:
    """Consumption in [start, end) by dimensions of the session; the filter reaches the scan of requests."""
    inside = requests.filter((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz")))
    return inside.join(sessions, "session").groupBy(*dims).agg(
        F.count("*").alias("requests"), F.count_distinct("session").alias("sessions"), F.sum("input").alias("input"), F.sum("output").alias("output")
    )


def window_families(requests: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """``session, share, reached, requests, sessions, input, output``: what each listed session consumed in [start, end) itself and through its subagents.

    ``sessions``: session, parent, subagent (such recordings are listed by no one but their parent), carried_from (the session that a subagent was carried over from, its parent then).
    Subagents that consumed in the window bring in their parents, those theirs if they are subagents themselves, up to a listed session; shares are ``own``, ``subagents`` and, of subagents whose chain ends at none, ``unclaimed`` (under
    the last name of the chain). ``reached`` tells how a session comes into the view: ``window`` by its own requests, ``subagents`` only by theirs. The shares add up to the window's whole.
    """
    inside = requests.filter((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz")))
    used = inside.groupBy("session").agg(F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))
    above = F.when(F.coalesce("subagent", F.lit(False)), F.coalesce("carried_from", "parent"))
    chain = sessions.select("session", above.alias("parent"))
    tops = root_of(chain).select(F.col("session").alias("s"), "root")
    kinds = sessions.select(F.col("session").alias("k"), F.coalesce("subagent", F.lit(False)).alias("subagent"))
    placed = used.join(tops, F.col("session") == F.col("s"), "left").withColumn("root", F.coalesce("root", "session"))
    placed = placed.join(kinds, F.col("root") == F.col("k"), "left")
    share = F.when(F.coalesce("subagent", F.lit(False)), "unclaimed").when(F.col("session") == F.col("root"), "own").otherwise("subagents")
    rows = placed.withColumn("share", share).groupBy(F.col("root").alias("session"), "share").agg(
        F.sum("requests").alias("requests"), F.count("*").alias("sessions"), F.sum("input").alias("input"), F.sum("output").alias("output")
    )
    own = rows.filter("share = 'own'").select(F.col("session").alias("o"))
    told = rows.join(own, F.col("session") == F.col("o"), "left")
    return told.select("session", "share", F.when(F.col("o").isNotNull(), "window").otherwise("subagents").alias("reached"), "requests", "sessions", "input", "output")


def stretch_of(requests: DataFrame, stretches: DataFrame, keys: list[str]) -> DataFrame:
    """The latest stretch that began at or before each request, or the first one: an as-of join by one ordered union."""
    points = requests.select(*keys, F.col("at").alias("__t"), F.lit(1).alias("__kind"), F.struct(*[F.col(c) for c in requests.columns]).alias("__row"), F.lit(None).cast("long").alias("__s"))
    starts = stretches.select(*keys, F.col("first").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(points.schema["__row"].dataType).alias("__row"), F.col("stretch").cast("long").alias("__s"))
    by = Window.partitionBy(*keys).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min_by("__s", F.when(F.col("__kind") == 0, F.col("__t"))).over(Window.partitionBy(*keys))
    seen = F.coalesce(F.last("__s", ignorenulls=True).over(by), first)
    return points.unionByName(starts).withColumn("stretch", seen).filter("__kind = 1").select("__row.*", "stretch")


def quota_window(observations: DataFrame, instant: str) -> DataFrame:
    """For each pool the window that holds the instant: ``window_from, window_to, boundary`` and its observation.

    Of observations whose window [resets_at - length, resets_at) holds the instant the newest one speaks (recorded); without any, the newest whose
    window ended before it by less than its length: the window that follows is inferred. A pool with neither gives no row.
    """
    at = F.lit(instant).cast("timestamp_ntz")
    length = F.make_dt_interval(mins=F.col("window_minutes"))
    start, end = F.col("resets_at") - length, F.col("resets_at")
    inferred = (end <= at) & (at < end + length)
    held = observations.withColumn("__follows", F.when((start <= at) & (at < end), 0).when(inferred, 1)).filter("__follows IS NOT NULL")
    newest = F.row_number().over(Window.partitionBy("pool").orderBy("__follows", F.desc("observed_at"), F.desc("resets_at"), F.desc("ordinal")))
    follows = F.col("__follows") == 1
    return (
        held.withColumn("__n", newest)
        .filter("__n = 1")
        .withColumns({"window_from": F.when(follows, end).otherwise(start), "window_to": F.when(follows, end + length).otherwise(end), "boundary": F.when(follows, "inferred").otherwise("recorded")})
        .drop("__n", "__follows")
    )


def may_hold(sessions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Sessions that may hold requests in [start, end): unknown times pass."""
    began, last = F.col("started"), F.col("last_activity")
    if start is not None:
        sessions = sessions.filter(last.isNull() | (last >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        sessions = sessions.filter(began.isNull() | (began < F.lit(end).cast("timestamp_ntz")))
    return sessions


def ambiguous(requests: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``span_id, unplaced``: untimed requests that each span may hold, between the times of their timed neighbours; -1 is the remainder.

    A request between times a and b may be in a span if a is before its end and b is not before its start; it is
    surely in it if both neighbours are. One that is surely in no span may be the remainder's.
    """
    by = Window.partitionBy(*keys).orderBy("ordinal")
    near = requests.withColumns({"__a": F.last("at", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.first("at", True).over(by.rowsBetween(0, Window.unboundedFollowing))}).filter("at IS NULL")
    low, high = F.col("from"), F.col("to")
    may = (F.col("__a").isNull() | high.isNull() | (F.col("__a") < high)) & (F.col("__b").isNull() | low.isNull() | (F.col("__b") >= low))
    sure = (low.isNull() | (F.col("__a") >= low)) & (high.isNull() | (F.col("__b") < high))
    # spans are a list that a person gives; untimed requests are few, and those between the same times are one row
    grouped = near.groupBy("__a", "__b").agg(F.count("*").alias("__n"))
    listed = F.collect_list(F.struct("span_id", "from", "to"))
    met = grouped.crossJoin(F.broadcast(spans.agg(listed.alias("__spans"))))  # one row: the list
    each = met.select("__a", "__b", "__n", F.explode("__spans").alias("s")).select("__a", "__b", "__n", "s.*").withColumns({"__may": may, "__sure": F.coalesce(sure, F.lit(False))})
    rest = each.groupBy("__a", "__b", "__n").agg(F.bool_or("__sure").alias("__sure")).filter("NOT __sure").select(F.lit(-1).alias("span_id"), "__n")
    return each.filter("__may").select("span_id", "__n").unionByName(rest).groupBy("span_id").agg(F.sum("__n").alias("unplaced"))


def largest_shares(shares: DataFrame, most: int) -> DataFrame:
    """The ``most`` sessions that consumed most, with their ``place``; ties by id. Each task keeps its own best before they meet."""
    top = shares.orderBy(F.desc("consumed"), "session").limit(most)
    # ``most`` rows
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("consumed"), "session")).cast("long"))
