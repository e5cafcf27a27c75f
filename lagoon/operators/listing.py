"""Which sessions: predicates, order and limits of listings; search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(
    sessions: DataFrame,
    prefix: str | None = None,
    model: str | None = None,
    launch: str | None = None,
    directory: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Sessions that meet all given conditions; a null never meets one. Case matters in ids alone; times are [since, until)."""
    tests: list[Column] = []
    if prefix is not None:
        tests.append(F.col("session").cast("string").startswith(prefix))
    if model is not None:
        tests.append(F.lower("model").contains(model.lower()))
    if launch is not None:
        tests.append(F.col("launch") == launch)
    if directory is not None:
        tests.append(F.lower("directory").contains(directory.lower()))
    if since is not None:
        tests.append(F.col("last_activity") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        tests.append(F.col("last_activity") < F.lit(until).cast("timestamp_ntz"))
    for test in tests:
        sessions = sessions.filter(test)
    return sessions


def newest_first() -> list[Column]:
    """Newest activity first, unknown last; ties by id, then harness."""
    return [F.col("last_activity").desc_nulls_last(), F.col("session"), F.col("harness")]


def newest_per_harness(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` newest of each harness, with their rank; each task keeps its own best first."""
    rank = F.row_number().over(Window.partitionBy("harness").orderBy(*newest_first()))
    return sessions.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit)


def latest(sessions: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """The newest session that isn't excluded (``exclude`` has harness, session)."""
    left = sessions if exclude is None else sessions.join(exclude, ["harness", "session"], "left_anti")
    return left.orderBy(*newest_first()).limit(1)


def first_store_wins(sessions: DataFrame, rank: str = "store_rank") -> DataFrame:
    """One row for each identity (harness, session): the first store's."""
    by = Window.partitionBy("harness", "session").orderBy(rank)
    return sessions.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def resolve(sessions: DataFrame, query: str) -> DataFrame:
    """Sessions an id query may mean: the exact ones, else those it is a prefix of; ``matches`` says how many."""
    name = F.col("session").cast("string")
    exact = F.when(name == query, 0).when(name.startswith(query), 1)
    found = sessions.withColumn("__class", exact).filter("__class IS NOT NULL")
    best = found.agg(F.min("__class").alias("__best"))
    chosen = found.join(F.broadcast(best), F.col("__class") == F.col("__best")).drop("__class", "__best")  # best is one row
    return chosen.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("matches"))))  # the count is one row


def search_tail(turns: DataFrame, needle: str, tail: int = 32, withheld: DataFrame | None = None) -> DataFrame:
    """``harness, session, hit, searched, partial``: does any of a session's last turns contain the needle, case aside.

    ``withheld`` (harness, session) names the sessions of which the source gave only a part; a search is partial where
    such a session has fewer turns than asked for.
    """
    last = F.row_number().over(Window.partitionBy("harness", "session").orderBy(F.desc("ordinal")))
    ranked = turns.select("harness", "session", "text", "ordinal", last.alias("__n"))
    found = ranked.groupBy("harness", "session").agg(
        F.coalesce(F.bool_or(F.when(F.col("__n") <= tail, F.lower("text").contains(needle.lower()))), F.lit(False)).alias("hit"),
        F.sum((F.col("__n") <= tail).cast("long")).alias("searched"),
        (F.count("*") < tail).alias("__few"),
    )
    if withheld is None:
        return found.select("harness", "session", "hit", "searched", F.lit(False).alias("partial"))
    cut = withheld.select("harness", "session").distinct().withColumn("__cut", F.lit(True))
    return found.join(cut, ["harness", "session"], "left").select("harness", "session", "hit", "searched", (F.col("__few") & F.coalesce("__cut", F.lit(False))).alias("partial"))


def tail_read(turns: DataFrame, most: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(turns, withheld)``: the newest turns of each session that fit in ``most`` bytes, and the sessions of which turns were withheld."""
    by = Window.partitionBy("harness", "session").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, 0)
    summed = turns.withColumn("__bytes", F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).over(by))
    return summed.filter(F.col("__bytes") <= most).drop("__bytes"), summed.filter(F.col("__bytes") > most).select("harness", "session").distinct()


def search_whole(turns: DataFrame, needle: str, cap: int = 100) -> DataFrame:
    """Places of all matching turns, at most ``cap`` a session with ``truncated`` set where there are more."""
    hits = turns.filter(F.lower("text").contains(needle.lower())).select("harness", "session", "ordinal", "role")
    by = Window.partitionBy("harness", "session")
    ranked = hits.withColumn("hit", F.row_number().over(by.orderBy("ordinal")).cast("long")).withColumn("hits", F.count("*").over(by))
    return ranked.filter(F.col("hit") <= cap).withColumn("truncated", F.col("hits") > cap).drop("hits")
