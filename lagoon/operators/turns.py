"""Ordered analytics over turns: timelines, kinds, titles, stretches, durations, spans of one model, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.sources.recordings import without_envelopes

SESSION = ["harness", "session"]

#: The kinds of a turn, in order of output.
KINDS = ("operator", "assistant", "reasoning", "tool", "control", "ambient", "notice", "unknown")


def recorded(*keys: str) -> Window:
    """A session's records in recording order."""
    return Window.partitionBy(*(keys or SESSION)).orderBy("ordinal")


def timeline(turns: DataFrame) -> DataFrame:
    return turns.select(*SESSION, "ordinal", "kind", "ts")


def count_kinds(turns: DataFrame) -> DataFrame:
    """A column for each kind and the total."""
    return turns.groupBy(*SESSION).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.count("*").alias("total"))


def select_kinds(turns: DataFrame, only: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Turns of the kinds asked for, and how many of each other kind were left out."""
    kept = turns.filter(F.col("kind").isin(*only))
    return kept, turns.filter(~F.col("kind").isin(*only)).groupBy(*SESSION, "kind").agg(F.count("*").alias("omitted"))


def tail(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each session with their own ordinals."""
    last = F.row_number().over(Window.partitionBy(*SESSION).orderBy(F.desc("ordinal")))
    return turns.withColumn("__n", last).filter(F.col("__n") <= n).drop("__n")


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``position``: their place in the session from 0, without gaps."""
    return turns.withColumn("position", (F.row_number().over(Window.partitionBy(*SESSION).orderBy("ordinal")) - 1).cast("long"))


def capped(turns: DataFrame, chars: int) -> DataFrame:
    """Text cut to ``chars`` characters, with its whole length and whether it was cut."""
    n = F.length("text")
    return turns.withColumns({"text_chars": n.cast("long"), "text_truncated": n > chars}).withColumn("text", F.substring("text", 1, chars))


def title(text: Column, chars: int = 96) -> Column:
    """A text without the blocks a harness put around it, space collapsed and cut to ``chars`` with an ellipsis; null where nothing is left."""
    flat = F.trim(F.regexp_replace(without_envelopes(text), r"[ \t\r\n]+", " "))
    cut = F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars - 1), F.lit("…"))).otherwise(flat)
    return F.when(F.length(flat) > 0, cut)


def titles(turns: DataFrame, chars: int = 96) -> DataFrame:
    """The first operator turn of each session that yields a title."""
    named = turns.filter("kind = 'operator'").withColumn("title", title(F.col("text"), chars)).filter("title IS NOT NULL")
    return named.groupBy(*SESSION).agg(F.min_by("title", "ordinal").alias("title"))


def _gap_ms(by: Window) -> Column:
    """Milliseconds since the stamp before in record order."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return F.floor((micros - F.lag(micros).over(by)) / 1000)


def with_stretch(turns: DataFrame, idle_ms: int = 2_700_000) -> DataFrame:
    """Stamped turns with the number of their working stretch: a gap above ``idle_ms`` starts a new one; equal or negative gaps don't."""
    stamped = turns.filter("ts IS NOT NULL").withColumn("__gap", _gap_ms(recorded()))
    return stamped.withColumn("stretch", F.sum(F.when(F.col("__gap") > idle_ms, 1).otherwise(0)).over(recorded().rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")


def stretches(turns: DataFrame, idle_ms: int = 2_700_000) -> DataFrame:
    """Working stretches with their first and last time."""
    return with_stretch(turns, idle_ms).groupBy(*SESSION, "stretch").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("turns"))


def active_time(turns: DataFrame, idle_ms: int = 2_700_000) -> DataFrame:
    """Sum of gaps from 0 to ``idle_ms``, the longest gap and the span; null with fewer than two stamps."""
    stamped = turns.filter("ts IS NOT NULL").withColumn("__gap", _gap_ms(recorded()))
    gap = F.col("__gap")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    enough = F.count("*") >= 2
    return stamped.groupBy(*SESSION).agg(
        F.when(enough, F.coalesce(F.sum(F.when((gap >= 0) & (gap <= idle_ms), gap)), F.lit(0))).alias("active_ms"),
        F.max(F.when(gap >= 0, gap)).alias("max_gap_ms"),
        F.when(enough, F.floor((F.max_by(micros, "ordinal") - F.min_by(micros, "ordinal")) / 1000)).alias("span_ms"),
    )


def response_times(turns: DataFrame) -> DataFrame:
    """``duration_ms`` of each assistant turn since the record before; negative ones are left out."""
    stamped = turns.filter("ts IS NOT NULL").withColumn("duration_ms", _gap_ms(recorded()))
    return stamped.filter("kind = 'assistant' AND duration_ms >= 0").select(*SESSION, "ordinal", "duration_ms")


def nearest_ranks(values: DataFrame, keys: list[str], column: str, percents: tuple[int, ...] = (50, 90)) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(n p / 100); with count and maximum.

    Equal values are counted first, so ranks come from running counts of distinct values.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__c"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumns({"__upto": F.sum("__c").over(by.orderBy(column)), "__n": F.sum("__c").over(by)})
    return ranked.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        *[F.min(F.when(F.col("__upto") * 100 >= F.col("__n") * p, F.col(column))).alias(f"p{p}") for p in percents],
        F.max(column).alias("max"),
    )


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of equal ``value`` in record order: number, first and last ordinal, size."""
    by = recorded(*keys)
    started = F.when(F.row_number().over(by) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(by)), 0).otherwise(1)
    runs = rows.withColumn("__new", started).withColumn("span", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "span").agg(
        F.min_by(value, "ordinal").alias(value), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("size")
    )


def changes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Only rows where ``value`` differs from the row before; the first row of a session counts."""
    by = recorded(*keys)
    marked = rows.withColumns({"__first": F.row_number().over(by) == 1, "__same": F.col(value).eqNullSafe(F.lag(value).over(by))})
    return marked.filter("__first OR NOT __same").drop("__first", "__same")


def count_roles(turns: DataFrame, roles: tuple[str, ...] = ("user", "assistant", "system")) -> DataFrame:
    """A column for each role, what has another role, and whether every turn names its role."""
    named = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles]
    other = F.count_if(F.col("role").isNotNull() & ~F.col("role").isin(*roles)).alias("n_other")
    return turns.groupBy(*SESSION).agg(*named, other, (F.count("role") == F.count("*")).alias("complete"))


def newest_texts(turns: DataFrame, chars: int, kinds: tuple[str, ...] = ("operator", "assistant")) -> DataFrame:
    """The newest turn of each kind, its text cut to ``chars`` characters, in one aggregation."""
    newest = turns.filter(F.col("kind").isin(*kinds)).groupBy(*SESSION, "kind").agg(F.max_by(F.struct("ordinal", "text"), "ordinal").alias("__t"))
    return newest.select(*SESSION, "kind", "__t.ordinal", F.substring("__t.text", 1, chars).alias("text"), (F.char_length("__t.text") > chars).alias("cut"))


def recent_within(turns: DataFrame, rows: int, size: int, text: str = "text") -> DataFrame:
    """The newest turns of each session, at most ``rows``, that fit in ``size`` bytes together; ``omitted`` counts the older."""
    by = Window.partitionBy(*SESSION).orderBy(F.desc("ordinal"))
    sized = turns.select(*SESSION, "ordinal", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    counted = sized.withColumns({
        "__n": F.row_number().over(by),
        "__sum": F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0)),
        "__all": F.count("*").over(Window.partitionBy(*SESSION)),
    }).filter((F.col("__n") <= rows) & (F.col("__sum") <= size))
    kept = F.count("*").over(Window.partitionBy(*SESSION))
    return counted.withColumn("omitted", F.col("__all") - kept).drop("__n", "__sum", "__all")


def medians(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``n, median, p90``: the mean of the two middle values, and the nearest rank at nine tenths."""
    by = Window.partitionBy(*keys)
    ranked = values.filter(F.col(column).isNotNull()).withColumns({"__k": F.row_number().over(by.orderBy(column)), "__n": F.count("*").over(by)})
    middle = (2 * F.col("__k") >= F.col("__n")) & (2 * F.col("__k") <= F.col("__n") + 2) & ((F.col("__n") % 2 == 0) | (2 * F.col("__k") == F.col("__n") + 1))
    return ranked.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        F.avg(F.when(middle, F.col(column).cast("double"))).alias("median"),
        F.min(F.when(10 * F.col("__k") >= 9 * F.col("__n"), F.col(column))).alias("p90"),
    )
