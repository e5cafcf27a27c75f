"""Consumption: sums that know who contributed, conventions of counters, withholding and bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

COUNTERS = ("input", "output", "reasoning", "cache_read", "cache_write")

#: What a harness's counters mean. (harness, input counts cache reads, output counts reasoning)
CONVENTIONS = (("claude", False, True), ("codex", True, True), ("opencode", False, False), ("pi", False, True))


def session_usage(requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row for each session: sums of recorded counters (null where none was) and how many requests there are."""
    return requests.groupBy(*(keys or ["session"])).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("requests"))


def usage_by(usage: DataFrame, dims: list[str]) -> DataFrame:
    """Groups with, for each counter, its sum over sessions that recorded it and how many did; null is a group."""
    return usage.groupBy(*dims).agg(
        F.count("*").alias("sessions"),
        *[F.sum(c).alias(c) for c in COUNTERS],
        *[F.count(c).alias(f"{c}_sessions") for c in COUNTERS],
    )


def usage_with_total(usage: DataFrame, dims: list[str], counters: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Groups and the grand total in one pass; ``is_total`` tells the total from a null group."""
    cube = usage.groupingSets([[F.col(d) for d in dims], []], *[F.col(d) for d in dims])
    return cube.agg((F.grouping_id() > 0).alias("is_total"), F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in counters])


def coverage(usage: DataFrame, dims: list[str]) -> DataFrame:
    """How many sessions have every counter, some, or none."""
    have = sum((F.col(c).isNotNull().cast("int") for c in COUNTERS), F.lit(0))
    return usage.groupBy(*dims).agg(
        F.count_if(have == len(COUNTERS)).alias("complete"),
        F.count_if((have > 0) & (have < len(COUNTERS))).alias("partial"),
        F.count_if(have == 0).alias("absent"),
    )


def disjoint(requests: DataFrame) -> DataFrame:
    """Counters that don't overlap, by the harness's convention; null where they can't be told.

    Where input counts cache reads, uncached input is known only with no cache writes and input at
    least the reads. Where output leaves reasoning out, both are needed. Reasoning above output is
    dropped. The total needs all four categories.
    """
    spark = requests.sparkSession
    rules = spark.createDataFrame(list(CONVENTIONS), "harness string, __reads boolean, __reasoned boolean")
    joined = requests.join(F.broadcast(rules), "harness", "left")  # four rows
    plain = F.when((F.col("cache_write") == 0) & (F.col("input") >= F.col("cache_read")), F.col("input") - F.col("cache_read"))
    uncached = F.when(F.col("__reads"), plain).when(~F.col("__reads"), F.col("input"))
    output = F.when(F.col("__reasoned"), F.col("output")).when(~F.col("__reasoned"), F.col("output") + F.col("reasoning"))
    made = joined.withColumns({"d_uncached": uncached, "d_output": output}).withColumns(
        {
            "d_reasoning": F.when(F.col("reasoning") <= F.col("d_output"), F.col("reasoning")),
            "d_total": F.col("d_uncached") + F.col("cache_read") + F.col("cache_write") + F.col("d_output"),
        }
    )
    return made.drop("__reads", "__reasoned")


def disjoint_sums(parts: DataFrame, dims: list[str]) -> DataFrame:
    """Sums of disjoint categories; the total only where every request has all four."""
    return parts.groupBy(*dims).agg(
        F.count("*").alias("requests"),
        *[F.sum(c).alias(c) for c in ("d_uncached", "d_output", "d_reasoning")],
        F.sum("cache_read").alias("d_cache_read"),
        F.sum("cache_write").alias("d_cache_write"),
        F.when(F.bool_and(F.col("d_total").isNotNull()), F.sum("d_total")).alias("d_total"),
    )


def withheld(usage: DataFrame, dims: list[str], domain: str = "harness", counter: str = "input") -> DataFrame:
    """A group's sum, null with ``mixed`` set where it would add counters of more than one domain."""
    mixed = F.count_distinct(domain) > 1
    return usage.groupBy(*dims).agg(F.count("*").alias("sessions"), mixed.alias("mixed"), F.when(~mixed, F.sum(counter)).alias(counter))


def identity_bounds(usage: DataFrame, unit: str, dims: list[str], counter: str = "input") -> DataFrame:
    """Bounds where sessions of one unit may hold the same consumption: the largest of each unit, and all if complete."""
    units = usage.groupBy(*dims, unit).agg(F.max(counter).alias("m"), F.sum(counter).alias("s"), F.bool_and(F.col(counter).isNotNull()).alias("all"))
    return units.groupBy(*dims).agg(F.sum("m").alias("at_least"), F.when(F.bool_and("all"), F.sum("s")).alias("at_most"))


def fold_requests(records: DataFrame, keys: list[str]) -> DataFrame:
    """One figure for each request: in record order, a later one replaces the held only if it dominates it.

    Dominating means at least as much of each counter that the held one has. A maximum of each
    counter would mix figures that contradict one another. Each figure depends on all before it: requests are folded as
    the shuffle sorted them, with one row for state, and none is ever held whole.
    """
    given = records.select(*keys, "ordinal", *COUNTERS)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.repartition(parts, *keys).sortWithinPartitions(*keys, "ordinal")
    schema = T.StructType([*(given.schema[k] for k in keys), T.StructField("records", T.LongType()), *(T.StructField(c, T.LongType()) for c in COUNTERS)])
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, (), 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    if key is not None:
                        out.append((*key, seen, *held))
                    key, held, seen = row[:n], row[n + 1 :], 1
                    continue
                seen += 1
                new = row[n + 1 :]
                if all(a is None or (b is not None and b >= a) for a, b in zip(held, new)):
                    held = new
            yield made(out)
        if key is not None:
            yield made([(*key, seen, *held)])

    fields = to_arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in fields], fields)], names=fields.names)

    return ordered.mapInArrow(fold, schema)


def classify_totals(records: DataFrame, keys: list[str], counters: tuple[str, ...] = COUNTERS, bounded: bool = False) -> DataFrame:
    """Rows of running totals with ``classification``, ``counted`` and ``epoch`` (resets so far).

    ``records``: keys, ordinal, the totals ``total_<counter>`` and the last request's ``last_<counter>``, null where not
    recorded. A row without any total speaks of quota alone. Against the total before it, over the counters both have: any
    fall is a reset, else any rise an advance, else it is unchanged, and with none in common incomplete. An advance or a
    reset counts one request where the last usage is recorded. The first total counts only if it equals the last usage
    in a read from the start; else requests before it are uncounted.
    """
    totals, lasts = [f"total_{c}" for c in counters], [f"last_{c}" for c in counters]
    recorded = F.coalesce(*[F.col(c) for c in totals]).isNotNull()
    last = F.coalesce(*[F.col(c) for c in lasts]).isNotNull()
    by = Window.partitionBy(*keys, "__any").orderBy("ordinal")
    marked = records.withColumn("__any", recorded).withColumns({"__first": F.row_number().over(by) == 1, **{f"__{c}": F.lag(c).over(by) for c in totals}})
    moves = [(F.col(c) - F.col(f"__{c}")) for c in totals]
    alike = F.lit(True)
    for a, b in zip(totals, lasts):
        alike = alike & F.col(a).eqNullSafe(F.col(b))
    alone = F.lit(not bounded) & last & alike
    kind = (
        F.when(~F.col("__any"), "quota-only")
        .when(F.col("__first"), F.when(alone, "advance").otherwise("leading-uncounted"))
        .when(F.coalesce(*moves).isNull(), "incomplete")
        .when(F.least(F.lit(0), *moves) < 0, "reset-advance")
        .when(F.greatest(F.lit(0), *moves) > 0, "advance")
        .otherwise("unchanged-total")
    )
    judged = marked.withColumn("classification", kind).withColumn("counted", F.col("classification").isin("advance", "reset-advance") & last)
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return judged.withColumn("epoch", F.sum((F.col("classification") == "reset-advance").cast("long")).over(before)).drop("__any", "__first", *[f"__{c}" for c in totals])


def totals_accounting(classified: DataFrame, keys: list[str], counters: tuple[str, ...] = COUNTERS, bounded: bool = False) -> DataFrame:
    """The newest total of each session, its requests by class, and what it covers: since-reset, read-window or session."""
    last = [f"last_{c}" for c in counters]
    return classified.groupBy(*keys).agg(
        *[F.max_by(f"total_{c}", F.when(F.col("classification") != "quota-only", F.col("ordinal"))).alias(c) for c in counters],
        F.count_if("counted").alias("requests"),
        *[F.sum(F.when(F.col("counted"), F.col(c))).alias(f"requests_{c[5:]}") for c in last],
        *[F.count_if(F.col("classification") == k).alias(k.replace("-", "_")) for k in ("leading-uncounted", "reset-advance", "unchanged-total", "incomplete", "quota-only")],
        F.when(F.bool_or(F.col("classification") == "reset-advance"), "since-reset").otherwise("read-window" if bounded else "session").alias("coverage"),
    )


def as_of(records: DataFrame, keys: list[str], value: str) -> Column:
    """The last known ``value`` at or before each record, in record order."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))


def reconcile(recorded: DataFrame, summed: DataFrame, keys: list[str], counter: str = "input") -> DataFrame:
    """Recorded totals against the sum of identified requests: the difference and what it says."""
    a = recorded.select(*keys, F.col(counter).alias("recorded"))
    b = summed.select(*keys, F.col(counter).alias("summed"))
    both = a.join(b, keys, "full").withColumn("difference", F.col("recorded") - F.col("summed"))
    status = F.when(F.col("difference").isNull(), "unestablished").when(F.col("difference") == 0, "equal").when(F.col("difference") > 0, "total-above").otherwise("requests-above")
    return both.withColumn("status", status)


def cache_ratios(usage: DataFrame, dims: list[str]) -> DataFrame:
    """Cache reads and writes over all prompt tokens; null unless every request recorded all three and there are any."""
    whole = ["input", "cache_read", "cache_write"]
    sums = usage.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in whole], F.bool_and(F.col("input").isNotNull() & F.col("cache_read").isNotNull() & F.col("cache_write").isNotNull()).alias("__all"))
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    told = F.col("__all") & (prompt > 0)
    return sums.select(*dims, F.when(told, F.col("cache_read") / prompt).alias("read_ratio"), F.when(told, F.col("cache_write") / prompt).alias("write_ratio"))


def distinct_models(requests: DataFrame, keys: list[str], most: int = 32) -> DataFrame:
    """``models`` (joined by commas, the first ``most`` by name), how many there are, and whether a session mixes them.

    Models are made distinct before they are gathered; the list's length is bounded by ``most``.
    """
    named = requests.filter(F.col("model").isNotNull()).select(*keys, "model").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("model"))
    counted = named.withColumns({"__n": rank, "__all": F.count("*").over(Window.partitionBy(*keys))}).filter(F.col("__n") <= most)
    return counted.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"), F.max("__all").alias("n_models"), (F.max("__all") > 1).alias("mixed")
    )
