"""Roll-ups of consumption: what covers it, in which basis, for which reasons, by which agents; unions and unexplained parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.usage import COUNTERS


def coverage_class() -> Column:
    """What a session's figure covers: a recorded total, a sum of requests over the session or the part read, what follows a reset, or nothing."""
    recorded = F.coalesce(*[F.col(c) for c in COUNTERS]).isNotNull()
    return (
        F.when(~recorded, "none")
        .when(F.col("coverage") == "since-reset", "since-reset")
        .when(F.col("accounting") == "recorded-total", "recorded-total")
        .when(F.col("coverage") == "read-window", "summed-read-window")
        .otherwise("summed-session")
    )


def coverage_classes(usage: DataFrame, dims: list[str]) -> DataFrame:
    """How many sessions of each group are of each class."""
    names = ("recorded-total", "summed-session", "summed-read-window", "since-reset", "none")
    classed = usage.withColumn("__class", coverage_class())
    return classed.groupBy(*dims).agg(*[F.count_if(F.col("__class") == n).alias(n.replace("-", "_")) for n in names])


def accounting_partitions(usage: DataFrame) -> DataFrame:
    """Subtotals that may be added up: one for each harness and basis of accounting."""
    return usage.groupBy("harness", "accounting").agg(
        F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in COUNTERS], *[F.count(c).alias(f"{c}_sessions") for c in COUNTERS]
    )


def partition_withheld(usage: DataFrame, dims: list[str], counter: str = "input") -> DataFrame:
    """A group's sum and whether it was withheld: more than one native domain, or for the disjoint figure more than one accounting."""
    domains, bases = F.count_distinct("harness"), F.count_distinct("accounting")
    return usage.groupBy(*dims).agg(
        F.count("*").alias("sessions"),
        (domains > 1).alias("mixed_domain"),
        (bases > 1).alias("mixed_accounting"),
        F.when(domains <= 1, F.sum(counter)).alias(counter),
        F.when(bases <= 1, F.sum(counter)).alias(f"disjoint_{counter}"),
    )


def reason_union(reasons: DataFrame, keys: list[str]) -> DataFrame:
    """For each counter of a figure the reasons that qualify it, each once, in order: the union over its members."""
    each = reasons.filter("reason IS NOT NULL").select(*keys, "counter", "reason").distinct()
    return each.groupBy(*keys, "counter").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))


def disjoint_reasons() -> Column:
    """Rows ``counter, reason`` for a request's disjoint categories: what isn't recorded, or contradicts itself."""
    rows = [
        F.when(F.col("input").isNull(), F.struct(F.lit("uncached_input").alias("counter"), F.lit("missing-counter").alias("reason"))),
        F.when((F.col("harness") == "codex") & F.col("input").isNotNull() & (F.coalesce("cache_write", F.lit(1)) != 0), F.struct(F.lit("uncached_input").alias("counter"), F.lit("undetermined").alias("reason"))),
        F.when((F.col("harness") == "codex") & (F.col("input") < F.col("cache_read")), F.struct(F.lit("uncached_input").alias("counter"), F.lit("undetermined").alias("reason"))),
        F.when(F.col("cache_write").isNull(), F.struct(F.lit("cache_write").alias("counter"), F.lit("missing-counter").alias("reason"))),
        F.when(F.col("cache_read").isNull(), F.struct(F.lit("cache_read").alias("counter"), F.lit("missing-counter").alias("reason"))),
        F.when(F.col("output").isNull(), F.struct(F.lit("output").alias("counter"), F.lit("missing-counter").alias("reason"))),
        F.when(F.col("reasoning") > F.col("output"), F.struct(F.lit("reasoning").alias("counter"), F.lit("undetermined").alias("reason"))),
    ]
    return F.array_compact(F.array(*rows))


def ttl_witness(records: DataFrame, keys: list[str]) -> DataFrame:
    """For each request the split of its cache writes by life, ``write_5m, write_1h``, where the records of the kept total agree on one.

    ``records``: keys, ordinal, cache_write (the total), w5, w1 (null where not split). Only splits that add up to the largest
    total recorded bear witness; two that differ, or none, leave the split unrecorded.
    """
    top = records.groupBy(*keys).agg(F.max("cache_write").alias("cache_write"))
    fits = records.filter(F.col("w5") + F.col("w1") == F.col("cache_write")).groupBy(*keys, "cache_write").agg(F.count_distinct("w5", "w1").alias("__n"), F.min("w5").alias("__5"), F.min("w1").alias("__1"))
    met = top.join(fits, [*keys, "cache_write"], "left")
    sole = F.col("__n") == 1
    return met.select(*keys, "cache_write", F.when(sole, F.col("__5")).alias("write_5m"), F.when(sole, F.col("__1")).alias("write_1h"), F.when(F.col("__n").isNull(), "unrecorded").when(sole, "recorded").otherwise("conflict").alias("split"))


def first_of_each(records: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first record of each id in record order; ``repeats`` says how many more there were. Records without an id all stay."""
    by = Window.partitionBy(*keys)
    named = records.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    first = named.withColumns({"__n": F.row_number().over(by.orderBy(order)), "repeats": F.count("*").over(by) - 1}).filter("__n = 1").drop("__n")
    bare = records.filter(" OR ".join(f"{k} IS NULL" for k in keys)).withColumn("repeats", F.lit(0).cast("long"))
    return first.unionByName(bare)


def model_split(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, tokens and how many had no model, by model and variant; ``identity`` is ``id`` or ``id (variant)``."""
    identity = F.when(F.col("variant").isNotNull(), F.concat("model", F.lit(" ("), "variant", F.lit(")"))).otherwise(F.col("model"))
    return requests.groupBy(*keys, "model", "variant").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("input", "output")]).withColumn("identity", identity)


def attribution_coverage(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests observed, with a model and usage, and without."""
    told = F.col("model").isNotNull() & F.coalesce(*[F.col(c) for c in COUNTERS]).isNotNull()
    return requests.groupBy(*keys).agg(F.count("*").alias("observed"), F.count_if(told).alias("attributed"), F.count_if(~told).alias("unattributed"))


def dimension_tally(requests: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """``keys, dimension, value, requests``: how often each value of each dimension of a request stands; nulls aren't counted."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    return requests.select(*keys, each.alias("x")).select(*keys, "x.*").filter("value IS NOT NULL").groupBy(*keys, "dimension", "value").agg(F.count("*").alias("requests"))


def content_inventory(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Content parts by carrier and availability, their bytes, and how many artifacts they name."""
    return parts.groupBy(*keys, "carrier", "availability").agg(F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), F.count("artifact").alias("artifacts"))


def exact_union(pair: DataFrame, events: DataFrame, counter: str = "input") -> DataFrame:
    """``parent, fork, distinct, copies, total``: the consumption of a parent and its fork with copied events counted once.

    ``events``: session, entry, digest, counters. A fork's event is a copy if the parent has the same entry with the same digest; the
    same entry with another digest contradicts, and an event without counter can't be added: the union is withheld with its ``reason``, and
    ``at_least`` (the larger session) and ``at_most`` (both whole, where both are known) bound it.
    """
    of = events.select("session", "entry", "digest", F.col(counter).alias("v"))
    p = pair.join(of, F.col("parent") == F.col("session")).select("parent", "fork", "entry", F.col("digest").alias("d1"), F.col("v").alias("v1"), F.lit(1).alias("in1"))
    f = pair.join(of, F.col("fork") == F.col("session")).select("parent", "fork", "entry", F.col("digest").alias("d2"), F.col("v").alias("v2"), F.lit(1).alias("in2"))
    both = p.join(f, ["parent", "fork", "entry"], "full")
    same = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    copy = same & F.col("d1").eqNullSafe(F.col("d2"))
    value = F.coalesce("v1", "v2")
    made = both.groupBy("parent", "fork").agg(
        F.count("*").alias("distinct"),
        F.count_if(copy).alias("copies"),
        F.count_if(same & ~copy).alias("__conflicts"),
        F.count_if(value.isNull()).alias("__unknown"),
        F.sum(value).alias("__sum"),
        F.greatest(F.sum("v1"), F.sum("v2")).alias("at_least"),
        F.when(F.count_if((F.col("in1").isNotNull() & F.col("v1").isNull()) | (F.col("in2").isNotNull() & F.col("v2").isNull())) == 0, F.coalesce(F.sum("v1"), F.lit(0)) + F.coalesce(F.sum("v2"), F.lit(0))).alias("at_most"),
    )
    reason = F.when(F.col("__conflicts") > 0, "copy-differs").when(F.col("__unknown") > 0, "missing-counter")
    return made.select("parent", "fork", "distinct", "copies", F.when(reason.isNull(), F.col("__sum")).alias("total"), reason.alias("reason"), "at_least", "at_most")


def unexplained(marks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ordinal, part``: where the part of the newest recorded total that no request explains was spent.

    ``marks``: keys (a session and model), ordinal, recorded (the running total at the mark), explained (what requests since the
    mark before spent). The run begins at the last mark where the total fell. The whole is the newest total less all explained of the run, 0 at least; the part
    placed up to a mark is the most, over the marks so far, of its total less what is explained so far, within the whole.
    """
    by = Window.partitionBy(*keys).orderBy("ordinal")
    fell = F.coalesce((F.col("recorded") < F.lag("recorded").over(by)).cast("int"), F.lit(0))
    runs = marks.withColumn("__fell", fell).withColumn("__run", F.sum("__fell").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = runs.withColumn("__last", F.max("__run").over(Window.partitionBy(*keys))).filter(F.col("__run") == F.col("__last"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    held = run.withColumns({"__held": F.sum("explained").over(upto), "__all": F.sum("explained").over(whole), "__newest": F.max_by("recorded", "ordinal").over(whole)})
    u = F.greatest(F.lit(0), F.col("__newest") - F.col("__all"))
    placed = held.withColumn("__u", u).withColumn("__placed", F.least(F.col("__u"), F.greatest(F.lit(0), F.max(F.col("recorded") - F.col("__held")).over(upto))))
    return placed.select(*keys, "ordinal", (F.col("__placed") - F.coalesce(F.lag("__placed").over(by), F.lit(0))).alias("part"))


def family_totals(members: DataFrame, requests: DataFrame) -> DataFrame:
    """``family, agent, role``: sessions, requests and tokens, a request id counted once in its family, for its first member.

    ``members``: family, session, role. ``requests``: session, harness, model, variant, id, at, counters. An agent is ``harness:model#variant``.
    """
    agent = F.concat("harness", F.lit(":"), F.coalesce("model", F.lit("unknown")), F.when(F.col("variant").isNotNull(), F.concat(F.lit("#"), "variant")).otherwise(""))
    joined = requests.join(members, "session").withColumn("agent", agent)
    rank = F.row_number().over(Window.partitionBy("family", "id").orderBy(F.col("at").asc_nulls_last(), "session", "ordinal"))
    once = joined.withColumn("__n", F.when(F.col("id").isNull(), 1).otherwise(rank)).filter("__n = 1")
    return once.groupBy("family", "agent", "role").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def stats_summary(turns: DataFrame, paired: DataFrame) -> DataFrame:
    """For each harness: sessions, turns by kind, tool calls, pairs and errors over a selection."""
    kinds = turns.groupBy("harness").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("turns"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("operator", "assistant", "tool", "notice", "unknown")])
    call = F.col("direction") == "call"
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    error = F.when(call, failed & F.col("pair").isNull()).otherwise(failed | F.coalesce(F.col("pair_status") == "error", F.lit(False)))
    tools = paired.groupBy("harness").agg(F.count_if(call).alias("calls"), F.count_if(call & F.col("pair").isNotNull()).alias("paired"), F.count_if(error).alias("errors"))
    return kinds.join(tools, "harness", "left")


def call_counts(paired: DataFrame) -> DataFrame:
    """How many calls each session made."""
    return paired.filter("direction = 'call'").groupBy("harness", "session").agg(F.count("*").alias("calls"))
