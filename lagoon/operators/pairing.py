"""Tool calls and their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["harness", "session"]


def pair_events(events: DataFrame, bounded: bool = False) -> DataFrame:
    """Tool events with ``pair`` (the partner's ordinal), ``pair_name`` and ``pair_status`` (the partner's), ``incomplete`` and, on calls, ``duration_ms``.

    In record order a result answers the newest open call of its id. With +1 for calls and -1 for
    results, the running sum less its running minimum (0 at most) is the number of open calls; a
    result that lowers the minimum answers nothing. Among the others, call and result of one level
    follow each other, so no stack and no self-join is needed. Events without an id never pair. In a ``bounded`` read
    the call of a lone result may stand before the bound.
    """
    keys = [*SESSION, "call_id"]
    by = Window.partitionBy(*keys).orderBy("ordinal")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    named = events.filter("call_id IS NOT NULL")
    step = F.when(F.col("direction") == "call", 1).otherwise(-1)
    counted = named.withColumn("__s", F.sum(step).over(upto)).withColumn("__m", F.least(F.lit(0), F.min("__s").over(upto)))
    judged = counted.withColumn("__orphan", (F.col("direction") == "result") & (F.col("__m") < F.coalesce(F.lag("__m").over(by), F.lit(0))))
    level = F.col("__s") - F.col("__m") + F.when(F.col("direction") == "result", 1).otherwise(0)
    placed = judged.withColumn("__level", F.when(F.col("__orphan"), -1).otherwise(level))
    inside = Window.partitionBy(*keys, "__level").orderBy("ordinal")
    call = F.col("direction") == "call"
    paired = placed.withColumn(
        "pair",
        F.when(F.col("__orphan"), None)
        .when(call & (F.lead("direction").over(inside) == "result"), F.lead("ordinal").over(inside))
        .when(~call & (F.lag("direction").over(inside) == "call"), F.lag("ordinal").over(inside)),
    ).withColumn(
        "duration_ms",
        F.when(
            call & F.col("pair").isNotNull(),
            F.floor((F.unix_micros(F.lead("ts").over(inside).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000),
        ),
    )
    for c in ("name", "status"):
        if c in events.columns:
            paired = paired.withColumn(f"pair_{c}", F.when(F.col("pair").isNotNull(), F.when(call, F.lead(c).over(inside)).otherwise(F.lag(c).over(inside))))
    added = {c: F.lit(None).cast(paired.schema[c].dataType) for c in ("pair", "duration_ms", "pair_name", "pair_status") if c in paired.columns}
    unnamed = events.filter("call_id IS NULL").withColumns(added)
    both = paired.drop("__s", "__m", "__orphan", "__level").unionByName(unnamed)
    orphan = "call-before-read-bound" if bounded else "call-not-recorded"
    reason = F.when(F.col("pair").isNotNull(), None).when(F.col("direction") == "call", "no-result-in-read").otherwise(orphan)
    return both.withColumn("incomplete", reason)


def tool_stats(paired: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls, results, pairs, errors, durations and what is incomplete, by tool name (null where neither half names the tool).

    A result without a name takes its call's. A pair's error is counted once, at the result, whichever half carries
    it; an unanswered call's at the call.
    """
    call, done = F.col("direction") == "call", F.col("pair").isNotNull()
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    error = F.when(call, failed & ~done).otherwise(failed | F.coalesce(F.col("pair_status") == "error", F.lit(False)))
    named = paired.withColumns({"tool": F.when(call, F.col("name")).otherwise(F.coalesce("name", "pair_name")), "__error": error})
    return named.groupBy(*keys, "tool").agg(
        F.count_if(call).alias("calls"),
        F.count_if(~call).alias("results"),
        F.count_if(call & done).alias("paired"),
        F.count_if("__error").alias("errors"),
        *[F.count_if(F.coalesce(F.col("incomplete") == r, F.lit(False))).alias(r.replace("-", "_")) for r in ("no-result-in-read", "call-before-read-bound", "call-not-recorded")],
        F.sum("duration_ms").alias("duration_ms"),
        F.max("duration_ms").alias("longest_ms"),
        F.count("duration_ms").alias("timed"),
    )


def filter_events(paired: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Events of the tools named; the partner of a kept event is kept through its pair."""
    chosen = paired.filter(F.col("name").isin(*names))
    partners = chosen.filter("pair IS NOT NULL").select(*SESSION, F.col("pair").alias("ordinal"))
    wanted = chosen.select(*SESSION, "ordinal").unionByName(partners).distinct()
    return paired.join(wanted, [*SESSION, "ordinal"], "left_semi")
