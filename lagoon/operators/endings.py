"""Where sessions stopped; turns cut into lanes of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION = ["harness", "session"]


def endings(turns: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Facts about the end of each session, in a fixed order.

    An operator turn is after the assistant's by their times where both have one, else by ordinal (``by_ordinal``).
    A call without result counts only if no result follows it; a result is not narrated if it is the newest
    turn and answers a call; a close by the assistant may be followed by control turns and notices.
    """
    if "ts" not in turns.columns:
        turns = turns.withColumn("ts", F.lit(None).cast("timestamp_ntz"))

    def newest(kind: str) -> Column:
        return F.max_by(F.struct("ordinal", "ts"), F.when(F.col("kind") == kind, F.col("ordinal")))

    facts = turns.groupBy(*SESSION).agg(
        F.count("*").alias("turns"),
        F.max("ordinal").alias("last"),
        F.max_by("kind", "ordinal").alias("last_kind"),
        newest("operator").alias("__o"),
        newest("assistant").alias("__a"),
        F.max_by("kind", F.when(~F.col("kind").isin("control", "notice"), F.col("ordinal"))).alias("__close"),
        F.bool_or(F.col("kind") == "unknown").alias("kind_unknown"),
        F.bool_and(F.col("ts").isNull()).alias("no_timestamps"),
    )
    if events is not None:
        result, call = F.col("direction") == "result", F.col("direction") == "call"
        told = events.groupBy(*SESSION).agg(
            F.max(F.when(result, F.col("ordinal"))).alias("__result"),
            F.max(F.when(result & F.col("pair").isNotNull(), F.col("ordinal"))).alias("__answer"),
            F.max(F.when(call & F.col("pair").isNull(), F.col("ordinal"))).alias("__open"),
        )
        facts = facts.join(told, SESSION, "left")
    else:
        facts = facts.withColumns({c: F.lit(None).cast("long") for c in ("__result", "__answer", "__open")})
    timed = F.col("__o.ts").isNotNull() & F.col("__a.ts").isNotNull()
    after = F.when(F.col("__a").isNull(), F.col("__o").isNotNull()).when(timed, F.col("__o.ts") > F.col("__a.ts")).otherwise(F.col("__o.ordinal") > F.col("__a.ordinal"))
    tests = [
        ("operator-turn-after-assistant", after),
        ("control-turn-last", F.col("last_kind") == "control"),
        ("notice-turn-last", F.col("last_kind") == "notice"),
        ("call-without-result", F.col("__open") > F.coalesce("__result", F.lit(-1))),
        ("results-without-narration", (F.col("last_kind") == "tool") & (F.col("__answer") == F.col("last"))),
        ("assistant-close", F.col("__close") == "assistant"),
    ]
    named = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    return facts.select(
        *SESSION,
        "turns",
        "last",
        "last_kind",
        F.col("__o.ordinal").alias("last_operator"),
        F.col("__a.ordinal").alias("last_assistant"),
        "kind_unknown",
        "no_timestamps",
        F.coalesce(F.col("__o").isNotNull() & F.col("__a").isNotNull() & ~timed, F.lit(False)).alias("by_ordinal"),
        F.array_join(named, ",").alias("facts"),
    )


def lanes(turns: DataFrame, bound: int, text: str = "text") -> DataFrame:
    """``lane`` for each turn: in order, a turn whose bytes would take the lane above ``bound`` starts the next one.

    Each lane's start depends on all before it, so a session is folded in order; it is read once, in
    the order that the shuffle sorted, with a running pair of numbers for state, never held whole.
    """
    sized = turns.select(*SESSION, "ordinal", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sized.repartition(parts, *SESSION).sortWithinPartitions(*SESSION, "ordinal")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lane, filled = None, 0, 0
        for batch in batches:
            out = []
            for harness, session, size in zip(batch["harness"], batch["session"], batch["bytes"]):
                if (harness, session) != key:
                    key, lane, filled = (harness, session), 0, 0
                elif filled + size > bound:
                    lane, filled = lane + 1, 0
                filled += size
                out.append(lane)
            yield batch.assign(lane=out)

    return ordered.mapInPandas(fold, "harness string, session long, ordinal long, bytes long, lane long")
