"""Calls and results of growing recordings paired as they arrive; what is remembered is the open calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SESSION = ["harness", "session"]
OPEN = "ordinals array<bigint>, at array<bigint>, names array<string>, statuses array<string>"
PAIRED = "harness string, session string, ordinal bigint, direction string, call_id string, name string, status string, pair bigint, pair_name string, pair_status string, duration_ms bigint, incomplete string"


class _Pairing(StatefulProcessor):
    """Of one session: a map from call id to the stack of its open calls, and the last ordinal seen."""

    def __init__(self, give_up_ms: int | None):
        self.give_up = give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "call_id string", OPEN)
        self.seen = handle.getValueState("seen", "ordinal bigint")

    def _stack(self, call: str) -> list[tuple]:
        held = self.open.getValue((call,))
        return list(zip(*(list(x) for x in held))) if held else []

    def _keep(self, call: str, stack: list[tuple], was: int) -> None:
        """Write what is open of a call now, where it held ``was`` calls before: each question and change of the state is a message to Spark."""
        if stack:
            self.open.updateValue((call,), tuple(list(x) for x in zip(*stack)))
        elif was:
            self.open.removeKey((call,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        out: list[tuple] = []
        seen = self.seen.get()
        last = seen[0] if seen else -1
        held: dict[str, tuple[list[tuple], list[tuple]]] = {}
        for row in sorted(rows, key=lambda r: r["ordinal"]):
            ordinal, us, direction, call, name, status = row["ordinal"], row["us"], row["direction"], row["call_id"], row["name"], row["status"]
            if ordinal <= last:
                out.append((*key, ordinal, direction, call, name, status, None, None, None, None, "out-of-order"))
                continue
            last = ordinal
            if call is None:
                reason = "no-result-in-read" if direction == "call" else "call-not-recorded"
                out.append((*key, ordinal, direction, call, name, status, None, None, None, None, reason))
                continue
            if call not in held:
                before = self._stack(call)
                held[call] = list(before), before
            stack = held[call][0]
            if direction == "call":
                stack.append((ordinal, us, name, status))
                if self.give_up is not None and us is not None:
                    self.handle.registerTimer(us // 1000 + self.give_up)
            elif stack:
                at, begun, its_name, its_status = stack.pop()
                took = None if us is None or begun is None else (us - begun) // 1000
                out.append((*key, at, "call", call, its_name, its_status, ordinal, name, status, took, None))
                out.append((*key, ordinal, direction, call, name, status, at, its_name, its_status, None, None))
            else:
                out.append((*key, ordinal, direction, call, name, status, None, None, None, None, "call-not-recorded"))
        for call, (stack, before) in held.items():
            if stack != before:
                self._keep(call, stack, len(before))
        if seen is None or last != seen[0]:
            self.seen.update((last,))
        yield from _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Calls that have waited too long are told as unanswered and forgotten."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.give_up
        out: list[tuple] = []
        for (call,), _ in list(self.open.iterator()):
            stack = self._stack(call)
            late = [x for x in stack if x[1] is not None and x[1] // 1000 <= until]
            out += [(*key, ordinal, "call", call, name, status, None, None, None, None, "no-result-in-read") for ordinal, _, name, status in late]
            if late:
                self._keep(call, [x for x in stack if x not in late], len(stack))
        yield from _rows(out)

    def close(self) -> None:
        pass


_TOLD = Row(*[x.split()[0] for x in PAIRED.split(", ")])


def _rows(told: list[tuple]) -> Iterator[Row]:
    return (_TOLD(*x) for x in told)


def pair_stream(events: DataFrame, late: str = "1 hour", give_up: str | None = None) -> DataFrame:
    """Tool events of a stream as ``pairing.pair_events`` tells them, each as soon as it is settled.

    A session's events must arrive in record order from one micro-batch to the next, as lines of a growing file do; inside one they may lie in any order. One that comes after a later one
    of its session was told is ``out-of-order`` and pairs with nothing. State holds the open calls of each session and its last ordinal, nothing
    else: an answered call is told with its result and forgotten. Calls still open at the end are those of ``open_calls``. With ``give_up``, an interval, a call is
    told as unanswered once the watermark (``late`` behind the newest stamp) has passed it by so much, so that lost results don't hold memory for ever.

    The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``); a restart from the checkpoint goes on where it ended.
    """
    rows = events.filter("direction IS NOT NULL").select(
        F.col("harness").cast("string"), F.col("session").cast("string"), "ordinal", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "direction", F.col("call_id").cast("string"), "name", "status",
    )
    wait = None
    if give_up is not None:
        rows = rows.withWatermark("ts", late)
        wait = int(pd.Timedelta(give_up).total_seconds() * 1000)
    return rows.groupBy(*SESSION).transformWithState(_Pairing(wait), PAIRED, "Append", "EventTime" if wait is not None else "None")


def open_calls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The calls that a stopped ``pair_stream`` still waits for, read from its state: rows of the same columns."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    each = held.select("key.*", F.col("user_map_key.call_id").alias("call_id"), F.explode(F.arrays_zip(*[F.col(f"user_map_value.{c}").alias(c) for c in ("ordinals", "at", "names", "statuses")])).alias("c"))
    none = {c: F.lit(None).cast(t) for c, t in (("pair", "bigint"), ("pair_name", "string"), ("pair_status", "string"), ("duration_ms", "bigint"))}
    return each.select(
        *SESSION, F.col("c.ordinals").alias("ordinal"), F.lit("call").alias("direction"), "call_id", F.col("c.names").alias("name"), F.col("c.statuses").alias("status"),
        *[v.alias(c) for c, v in none.items()], F.lit("no-result-in-read").alias("incomplete"),
    )
