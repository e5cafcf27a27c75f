"""Pairing on a stream: equal to the batch at the end, open calls alone in state, restarts, late rows, calls given up."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lagoon.operators.pairing import pair_events
from lagoon.streaming.open_calls import _Pairing, open_calls, pair_stream

DAY = dt.datetime(2026, 1, 1)
EVENT = "harness string, session string, ordinal long, ts timestamp_ntz, direction string, call_id string, name string, status string"
TOLD = ["session", "ordinal", "direction", "call_id", "name", "status", "pair", "pair_name", "pair_status", "duration_ms", "incomplete"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def feed(spark, root, rows, **options):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = pair_stream(spark.readStream.schema(EVENT).parquet(f"{root}/in"), **options)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/at").trigger(availableNow=True).start(f"{root}/out").awaitTermination()


def told(frame):
    return sorted(repr(tuple(r)) for r in frame.select(*[F.col(c).cast("string") for c in TOLD]).collect())


def test_stream_equals_the_batch_and_keeps_open_calls_only(rocks, tmp_path):
    rng = random.Random(12)
    rows = []
    for s in range(6):
        for n in range(40):
            rows.append(("pi", f"s{s}", n, DAY + dt.timedelta(seconds=60 * n + s) if rng.random() < 0.9 else None, rng.choice(["call", "result"]), rng.choice(["a", "b", None, "c"]), rng.choice([None, "sh"]), rng.choice([None, "error"])))
    for low, high in ((0, 7), (7, 25), (25, 40)):
        part = [r for r in rows if low <= r[2] < high]
        rng.shuffle(part)
        feed(rocks, tmp_path, part)
        so_far = pair_events(rocks.createDataFrame([r for r in rows if r[2] < high], EVENT))
        waiting = open_calls(rocks, f"{tmp_path}/at")
        assert told(waiting) == told(so_far.filter("incomplete = 'no-result-in-read' AND call_id IS NOT NULL"))
    assert told(rocks.read.parquet(f"{tmp_path}/out").unionByName(open_calls(rocks, f"{tmp_path}/at"))) == told(so_far)


def test_rows_out_of_order_are_told(rocks, tmp_path):
    at = lambda n: DAY + dt.timedelta(seconds=n)
    feed(rocks, tmp_path, [("pi", "s", 5, at(5), "call", "a", None, None)])
    feed(rocks, tmp_path, [("pi", "s", 3, at(3), "call", "a", None, None), ("pi", "s", 6, at(6), "result", "a", None, None)])
    got = {(r["ordinal"], r["pair"], r["incomplete"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(3, None, "out-of-order"), (5, 6, None), (6, 5, None)} and open_calls(rocks, f"{tmp_path}/at").count() == 0


def test_calls_are_given_up_when_the_watermark_has_passed(rocks, tmp_path):
    at = lambda n: DAY + dt.timedelta(minutes=n)
    options = {"late": "1 minute", "give_up": "30 minutes"}
    feed(rocks, tmp_path, [("pi", "s", 0, at(0), "call", "a", "sh", None), ("pi", "s", 1, at(20), "call", "b", "sh", None)], **options)
    feed(rocks, tmp_path, [("pi", "other", 0, at(40), "call", "x", None, None)], **options)
    feed(rocks, tmp_path, [("pi", "other", 1, at(41), "result", "x", None, None)], **options)
    got = {(r["session"], r["ordinal"], r["pair"], r["incomplete"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert ("s", 0, None, "no-result-in-read") in got and ("s", 1, None, "no-result-in-read") not in got
    assert {(r["session"], r["ordinal"]) for r in open_calls(rocks, f"{tmp_path}/at").collect()} == {("s", 1)}


def test_state_is_asked_once_for_a_call_and_written_only_where_it_changed():
    """Each use of the state is a message to Spark: a load asks once for each call id it names, and a call answered inside it leaves no trace."""
    class Kept(dict):
        asked = 0

        def getValue(self, key):  # noqa: N802
            self.asked += 1
            return self.get(key)

        updateValue, removeKey = dict.__setitem__, dict.__delitem__  # noqa: N815

    class Last:
        value, written = None, 0

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.written = value, self.written + 1

    pairing = _Pairing(None)
    pairing.open, pairing.seen = Kept(), Last()
    row = lambda n, direction, call: Row(ordinal=n, us=n * 1000, direction=direction, call_id=call, name=None, status=None)
    loads = [[row(1, "result", "a"), row(0, "call", "a"), row(2, "call", "b")], [row(3, "result", "b"), row(4, "result", None)], [row(4, "call", "c")]]
    got = [[(r["ordinal"], r["pair"], r["incomplete"]) for r in pairing.handleInputRows(("pi", "s"), iter(rows), None)] for rows in loads]
    assert got == [[(0, 1, None), (1, 0, None)], [(2, 3, None), (3, 2, None), (4, None, "call-not-recorded")], [(4, None, "out-of-order")]]
    assert pairing.open == {} and pairing.open.asked == 3 and pairing.seen.value == (4,) and pairing.seen.written == 2
