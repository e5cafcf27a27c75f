"""Stretches of time against a count of instants, and what children inherit by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lagoon.operators import intervals

DAY = dt.datetime(2026, 1, 1)
SPAN = "k int, from timestamp_ntz, to timestamp_ntz"
OWNED = "session int, from timestamp_ntz, to timestamp_ntz, work string, tier string, basis string, reason string"


def at(n):
    return None if n is None else DAY + dt.timedelta(minutes=n)


def minute(t, open_):
    return open_ if t is None else int((t - DAY).total_seconds() // 60)


def instants(rows, label):
    return {(r["k"], m): label(r) for r in rows for m in range(minute(r["from"], -5), minute(r["to"], 65))}


def test_overlay_equals_a_count_of_instants(spark):
    rng = random.Random(2)
    pieces, covers = [], []
    for k in range(40):
        for out, share in ((pieces, 0.8), (covers, 0.5)):
            cuts = sorted(rng.sample(range(61), rng.randrange(1, 9)))
            bounds = [None, *cuts, None] if rng.random() < 0.5 else cuts
            out += [(k, at(a), at(b)) for a, b in zip(bounds, bounds[1:]) if rng.random() < share]
    p = spark.createDataFrame(pieces, SPAN).withColumn("id", F.monotonically_increasing_id())
    c = spark.createDataFrame(covers, SPAN).withColumn("who", F.xxhash64("k", "from"))
    held = instants(p.collect(), lambda r: r["id"])
    over = instants(c.collect(), lambda r: r["who"])
    got = intervals.overlay(p, c, ["k"], ["id"], ["who"]).collect()
    found = {}
    for r in got:
        for m in range(minute(r["from"], -5), minute(r["to"], 65)):
            assert (r["k"], m) not in found
            found[r["k"], m] = (r["id"], r["who"])
            assert r["covered"] == (r["who"] is not None)
    assert found == {key: (i, over.get(key)) for key, i in held.items()}
    left = intervals.subtract(p, c, ["k"], ["id"]).collect()
    assert instants(left, lambda r: r["id"]) == {key: i for key, i in held.items() if key not in over}
    # parts are as long as they can be
    ends = {(r["k"], r["id"], r["who"], r["to"]) for r in got}
    assert not any((r["k"], r["id"], r["who"], r["from"]) in ends for r in got if r["from"] is not None)


def test_merged_joins_what_overlaps_or_touches(spark):
    rows = [(1, at(0), at(10)), (1, at(2), at(4)), (1, at(10), at(12)), (1, at(13), at(14)), (1, at(20), at(20)), (2, None, at(3)), (2, at(1), None), (3, at(5), at(4))]
    got = intervals.merged(spark.createDataFrame(rows, SPAN), ["k"]).collect()
    assert sorted((r["k"], minute(r["from"], None), minute(r["to"], None)) for r in got) == [(1, 0, 12), (1, 13, 14), (2, None, None)]


def owned(spark, rows):
    return spark.createDataFrame([(s, at(a), at(b), w, t, basis, reason) for s, a, b, w, t, basis, reason in rows], OWNED)


def told(frame):
    return sorted(((r["session"], minute(r["from"], None), minute(r["to"], None), r["work"], r["tier"], r["basis"], r["reason"]) for r in frame.collect()), key=repr)


def test_estimates_elsewhere_are_no_ones(spark):
    rows = [(1, None, 10, None, None, None, "before-first-item"), (1, 10, 20, "a", "bound", "span", None), (1, 20, 40, "b", "matched", "working-stretch", None), (1, 40, None, "b", "matched", "working-stretch", None)]
    places = spark.createDataFrame([(1, at(0), "/repo"), (1, at(15), "/tmp"), (1, at(25), "/repo/sub"), (1, at(30), "/repository"), (1, at(35), "/repo"), (1, at(50), None)], "session int, at timestamp_ntz, directory string")
    away = intervals.elsewhere(places, ["session"], "/repo")
    assert sorted((minute(r["from"], None), minute(r["to"], None)) for r in away.collect()) == [(15, 25), (30, 35), (50, None)]
    got = told(intervals.cut_elsewhere(owned(spark, rows), away, ["session"]))
    assert got == sorted(
        [
            (1, None, 10, None, None, None, "before-first-item"), (1, 10, 20, "a", "bound", "span", None), (1, 20, 25, None, None, None, "elsewhere"), (1, 25, 30, "b", "matched", "working-stretch", None),
            (1, 30, 35, None, None, None, "elsewhere"), (1, 35, 40, "b", "matched", "working-stretch", None), (1, 40, 50, "b", "matched", "working-stretch", None), (1, 50, None, None, None, None, "elsewhere"),
        ],
        key=repr,
    )


def test_children_inherit_the_same_time(spark):
    """Nested and touching stretches, a grandchild, time elsewhere, a parent that is missing."""
    free = (None, None, None, "between-items")
    rows = [
        (1, None, 10, *free), (1, 10, 30, "a", "bound", "span", None), (1, 30, 50, "b", "matched", "span", None), (1, 50, None, *free),
        (2, 0, 20, *free), (2, 20, 40, "own", "bound", "span", None), (2, 40, 60, *free),
        (3, 5, 45, *free), (3, 45, 48, None, None, None, "elsewhere"),
        (4, 12, 14, *free), (5, 30, 50, *free),
    ]
    lineage = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 1)], "session int, parent int")
    got = told(intervals.inherit(owned(spark, rows), lineage))
    assert got == sorted(
        [
            *rows[:4],
            (2, 0, 10, *free), (2, 10, 20, "a", "bound", "inherited", None), (2, 20, 40, "own", "bound", "span", None), (2, 40, 50, "b", "matched", "inherited", None), (2, 50, 60, *free),
            (3, 5, 10, *free), (3, 10, 20, "a", "bound", "inherited", None), (3, 20, 40, "own", "bound", "inherited", None), (3, 40, 45, "b", "matched", "inherited", None), (3, 45, 48, None, None, None, "elsewhere"),
            (4, 12, 14, *free), (5, 30, 50, "b", "matched", "inherited", None),
        ],
        key=repr,
    )
