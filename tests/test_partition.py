"""A session's day divided by hand, and sums that hold whatever the evidence."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from lagoon.operators import evidence, partition

DAY = dt.datetime(2026, 1, 1)
CREATED, STAYS = "session int, at timestamp_ntz, sha string", "session int, from timestamp_ntz, to timestamp_ntz, place string"
EDITS, COMMITS = "edit int, session int, at timestamp_ntz, digests array<long>", "sha string, author timestamp_ntz, digests array<long>"
REQUESTS = "session int, stretch long, at timestamp_ntz, input long, away boolean"


def at(n):
    return None if n is None else DAY + dt.timedelta(minutes=n)


def frames(spark, requests, stays, created, edits, commits):
    return (
        spark.createDataFrame([(s, st, at(t), n, a) for s, st, t, n, a in requests], REQUESTS), spark.createDataFrame([(s, at(f), at(t), p) for s, f, t, p in stays], STAYS),
        spark.createDataFrame([(s, at(t), c) for s, t, c in created], CREATED), spark.createDataFrame([(e, s, at(t), d) for e, s, t, d in edits], EDITS), spark.createDataFrame([(c, at(t), d) for c, t, d in commits], COMMITS),
    )


def test_a_day_by_hand(spark):
    requests = [(1, 0, 5, 10, False), (1, 0, 20, 20, False), (1, 0, 35, 30, False), (1, 1, 200, 40, False), (1, 1, 210, 50, True), (1, 2, 900, 60, False), (1, 2, None, 70, False)]
    stays = [(1, 0, 60, "/r"), (1, 60, 800, "/r2"), (1, 800, None, None)]
    created = [(1, 30, "aaa")]
    edits = [(7, 1, 10, [1, 2, 3, 4]), (8, 1, 15, [9]), (9, 1, 205, [5, 6, 7])]
    commits = [("aaa", 30, [1, 2]), ("bbb", 40, [1, 2, 3]), ("ccc", 220, [6, 7, 8]), ("ddd", 5000, [5, 6, 7]), ("eee", 905, [77])]
    parts = frames(spark, requests, stays, created, edits, commits)
    matched = sorted((r["at"], r["work"]) for r in partition.matched_edits(parts[3], parts[4], after_s=3600).collect())
    assert matched == [(at(10), "bbb"), (at(205), "ccc")]
    spans = sorted((r["work"], r["from"], r["to"]) for r in partition.stay_spans(parts[1], parts[2]).collect())
    us = dt.timedelta(microseconds=1)
    assert spans == [("aaa", at(0), at(30) + us), ("uncommitted:/r", at(30) + us, at(60))]
    got = Counter()
    for r in partition.session_partition(*parts, ("input",), after_s=3600).collect():
        got[r["work"], r["tier"], r["basis"], r["reason"]] += r["input"]
    # 10 and 20 lie in aaa's span; 35 in uncommitted; 200 leads to the edit of ccc; 210 was made elsewhere; 900 has a commit close by
    assert got == {("aaa", "matched", "span", None): 30, ("uncommitted:/r", "matched", "span", None): 30, ("ccc", "matched", "working-stretch", None): 40, (None, None, None, "elsewhere"): 50,
                   ("eee", "estimated", "working-stretch", None): 60, (None, None, None, "request-time-unrecorded"): 70}
    view = {(r["share"], r["work"]): r["input"] for r in partition.usage_by_change(partition.session_partition(*parts, ("input",), after_s=3600), spark.createDataFrame([("aaa",)], "sha string"), ("input",)).collect()}
    assert view == {("commit", "aaa"): 30, ("uncommitted", "uncommitted:/r"): 30, ("unselected", None): 100, ("unattributed", "elsewhere"): 50, ("unattributed", "request-time-unrecorded"): 70}


def test_tiers_asked_for_and_sums(spark):
    rng = random.Random(3)
    requests = [(s, k // 8, 40 * k + rng.randrange(20) + 600 * (k // 8) if rng.random() < 0.9 else None, rng.randrange(100), rng.random() < 0.2) for s in range(8) for k in range(24)]
    stays = [(s, a, a + 500 if a < 2000 else None, rng.choice(["/r", "/q", None])) for s in range(8) for a in range(0, 2500, 500)]
    created = [(s, rng.randrange(2500), f"c{rng.randrange(12)}") for s in range(8) for _ in range(3)]
    edits = [(i, rng.randrange(8), rng.randrange(2500), rng.sample(range(40), 4)) for i in range(40)]
    commits = [(f"c{i}", rng.randrange(2500), rng.sample(range(40), 9)) for i in range(12)]
    parts = frames(spark, requests, stays, created, edits, commits)
    whole = sum(r[3] for r in requests)
    reasons = set()
    for tiers in (("bound",), ("bound", "matched"), ("bound", "matched", "estimated")):
        got = partition.session_partition(*parts, ("input",), tiers=tiers).collect()
        assert sum(r["input"] for r in got) == whole
        assert {r["tier"] for r in got if r["tier"]} <= set(tiers)
        reasons |= {r["reason"] for r in got if r["reason"]}
        view = partition.usage_by_change(partition.session_partition(*parts, ("input",), tiers=tiers), None, ("input",)).collect()
        assert sum(r["input"] for r in view) == whole
    assert {"tiers-not-asked", "elsewhere", "request-time-unrecorded"} <= reasons


def at_hand(requests, commits):
    return partition.near_commits(requests.filter("NOT away"), commits)


def test_guiding_commits_answer_as_all_close_ones_do(spark):
    rng = random.Random(9)
    for spread in (300, 1500):
        asked = [(s, 0, rng.randrange(spread) if rng.random() < 0.95 else None, 1, rng.random() < 0.4) for s in range(12) for _ in range(rng.randrange(1, 9))]
        commits = [(f"c{i}", rng.randrange(spread) if i % 3 else rng.randrange(0, spread, 20), []) for i in range(90)]
        requests, _, _, _, made = frames(spark, asked, [], [], [], commits)
        near, few = ([(r["session"], r["at"], r["work"]) for r in f(requests, made).collect()] for f in (at_hand, partition.guiding_commits))
        assert set(few) <= set(near) and len(few) == len(set(few))
        for s, _, t, _, _ in asked:
            if t is None:
                continue
            for held in (near, few):
                mine = [(a, w) for n, a, w in held if n == s]
                answer = min((x for x in mine if x[0] >= at(t)), default=None), max((x for x in mine if x[0] < at(t)), default=None)
                want = answer if held is near else want
                assert answer == want
    requests, _, _, _, made = frames(spark, [(s, 0, 10, 1, False) for s in range(50)], [], [], [], [(f"c{i}", i % 40, []) for i in range(400)])
    assert at_hand(requests, made).count() == 50 * 400
    assert partition.guiding_commits(requests, made).count() <= 50 * 8


def test_edits_meet_commits_of_the_same_lines_once(spark):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(14), 4)) for _ in range(5)]
    edits = [(i, 1, rng.randrange(-3000, 3000), rng.choice(sets)) for i in range(60)]
    commits = [(f"c{i:02}", rng.randrange(-3000, 3000), rng.choice(sets)) for i in range(80)]
    _, _, _, given, made = frames(spark, [], [], [], edits, commits)
    want = []
    for _, _, t, mine in edits:
        met = [(-len(set(mine) & set(d)), abs(c - t), sha) for sha, c, d in commits if len(set(mine) & set(d)) >= 2 and -60 <= c - t <= 300]
        want += [(at(t), min(met)[2])] if met else []
    assert sorted((r["at"], r["work"]) for r in partition.matched_edits(given, made, after_s=300 * 60).collect()) == sorted(want)
    # pairs of all edits and commits of one content would be 1.6 billion here
    many = spark.range(40_000)
    lines = F.array(*[F.lit(n).cast("long") for n in range(4)]).alias("digests")
    given = many.select(F.col("id").alias("edit"), F.lit(1).alias("session"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("at"), lines)
    made = many.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("sha"), F.timestamp_seconds(F.col("id") * 60 + 20).cast("timestamp_ntz").alias("author"), lines)
    got = partition.matched_edits(given, made)
    assert got.count() == 40_000 and got.filter(F.col("work") != F.concat(F.lit("c"), (F.unix_seconds(F.col("at").cast("timestamp")) / 60).cast("long").cast("string"))).count() == 0


def test_pairs_of_edits_and_commits_are_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(4)
    edits = [(i, [rng.randrange(30) for _ in range(rng.randrange(6))]) for i in range(60)]
    commits = [(f"c{i}", [rng.randrange(30) for _ in range(12)]) for i in range(40)]
    given, made = spark.createDataFrame(edits, "edit int, digests array<long>"), spark.createDataFrame(commits, "sha string, digests array<long>")
    want = {(e, c): len(set(x) & set(y)) for e, x in edits for c, y in commits if len(set(x)) >= 2 and 2 * len(set(x) & set(y)) >= len(set(x))}
    for most in (evidence.PAIRS, 100):
        monkeypatch.setattr(evidence, "PAIRS", most)
        met = evidence.edit_overlap(given, made)
        assert {(r["edit"], r["sha"]): r["common"] for r in met.collect()} == want
    assert met.rdd.getNumPartitions() > 10
