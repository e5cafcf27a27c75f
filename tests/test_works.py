"""Attribution against a walk over every segment in plain Python."""

import datetime as dt
import random

import pytest

from lagoon.operators import works

DAY = dt.datetime(2026, 1, 1)
US = dt.timedelta(microseconds=1)


def at(n):
    return None if n is None else DAY + dt.timedelta(minutes=n)


def plan(spans, events):
    """Segments of one session: from, to, {work: strongest evidence}."""
    edges = [(w, f, t, (works.TIERS.index(tier), 0)) for w, f, t, tier in spans]
    for w in {e[0] for e in events}:
        mine = [e for e in events if e[0] == w]
        edges.append((w, min(e[1] for e in mine), max(e[1] for e in mine) + US, (max(works.TIERS.index(e[2]) for e in mine), 1)))
    cuts = sorted({x for _, f, t, _ in edges for x in (f, t) if x is not None})
    bounds = [None, *cuts, None]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        held = {}
        for w, f, t, e in edges:
            if a is not None and f <= a and (t is None or (b is not None and b <= t)):
                held[w] = min(held.get(w, e), e)
        out.append((a, b, held))
    return out


def layer(segments, requests, take, tiers=None):
    """{(segment, work, tier, basis, reason): counters} of one layer; requests: at, counter, guess, gone."""
    out = {}

    def give(key, n, value):
        held = out.setdefault(key, [0, 0])
        held[0] += n
        held[1] += value

    covered = [i for i, s in enumerate(segments) if s[2]]
    for i, (a, b, held) in enumerate(segments):
        mine = [r for r in requests if r[0] is not None and (a is None or r[0] >= a) and (b is None or r[0] < b)]
        reason = "overlap" if len(held) > 1 else "before-first-item" if not covered or i < covered[0] else "after-last-item" if i > covered[-1] else "between-items"
        if take == "even" and len(held) > 1 and mine:
            total = sum(r[1] for r in mine)
            for k, w in enumerate(sorted(held)):
                give((i, w, works.TIERS[held[w][0]], "even", None), len(mine), total // len(held) + (k < total % len(held)))
            continue
        for when, value, guess, gone in mine:
            if len(held) == 1:
                ((w, e),) = held.items()
                give((i, w, works.TIERS[e[0]], works.BASES[e[1]], None), 1, value)
                continue
            if take in ("estimated", "following") and not held and guess:
                if gone:
                    give((i, None, None, None, "elsewhere"), 1, value)
                    continue
                give((i, *guess, "working-stretch", None), 1, value)
                continue
            later = [s[2] for s in segments[i + 1 :] if len(s[2]) == 1]
            if take == "following" and reason == "between-items" and later:
                ((w, e),) = later[0].items()
                give((i, w, works.TIERS[e[0]], "following", None), 1, value)
                continue
            give((i, None, None, None, reason), 1, value)
    for r in requests:
        if r[0] is None:
            give((None, None, None, None, "request-time-unrecorded"), 1, r[1])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    sessions = {}
    for k in range(25):
        spans = []
        for _ in range(rng.randrange(0, 6)):
            f = rng.randrange(0, 50)
            spans.append((rng.choice("abc"), at(f), at(f + rng.randrange(1, 20)) if rng.random() < 0.8 else None, rng.choice(works.TIERS)))
        events = [(rng.choice("abd"), at(rng.randrange(0, 60)), rng.choice(works.TIERS)) for _ in range(rng.randrange(0, 3))]
        requests = [(at(rng.randrange(-5, 70)) if rng.random() < 0.9 else None, rng.randrange(0, 100), (rng.choice("xy"), rng.choice(works.TIERS)) if rng.random() < 0.5 else None, rng.random() < 0.3) for _ in range(rng.randrange(1, 25))]
        sessions[k] = (spans, events, requests)
    return sessions


def frames(spark, made):
    spans = spark.createDataFrame([(k, w, f, t, tier) for k, (s, _, _) in made.items() for w, f, t, tier in s], "k int, work string, from timestamp_ntz, to timestamp_ntz, tier string").repartition(3)
    events = spark.createDataFrame([(k, w, a, tier) for k, (_, e, _) in made.items() for w, a, tier in e], "k int, work string, at timestamp_ntz, tier string")
    requests = spark.createDataFrame([(k, a, v, g and g[0], g and g[1], x) for k, (_, _, r) in made.items() for a, v, g, x in r], "k int, at timestamp_ntz, input long, w string, t string, gone boolean").repartition(4)
    return spans, events, requests


def test_every_layer_equals_the_walk_and_adds_up(spark, made):
    spans, events, requests = frames(spark, made)
    got = works.divide(spans, events, requests, ["k"], ("input",), ("w", "t"), away="gone").collect()
    for k, (s, e, r) in made.items():
        segments = plan(s, e)
        for take in ("conserving", "estimated", "even", "following"):
            mine = {(x["segment"], x["work"], x["tier"], x["basis"], x["reason"]): (x["requests"], x["input"]) for x in got if x["k"] == k and x["layer"] == take}
            assert mine == layer(segments, r, take), (k, take)
            assert sum(v for _, v in mine.values()) == sum(x[1] for x in r)


def test_tiers_that_are_not_asked_for(spark, made):
    spans, events, requests = frames(spark, made)
    asked = ("bound", "matched")
    got = works.divide(spans, events, requests, ["k"], ("input",), ("w", "t"), tiers=asked).collect()
    named = 0
    for k, (s, e, r) in made.items():
        full = plan(s, e)
        part = plan([x for x in s if x[3] in asked], [x for x in e if x[2] in asked])
        r = [(a, v, g, False) for a, v, g, _ in r]
        less = [(a, v, g if g and g[1] in asked else None, x) for a, v, g, x in r]
        for take in ("conserving", "estimated", "even", "following"):
            want = {}
            held = [q for q in less]
            for i in range(len(r)):
                owner = layer(full, [r[i]], take)
                ((key, value),) = layer(part, [held[i]], take).items() if take != "even" else [next(iter(layer(part, [held[i]], take).items()))]
                if key[1] is None and key[4] not in ("elsewhere", "request-time-unrecorded") and any(o[1] is not None for o in owner):
                    key = (*key[:4], "tiers-not-asked")
                if key[1] is None:
                    old = want.get(key, (0, 0))
                    want[key] = (old[0] + 1, old[1] + r[i][1])
            mine = {(x["segment"], x["work"], x["tier"], x["basis"], x["reason"]): (x["requests"], x["input"]) for x in got if x["k"] == k and x["layer"] == take and x["work"] is None}
            assert mine == want
            named += sum(x[4] == "tiers-not-asked" for x in mine)
            assert sum(x["input"] for x in got if x["k"] == k and x["layer"] == take) == sum(x[1] for x in r)
    assert named > 10


def test_selection_says_what_it_leaves_out(spark):
    spans = spark.createDataFrame([(1, "a", at(10), at(20), "bound"), (1, "b", at(30), at(40), "matched")], "k int, work string, from timestamp_ntz, to timestamp_ntz, tier string")
    requests = spark.createDataFrame([(1, at(m), 10 * m) for m in (5, 12, 25, 33, 50)] + [(1, None, 7)], "k int, at timestamp_ntz, input long")
    divided = works.divide(spans, None, requests, ["k"], ("input",))
    chosen = spark.createDataFrame([("a",)], "work string")
    totals = spark.createDataFrame([(1, 2000)], "k int, total long")
    got = {r["layer"]: tuple(r)[2:] for r in works.selection(divided, chosen, totals, ["k"], "input").collect()}
    every = ["after-last-item", "before-first-item", "between-items", "recorded-total-not-splittable", "request-time-unrecorded", "unselected-item"]
    assert got["conserving"] == (120, 330, 50 + 250 + 500 + 7, every)
    assert got["following"] == (120, 580, 50 + 500 + 7, [x for x in every if x != "between-items"])
    sums = {(r["layer"], r["work"], r["reason"]): r["input"] for r in works.shares(divided, ["k"], ("input",)).collect()}
    assert sums["conserving", "a", None] == 120 and sums["even", None, "between-items"] == 250


def test_runs_edges_and_empty_spans(spark):
    spans = spark.createDataFrame([(1, "a", "r1", at(0), at(10), "bound"), (1, "a", "r2", at(5), None, "matched"), (1, "b", None, at(7), at(7), "bound"), (2, "c", None, None, at(3), "bound")],
                                  "k int, work string, run string, from timestamp_ntz, to timestamp_ntz, tier string")
    none = spark.createDataFrame([(3, at(1), 0)], "k int, at timestamp_ntz, request long")
    cut, placed = works.sweep(works.evidence_edges(spans, None, ["k"]), none, ["k"])
    got = [(r["k"], r["segment"], [(c["work"], c["tier"]) for c in r["covers"]], r["runs"]) for r in cut.orderBy("k", "segment").collect()]
    assert got == [
        (1, 0, [], []), (1, 1, [("a", "bound")], ["r1"]), (1, 2, [("a", "bound")], ["r1", "r2"]), (1, 3, [("a", "bound")], ["r1", "r2"]), (1, 4, [("a", "matched")], ["r2"]), (3, 0, [], []),
    ]
    assert [tuple(r) for r in placed.collect()] == [(3, 0, 0)]
