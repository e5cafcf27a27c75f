"""Session operators against loops over small tables: nulls, ties, negative gaps, orphans, cycles, open spans."""

import itertools
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lagoon.operators import attribution, endings, lineage, listing, pairing, pricing, shares, spans, turns, usage
from lagoon.operators.components import connected_components
from lagoon.storage import materialize

T0 = datetime(2024, 1, 1)


def stamp(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for size in (0, 5, 60):
        edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(size)] + [(100 + k, 101 + k) for k in range(40 if size else 0)] + [(7, None)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if b is not None and a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        got = {r["node"]: r["component"] for r in connected_components(frame(spark, edges, "src long, dst long")).collect()}
        assert got == {n: find(n) for n in parent}


def stack_pairs(events):
    stacks, pair = defaultdict(list), {}
    for ordinal, call_id, direction in events:
        if call_id is None:
            continue
        if direction == "call":
            stacks[call_id].append(ordinal)
        elif stacks[call_id]:
            other = stacks[call_id].pop()
            pair[ordinal], pair[other] = other, ordinal
    return pair


def test_pairing_equals_a_stack(spark):
    rng = random.Random(2)
    sessions = {s: [(i, rng.choice([None, 1, 1, 2]), rng.choice(["call", "result"])) for i in range(rng.randint(1, 25))] for s in range(60)}
    rows = [("pi", s, i, c, d, "t", stamp(i)) for s, events in sessions.items() for i, c, d in events]
    got = pairing.pair_events(frame(spark, rows, "harness string, session long, ordinal long, call_id long, direction string, name string, ts timestamp_ntz")).collect()
    assert len(got) == len(rows)
    want = {s: stack_pairs(events) for s, events in sessions.items()}
    for r in got:
        assert r["pair"] == want[r["session"]].get(r["ordinal"])
        assert (r["incomplete"] is None) == (r["pair"] is not None)
        if r["direction"] == "call" and r["pair"] is not None:
            assert r["duration_ms"] == (r["pair"] - r["ordinal"]) * 60_000


def test_fold_keeps_what_dominates(spark):
    rng = random.Random(3)
    names = usage.COUNTERS
    rows = [(s, i, *[rng.choice([None, 0, 1, 2]) for _ in names]) for s in range(40) for i in range(rng.randint(1, 6))]
    got = {r["session"]: r for r in usage.fold_requests(frame(spark, rows, "session long, ordinal long, " + ", ".join(f"{c} long" for c in names)), ["session"]).collect()}
    for s in range(40):
        records = [r[2:] for r in rows if r[0] == s]
        held = records[0]
        for x in records[1:]:
            if all(b is None or (a is not None and a >= b) for a, b in zip(x, held)):
                held = x
        assert tuple(got[s][c] for c in names) == held and got[s]["records"] == len(records)


def test_stretches_follow_record_order(spark):
    minutes = [0, 45, 91, 80, None, 100, 200]  # exactly idle continues, 46 splits, a step back continues
    rows = [("pi", 1, i, stamp(m), "operator") for i, m in enumerate(minutes)]
    turn = frame(spark, rows, "harness string, session long, ordinal long, ts timestamp_ntz, kind string")
    got = sorted((r["stretch"], r["first"], r["last"], r["turns"]) for r in turns.stretches(turn).collect())
    assert got == [(0, stamp(0), stamp(45), 2), (1, stamp(80), stamp(100), 3), (2, stamp(200), stamp(200), 1)]
    active = turns.active_time(turn).first()
    assert active["active_ms"] == 65 * 60_000 and active["max_gap_ms"] == 100 * 60_000 and active["span_ms"] == 200 * 60_000
    alone = turns.active_time(turn.filter("ordinal = 0")).first()
    assert alone["active_ms"] is None and alone["span_ms"] is None


def test_nearest_ranks(spark):
    rng = random.Random(4)
    values = {k: [rng.randint(0, 9) for _ in range(n)] for k, n in enumerate((1, 2, 3, 10, 11, 57))}
    got = {r["k"]: r for r in turns.nearest_ranks(frame(spark, [(k, v) for k, vs in values.items() for v in vs], "k long, v long"), ["k"], "v").collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        assert (got[k]["p50"], got[k]["p90"], got[k]["max"], got[k]["n"]) == (vs[-(-len(vs) * 50 // 100) - 1], vs[-(-len(vs) * 90 // 100) - 1], vs[-1], len(vs))


def test_islands_and_changes_with_nulls(spark):
    rows = [(1, i, v) for i, v in enumerate(["a", "a", None, None, "a", "b"])]
    data = frame(spark, rows, "session long, ordinal long, v string")
    assert [(r["v"], r["first"], r["last"]) for r in turns.islands(data, ["session"], "v").orderBy("span").collect()] == [("a", 0, 1), (None, 2, 3), ("a", 4, 4), ("b", 5, 5)]
    assert sorted(r["ordinal"] for r in turns.changes(data, ["session"], "v").collect()) == [0, 2, 4, 5]


def test_conventions(spark):
    rows = [("claude", 10, 5, 6, 3, 0), ("codex", 10, 5, 2, 3, 0), ("codex", 2, 5, 2, 3, 0), ("codex", 10, 5, 2, 3, 4), ("codex", 10, 5, 2, 3, None), ("opencode", 10, 5, 7, 3, 1), ("opencode", 10, 5, None, 3, 1), ("other", 10, 5, 1, 3, 1)]
    data = spark.createDataFrame(rows, "harness string, input long, output long, reasoning long, cache_read long, cache_write long")
    got = [(r["d_uncached"], r["d_output"], r["d_reasoning"], r["d_total"]) for r in usage.disjoint(data.coalesce(1)).collect()]
    assert sorted(got, key=repr) == sorted([(10, 5, None, 18), (7, 5, 2, 15), (None, 5, 2, None), (None, 5, 2, None), (None, 5, 2, None), (10, 12, 7, 26), (10, None, None, None), (None, None, None, None)], key=repr)


def test_absent_is_not_zero(spark):
    data = spark.createDataFrame([("a", None, 1), ("a", 0, None), ("b", None, None)], "model string, input long, output long")
    full = data.withColumns({c: F.lit(None).cast("long") for c in ("reasoning", "cache_read", "cache_write")})
    got = {r["model"]: r for r in usage.usage_by(full, ["model"]).collect()}
    assert (got["a"]["input"], got["a"]["input_sessions"], got["b"]["input"], got["a"]["reasoning"]) == (0, 1, None, None)


def test_spans_and_remainder_are_the_whole(spark):
    rows = [(k, stamp(m), 10) for k, m in enumerate([0, 5, 10, 10, 15, 20, None])]
    requests = frame(spark, rows, "ordinal long, at timestamp_ntz, input long")
    for cut in range(0, 25, 5):
        given = spark.createDataFrame([(1, None, stamp(cut)), (2, stamp(cut), None)], "span_id int, from timestamp_ntz, to timestamp_ntz")
        got = {r["span_id"]: r["requests"] for r in spans.span_usage(requests, given, ("input",)).collect()}
        times = [m for m in (0, 5, 10, 10, 15, 20)]
        assert got.get(1, 0) == sum(m < cut for m in times) and got.get(2, 0) == sum(m >= cut for m in times) and got[-2] == 1
    both = spark.createDataFrame([(1, stamp(0), stamp(11)), (2, stamp(10), stamp(30))], "span_id int, from timestamp_ntz, to timestamp_ntz")
    assert sum(r["requests"] for r in spans.span_usage(requests, both, ("input",)).collect()) == 9  # two stand in both


def test_stretch_of_request(spark):
    stretch = spark.createDataFrame([(1, 0, stamp(10)), (1, 1, stamp(50))], "session long, stretch long, first timestamp_ntz")
    requests = frame(spark, [(1, k, stamp(m)) for k, m in enumerate([0, 10, 49, 50, 99])], "session long, ordinal long, at timestamp_ntz")
    assert [r["stretch"] for r in spans.stretch_of(requests, stretch, ["session"]).orderBy("ordinal").collect()] == [0, 0, 0, 1, 1]


def test_roots_with_cycles_dangling_parents_and_long_chains(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 11), (11, 10), (20, 999)] + [(100 + k, 100 + k - 1 if k else None) for k in range(30)]
    got = {r["session"]: (r["root"], r["depth"]) for r in lineage.roots(frame(spark, rows, "session long, parent long")).collect()}
    assert got[3] == (1, 2) and got[1] == (1, 0) and got[20] == (20, 0) and got[129] == (100, 29)
    assert set(got) == {r[0] for r in rows} and got[10][1] == 32
    family = {r["session"]: r["depth"] for r in lineage.closure(frame(spark, rows, "session long, parent long"), spark.createDataFrame([(1,), (10,)], "session long")).collect()}
    assert family == {1: 0, 2: 1, 3: 2, 10: 0, 11: 1}


def test_overlap_by_shared_ids_and_parents(spark):
    sessions = spark.createDataFrame([(1, "pi", None), (2, "pi", 1), (3, "codex", 1), (4, "codex", None), (5, "pi", None)], "session long, harness string, parent long")
    ids = spark.createDataFrame([(3, "x"), (4, "x"), (5, "y")], "session long, id string")
    got = {r["session"]: r["component"] for r in lineage.overlap_groups(sessions, ids).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_apportion_adds_up(spark):
    rng = random.Random(6)
    groups = {k: [rng.randint(0, 5) for _ in range(rng.randint(1, 8))] for k in range(30)} | {99: [0, 0]}
    rows = [(k, i, w) for k, ws in groups.items() for i, w in enumerate(ws)]
    got = defaultdict(dict)
    for r in shares.apportion(frame(spark, rows, "k long, i long, w long"), ["k"], "w", 17, "i").collect():
        got[r["k"]][r["i"]] = r["share"]
    for k, ws in groups.items():
        if sum(ws) == 0:
            want = [17] + [0] * (len(ws) - 1)
        else:
            want = [17 * w // sum(ws) for w in ws]
            for i in sorted(range(len(ws)), key=lambda i: (-(17 * ws[i] % sum(ws)), i))[: 17 - sum(want)]:
                want[i] += 1
        assert [got[k][i] for i in range(len(ws))] == want


def test_quota_chains_follow_resets(spark):
    """Jitter inside a period, a stale snapshot, a new period, and falls where no reset is recorded."""
    rows = [("p", 0, 10.0, 500), ("p", 1, 12.0, 500), ("p", 2, 11.0, 500), ("p", 3, 12.0, 500), ("p", 3, 12.0, 500), ("p", 4, 30.0, 900), ("p", 5, 29.0, 900), ("q", 0, 5.0, None), ("q", 1, 4.0, None), ("q", 2, 6.5, None), ("q", 3, 6.5, 800)]
    seen = spark.createDataFrame([(p, stamp(t), v, None if r is None else stamp(r)) for p, t, v, r in rows], "pool string, at timestamp_ntz, percent double, resets_at timestamp_ntz")
    got = shares.quota_chains(seen, ["pool"])
    have = [(r["pool"], r["chain"], r["stale"], r["rise"]) for r in got.orderBy("pool", "at").collect()]
    assert have == [("p", 0, False, 2.0), ("p", 0, False, 0.0), ("p", 0, True, None), ("p", 0, False, None), ("p", 1, False, None), ("p", 1, True, None), ("q", 0, False, None), ("q", 1, False, 2.5), ("q", 1, False, None), ("q", 2, False, None)]
    steps = shares.chain_intervals(got, ["pool"])
    assert [(r["pool"], r["chain"], r["interval"], r["rise"]) for r in steps.orderBy("pool", "chain", "interval").collect()] == [("p", 0, 1, 2.0), ("p", 0, 2, 0.0), ("q", 1, 1, 2.5)]


def test_plateau_bounds_against_all_roundings(spark):
    """The extremes over every non-decreasing assignment of half points to the whole percents."""
    rng = random.Random(12)
    for trial in range(6):
        values = sorted(rng.choice([0.0, 1.0, 1.0, 2.0, 3.0, 3.25]) for _ in range(5))
        weight = [rng.choice([0.0, 0.25, 1.0]) for _ in range(4)]
        chains = spark.createDataFrame([("p", 0, stamp(k), v, False) for k, v in enumerate(values)], "pool string, chain long, at timestamp_ntz, percent double, stale boolean")
        chains = chains.withColumn("rise", F.lead("percent").over(Window.partitionBy("pool").orderBy("at")) - F.col("percent"))
        shared = spark.createDataFrame([("p", 0, k + 1, w) for k, w in enumerate(weight)], "pool string, chain long, interval long, share double")
        got = shares.plateau_bounds(chains, ["pool"], shared).first()
        sums = []
        for offsets in itertools.product([-0.5, 0.5], repeat=5):
            true = [v + (o if v == int(v) else 0) for v, o in zip(values, offsets)]
            if all(a <= b for a, b in zip(true, true[1:])):
                sums.append(sum(w * (b - a) for w, a, b in zip(weight, true, true[1:])))
        assert abs(got["estimate"] - sum(w * (b - a) for w, a, b in zip(weight, values, values[1:]))) < 1e-9
        assert got["at_least"] <= max(0, min(sums)) + 1e-9 and got["at_most"] >= max(sums) - 1e-9


def test_quota_parts_sum_to_rises(spark):
    intervals = spark.createDataFrame([("p", 1, stamp(0), stamp(10), 4.0), ("p", 2, stamp(10), stamp(20), 6.0), ("p", 3, stamp(20), stamp(30), 1.0)], "pool string, interval long, start timestamp_ntz, end timestamp_ntz, rise double")
    uses = frame(spark, [("p", 7, stamp(0), 5), ("p", 7, stamp(10), 30), ("p", 8, stamp(5), 10), ("p", 8, stamp(11), 9), ("p", 8, stamp(40), 9)], "pool string, session long, at timestamp_ntz, tokens long")
    got = {(r["interval"], r["session"]): r["share"] for r in shares.allowance_shares(intervals, uses).collect()}
    assert got == {(1, 7): 3.0, (1, 8): 1.0, (2, 8): 6.0, (3, None): 1.0}


def test_prices(spark):
    listed = spark.createDataFrame([("m", ["alias"], stamp(0), stamp(10), 2), ("m", ["alias"], stamp(10), None, 3)], "model string, aliases array<string>, from timestamp_ntz, until timestamp_ntz, p_output long")
    rows = [("m", 0), ("m", 9), ("m", 10), ("m", -1), ("alias", 5), ("m-20240131", 12), ("zzz", 5)]
    requests = spark.createDataFrame([(i, m, stamp(t)) for i, (m, t) in enumerate(rows)], "ordinal long, model string, at timestamp_ntz")
    got = {r["ordinal"]: (r["p_output"], r["price_reason"]) for r in pricing.price_of(requests, listed).collect()}
    assert got == {0: (2, None), 1: (2, None), 2: (3, None), 3: (None, "outside-validity"), 4: (2, None), 5: (3, None), 6: (None, "unlisted-model")}


def test_segments_layers_conserve_and_ignore_order(spark):
    rows = [(1, "a", stamp(0), stamp(10)), (1, "b", stamp(5), stamp(15)), (1, "a", stamp(20), None), (1, "a", stamp(0), stamp(10))]
    schema = "k long, work string, from timestamp_ntz, to timestamp_ntz"
    cut = attribution.segments(frame(spark, rows, schema), ["k"])
    got = [(r["segment"], r["from"], r["to"], r["works"]) for r in cut.orderBy("segment").collect()]
    assert [(g[0], g[3]) for g in got] == [(0, []), (1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, []), (5, ["a"])]
    reasons = {r["segment"]: r["reason"] for r in attribution.reasons(cut, ["k"]).collect()}
    assert reasons == {0: "before-first-item", 1: None, 2: "overlap", 3: None, 4: "between-items", 5: None}
    layers = attribution.layers(cut.withColumn("requests", F.col("segment") + 3), ["k"]).collect()
    assert sum(r["allocated"] + r["unattributed"] for r in layers) == sum(range(3, 9))
    again = [(r["segment"], r["works"]) for r in attribution.segments(frame(spark, rows[::-1], schema), ["k"]).orderBy("segment").collect()]
    assert again == [(g[0], g[3]) for g in got]


def test_endings(spark):
    kinds = {1: ["operator", "assistant"], 2: ["assistant", "operator"], 3: ["operator", "control"], 4: ["unknown"]}
    rows = [("pi", s, i, k) for s, ks in kinds.items() for i, k in enumerate(ks)]
    got = {r["session"]: r for r in endings.endings(frame(spark, rows, "harness string, session long, ordinal long, kind string")).collect()}
    assert got[1]["facts"] == "assistant-close" and got[2]["facts"] == "operator-turn-after-assistant"
    assert got[3]["facts"] == "operator-turn-after-assistant,control-turn-last" and got[4]["kind_unknown"] and got[4]["facts"] == ""


def test_endings_by_what_the_events_say(spark):
    kinds = {1: ["operator", "tool", "tool"], 2: ["operator", "tool", "tool", "assistant", "notice"], 3: ["tool", "assistant", "tool"], 4: ["tool", "tool"]}
    turns_ = [("pi", s, i, k) for s, ks in kinds.items() for i, k in enumerate(ks)]
    paired = [("pi", 1, 1, "call", 2), ("pi", 1, 2, "result", 1), ("pi", 2, 1, "call", None), ("pi", 2, 2, "result", None), ("pi", 3, 0, "result", None), ("pi", 3, 2, "call", None), ("pi", 4, 0, "call", None), ("pi", 4, 1, "result", None)]
    events = spark.createDataFrame(paired, "harness string, session long, ordinal long, direction string, pair long")
    got = {r["session"]: r["facts"] for r in endings.endings(frame(spark, turns_, "harness string, session long, ordinal long, kind string"), events).collect()}
    assert got == {1: "operator-turn-after-assistant,results-without-narration", 2: "notice-turn-last,assistant-close", 3: "call-without-result", 4: ""}


def test_errors_are_counted_once_for_each_pair(spark):
    rows = [(1, 0, 1, "call", "a", "error"), (1, 1, 1, "result", None, "error"), (1, 2, 2, "call", "a", "error"), (1, 3, 3, "call", "b", None), (1, 4, 3, "result", None, "error"), (1, 5, 4, "result", "c", None), (1, 6, 5, "call", "b", "error"), (1, 7, 5, "result", None, None)]
    events = spark.createDataFrame([("pi", s, o, c, d, n, x, stamp(o)) for s, o, c, d, n, x in rows], "harness string, session long, ordinal long, call_id long, direction string, name string, status string, ts timestamp_ntz")
    got = {r["tool"]: r.asDict() for r in pairing.tool_stats(pairing.pair_events(events)).collect()}
    assert {t: (r["calls"], r["results"], r["paired"], r["errors"], r["no_result_in_read"], r["call_not_recorded"]) for t, r in got.items()} == {"a": (2, 1, 1, 2, 1, 0), "b": (2, 2, 2, 2, 0, 0), "c": (0, 1, 0, 0, 0, 1)}


def test_search_is_partial_only_where_turns_were_withheld(spark):
    rows = [("pi", 1, k, "abc " * 10) for k in range(6)] + [("pi", 2, k, "needle") for k in range(2)] + [("pi", 3, k, "x") for k in range(9)]
    read, withheld = listing.tail_read(spark.createDataFrame(rows, "harness string, session long, ordinal long, text string"), 100)
    got = {r["session"]: (r["hit"], r["searched"], r["partial"]) for r in listing.search_tail(read, "NEEDLE", 3, withheld).collect()}
    assert got == {1: (False, 2, True), 2: (True, 2, False), 3: (False, 3, False)}


def test_lanes_tile_the_turns(spark):
    rng = random.Random(8)
    sessions = {s: [rng.choice(["", "é" * rng.randint(1, 9), "x" * rng.randint(1, 40), None]) for _ in range(rng.randint(1, 30))] for s in range(20)}
    rows = [("pi", s, i, t) for s, ts in sessions.items() for i, t in enumerate(ts)]
    got = defaultdict(dict)
    for r in endings.lanes(frame(spark, rows, "harness string, session long, ordinal long, text string"), 50).collect():
        got[r["session"]][r["ordinal"]] = r["lane"]
    for s, ts in sessions.items():
        lane, filled, want = 0, 0, []
        for i, t in enumerate(ts):
            n = len((t or "").encode())
            if i and filled + n > 50:
                lane, filled = lane + 1, 0
            filled += n
            want.append(lane)
        assert [got[s][i] for i in range(len(ts))] == want


def test_listing_orders_and_refusals(spark):
    rows = [("pi", 1, stamp(1)), ("pi", 12, None), ("codex", 12, stamp(1)), ("pi", 3, stamp(1))]
    data = spark.createDataFrame(rows, "harness string, session long, last_activity timestamp_ntz")
    got = [(r["harness"], r["session"], r["rank"]) for r in listing.newest_per_harness(data, 2).orderBy("harness", "rank").collect()]
    assert got == [("codex", 12, 1), ("pi", 1, 1), ("pi", 3, 2)]
    assert [r["matches"] for r in listing.resolve(data, "1").collect()] == [1]
    assert {r["matches"] for r in listing.resolve(data, "12").collect()} == {2}
    assert listing.resolve(data, "99").count() == 0


@pytest.mark.parametrize("start,end,minute,day,inside", [(540, 1020, 540, 0, True), (540, 1020, 1020, 0, False), (1320, 360, 1380, 4, True), (1320, 360, 60, 5, True), (1320, 360, 60, 0, False)])
def test_hours_past_midnight(spark, start, end, minute, day, inside):
    at = T0 + timedelta(days=day, minutes=minute)  # a Monday and later
    got = spark.createDataFrame([(at,)], "t timestamp_ntz").select(pricing.in_hours(F.col("t"), start, end, (0, 1, 2, 3, 4)).alias("x")).first()["x"]
    assert got is inside


def test_long_chains_have_no_bound(spark):
    """A chain of 150, one that starts in its middle, and a circle."""
    rows = [(k, k - 1 if k else None) for k in range(150)] + [(200, 201), (201, 202), (202, 200), (300, 299)]
    sessions = frame(spark, rows, "session long, parent long")
    start = spark.createDataFrame([(0,), (120,), (201,), (400,)], "session long")
    got = {r["session"]: r["depth"] for r in lineage.closure(sessions, start).collect()}
    assert got == {k: k if k < 120 else k - 120 for k in range(150)} | {201: 0, 200: 1, 202: 2, 400: 0}
    owned = sessions.withColumn("owner", F.when(F.col("session").isin(0, 130, 202), F.concat(F.lit("k"), F.col("session").cast("string"))))
    got = {r["session"]: r["owner"] for r in lineage.inherited_owner(owned).collect()}
    assert got == {k: "k0" if k < 130 else "k130" for k in range(150)} | {200: "k202", 201: "k202", 202: "k202", 300: None}


def test_resolve_counts_without_one_task_for_all(spark):
    data = frame(spark, [("h", k) for k in (1, 12, 120, 129, 13)], "harness string, session long")
    found = listing.resolve(data, "12")
    assert [(r["session"], r["matches"]) for r in found.collect()] == [(12, 1)]
    assert {(r["session"], r["matches"]) for r in listing.resolve(data, "1").union(listing.resolve(data, "13")).collect()} == {(1, 1), (13, 1)}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_hold_only_sessions_whose_pointer_moves(spark, monkeypatch):
    """Sessions that are settled have no key to be joined by; in a round they would all meet in one task."""
    sizes = []

    def counted(df):
        kept = materialize(df)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(lineage, "materialize", counted)
    rows = [(k, None) for k in range(100)] + [(100, 99), (101, 100)]
    sessions = frame(spark, rows, "session long, parent long")
    assert lineage.closure(sessions, sessions.filter("parent IS NULL").select("session")).count() == 102
    assert sizes[0] == 102 and max(sizes[1:]) <= 2
    sizes.clear()
    owned = sessions.withColumn("owner", F.when(F.col("parent").isNull(), F.concat(F.lit("k"), F.col("session").cast("string"))))
    got = {r["session"]: r["owner"] for r in lineage.inherited_owner(owned).collect()}
    assert got == {k: f"k{min(k, 99)}" for k in range(102)}
    assert sizes[0] == 102 and max(sizes[1:]) <= 2
