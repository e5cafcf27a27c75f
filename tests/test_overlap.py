"""Groups of sessions that overlap: against union-find on odd tables, and what they cost where families lie together."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lagoon import storage
from lagoon.operators import lineage
from lagoon.operators.components import least_reached
from lagoon.plans import queries as registry

SESSIONS = "session long, harness string, parent long"


def find(up, x):
    while up.setdefault(x, x) != x:
        x = up[x]
    return x


def tie(up, a, b):
    a, b = find(up, a), find(up, b)
    up[max(a, b)] = min(a, b)


def grouped(sessions, ids):
    """One row for each session and harness, as the SQL twin has it."""
    sessions, up, of, holders = [s for s in sessions if s[0] is not None], {}, defaultdict(set), defaultdict(set)
    for session, harness, _ in sessions:
        of[session].add(harness)
    for session, id in ids:
        for harness in of[session] - {None} if session in of else ():
            if id is not None:
                holders[harness, id].add(session)
    for held in holders.values():
        for session in held:
            tie(up, session, min(held))
    for session, harness, parent in sessions:
        if harness is not None and harness in of.get(parent, ()):
            tie(up, session, parent)
    return sorted({(s, h, find(up, s)) for s, h, _ in sessions}, key=repr)


def groups_of(spark, sessions, ids, parts):
    given = spark.createDataFrame(sessions, SESSIONS).repartition(parts)
    return lineage.overlap_groups(given, spark.createDataFrame(ids, "session long, id string").repartition(parts))


@pytest.mark.parametrize("rows", [5, 1 << 18])
def test_groups_equal_union_find(spark, monkeypatch, rows):
    monkeypatch.setattr(storage, "ROWS", rows)
    rng = random.Random(rows)
    some = [*range(40), None]
    sessions = [(s, rng.choice(["a", "b", None]), rng.choice([*some, 999])) for s in [*range(40), *range(5), None, None]] + [(100 + k, "c", 101 + k % 30) for k in range(30)]
    ids = [(rng.choice([*some, 77]), rng.choice(["x", "y", "z", None, "w"]) if k < 8 else f"only {k}") for k in range(40)]
    found = [tuple(r) for r in groups_of(spark, sessions, ids, 3).collect()]
    assert sorted(found, key=repr) == grouped(sessions, ids)


def test_families_of_one_task_cost_no_edge(spark, monkeypatch):
    edges = []
    whole = lineage.connected_components
    monkeypatch.setattr(lineage, "connected_components", lambda e: edges.append(e.count()) or whole(e))
    sessions = [(10 * k + j, "a", 10 * k + j - 1 if j else None) for k in range(50) for j in range(10)]
    ids = [(s, f"own {s}") for s, _, _ in sessions] + [(3, "both"), (25, "both")]
    found = {r["session"]: r["component"] for r in groups_of(spark, sessions, ids, 1).collect()}
    assert found == {s: 0 if s // 10 == 2 else s // 10 * 10 for s, _, _ in sessions}
    assert edges == [1]


def test_least_reached_along_a_long_chain():
    n = 5000
    at = np.random.default_rng(3).permutation(n)
    least = least_reached(2 * n, at[:-1], at[1:])
    assert (least[:n] == 0).all() and (least[n:] == np.arange(n, 2 * n)).all()


def test_an_unknown_part_makes_no_request_id(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table orders as select k as o_orderkey, k * 4 as o_custkey, 'F' as o_orderstatus, timestamp '2024-01-01' as o_orderdate, '1' as o_orderpriority from range(1, 5) t(k)")
    con.execute("create table lineitem as select k as l_orderkey, case when k > 2 then 7 end as l_partkey, 3 as l_suppkey, 2.0::double as l_quantity, 0.05::double as l_discount from range(1, 5) t(k)")
    for name in ("orders", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    got = registry.QUERIES["overlap_components"](spark, str(tmp_path)).select("session", "harness", "component").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select session, harness, component from ({registry.ORACLE['overlap_components']})").fetchall())
