"""Each edit's best commit: against counting by hand, against SQL on odd tables, and what it shuffles."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lagoon import storage
from lagoon.operators import evidence
from lagoon.plans import queries as registry


def counted(edits, commits, share, least):
    found = {}
    for edit, lines in edits:
        n, own = len(set(lines)), set(lines) - {None}
        met = [(-len(own & set(adds)), sha is None, sha, len(own & set(adds))) for sha, adds in commits]
        met = [m for m in met if m[3] and m[3] / n >= share]
        if edit is not None and n >= least and met:
            *_, sha, common = min(met, key=lambda m: (m[0], m[1], m[2] or ""))
            found[edit] = (sha, common, common / n)
    return found


@pytest.mark.parametrize("rows, head", [(3, 0), (3, 5), (1 << 18, 1 << 17)])
def test_best_overlaps_equal_counting(spark, monkeypatch, rows, head):
    monkeypatch.setattr(storage, "ROWS", rows)
    monkeypatch.setattr(evidence, "HEAD", head)
    rng = random.Random(head)
    line = lambda: rng.choice([None, *range(40)]) if rng.random() < 0.5 else rng.randrange(4)
    commits = [(f"c{i}" if i else None, [line() for _ in range(rng.randrange(30))]) for i in range(40)] + [("z", list(range(100, 400)))]
    edits = [(i, [line() for _ in range(rng.randrange(9))]) for i in range(150)] + [(None, [1, 2]), (200, [9, 9]), (201, [77, 78])]
    edits += [(300 + i, rng.sample(commits[i][1], min(5, len(commits[i][1]))) + [80] * (i % 2)) for i in range(40)] + [(400, list(range(90, 250)))]
    given, made = spark.createDataFrame(edits, "edit int, digests array<long>"), spark.createDataFrame(commits, "sha string, digests array<long>")
    for share, least in ((0.5, 2),) if rows == 3 else ((0.5, 2), (1.0, 1), (0.0, 0)):
        found = evidence.best_overlaps(given, made, share, least)
        assert {r["edit"]: (r["sha"], r["common"], r["overlap"]) for r in found.collect()} == counted(edits, commits, share, least)
    assert found.columns == evidence.best_edit_commit(evidence.edit_overlap(given, made)).columns


def test_no_commits_and_no_edits_give_no_rows(spark):
    given, made = spark.createDataFrame([(1, [1, 2])], "edit int, digests array<long>"), spark.createDataFrame([("a", [1])], "sha string, digests array<long>")
    assert evidence.best_overlaps(given, made.filter("false")).count() == evidence.best_overlaps(given.filter("false"), made).count() == 0


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_pairs_that_share_a_line_are_not_shuffled(spark, tmp_path):
    # 200 lines and some 180 customers of each part: 14 million pairs of an edit and a commit share a line
    key = F.col("id")
    spark.range(20_000).select(key.alias("o_orderkey"), F.pmod(F.xxhash64(key), F.lit(1000)).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(400))
    spark.range(80_000).select(F.expr("id div 4").alias("l_orderkey"), part.alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = shuffled(spark)
    assert registry.QUERIES["edit_commits"](spark, str(tmp_path)).count() == 20_000
    assert shuffled(spark) - before < 10_000_000


def test_edit_commits_equals_sql_on_odd_tables(spark, tmp_path):
    rng = random.Random(6)
    orders = [(k if rng.random() < 0.9 else None, rng.choice([None, 1, 2, 3, 10])) for k in range(60)] + [(5, 1), (5, 2)]
    lines = [(rng.choice([None, *range(80)]), rng.choice([None, *range(12)])) for _ in range(240)]
    con = duckdb.connect()
    con.execute("create table orders (o_orderkey bigint, o_custkey bigint)")
    con.execute("create table lineitem (l_orderkey bigint, l_partkey bigint)")
    con.executemany("insert into orders values (?, ?)", orders)
    con.executemany("insert into lineitem values (?, ?)", lines)
    for name in ("orders", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    got = registry.QUERIES["edit_commits"](spark, str(tmp_path)).select("edit", "sha", "common", "overlap").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(f"select edit, sha, common, overlap from ({registry.ORACLE['edit_commits']})").fetchall(), key=repr)
