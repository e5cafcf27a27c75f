"""Rows are dealt by their number where compressed bytes would put too many into one task."""

import pytest
from pyspark.sql import functions as F

from lagoon import storage
from lagoon.operators import intervals
from lagoon.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 100)


def test_a_small_table_stays(spark):
    rows = spark.range(10)
    assert storage.spread(rows, 10, "id") is rows


def test_requests_are_dealt_by_their_number(spark, small):
    requests = tables.line_requests(spark, DATA)
    n = requests.count()
    assert requests.rdd.getNumPartitions() == n // 100 + 1
    assert requests.groupBy("session").agg(F.max("ordinal").alias("n"), F.count("*").alias("m")).filter("n <> m").isEmpty()


def test_overlay_is_dealt_and_gives_the_same(spark, small):
    rows = [(k, f"2024-01-01 {k % 20:02}:00:00", f"2024-01-01 {k % 20 + 2:02}:00:00", f"w{k}") for k in range(300)]
    pieces = spark.createDataFrame(rows, "session long, a string, b string, work string").select("session", F.col("a").cast("timestamp_ntz").alias("from"), F.col("b").cast("timestamp_ntz").alias("to"), "work")
    covers = pieces.select("session", (F.col("from") + F.expr("INTERVAL 1 HOUR")).alias("from"), "to")
    plain, dealt = (intervals.overlay(pieces, covers, ["session"], ["work"], [], rows) for rows in (0, 1200))
    assert dealt.rdd.getNumPartitions() == 13
    assert dealt.count() == 600 and plain.exceptAll(dealt).isEmpty()
