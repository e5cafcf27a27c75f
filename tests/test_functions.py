"""Scalar rules, evidence joins and streams on small tables."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lagoon.functions import scalars
from lagoon.operators import evidence
from lagoon.streaming import ingest


def apply(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").coalesce(1)
    return [r["x"] for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_byte_sizes(spark):
    values = ["64KiB", "8m", "1GB", "1.5GB", "12", "3 kb", "2b", "x", "5q", None, "1.2.3"]
    assert apply(spark, scalars.byte_size, values) == [65536, 8 << 20, 10**9, 1_500_000_000, 12, 3000, 2, None, None, None, None]


def test_durations(spark):
    assert apply(spark, scalars.duration_ms, ["45m", "1h 30m", "250ms", "2days", "soon", None, "5"]) == [2_700_000, 5_400_000, 250, 172_800_000, None, None, None]


def test_credentials(spark):
    values = ["https://me:pw@host/x?y", "ssh://git@host:22/x", "git@host:path", "https://host/a@b", "https://a@b@host/x", None]
    assert apply(spark, scalars.without_credentials, values) == ["https://host/x?y", "ssh://host:22/x", "git@host:path", "https://host/a@b", "https://host/x", None]


def test_lines(spark):
    assert apply(spark, scalars.single_line, ["a\nb\tc", "x"]) == ["a b c", "x"]
    assert apply(spark, scalars.escaped, ["## a\nb\n\\c\ntool: d", "plain"]) == ["\\## a\nb\n\\\\c\n\\tool: d", "plain"]
    want = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big", signed=True) for x in ("  keep", "a b")]
    assert apply(spark, scalars.line_digest, ["  keep  ", "a b", "};", "   ", None]) == [*want, None, None, None]


@pytest.mark.parametrize("most", range(9))
def test_byte_caps_end_on_characters(spark, most):
    values = ["aé€😀z", "abc", "", None]
    want = [None if v is None else v.encode()[:most].decode(errors="ignore") for v in values]
    assert apply(spark, lambda c: scalars.byte_capped(c, most), values) == want


def test_launch_parent(spark):
    got = apply(spark, lambda c: scalars.launch_parent(c, "parent:"), ["parent: pi:a-1\nrest", "parent: pi:", "other", "parent: emacs:x"])
    assert [(r["harness"], r["id"]) if r else None for r in got] == [("pi", "a-1"), None, None, None]


def test_edits_meet_commits(spark):
    edits = spark.createDataFrame([("e1", [1, 2, 3, 4]), ("e2", [5]), ("e3", [9, 8, 9])], "edit string, digests array<long>")
    commits = spark.createDataFrame([("aaaaaaa1", [1, 2, 7]), ("bbbbbbb2", [1, 2, 3, 5]), ("aaaaaaa9", [8])], "sha string, digests array<long>")
    got = {(r["edit"], r["sha"]): (r["common"], r["overlap"]) for r in evidence.edit_overlap(edits, commits).collect()}
    assert got == {("e1", "aaaaaaa1"): (2, 0.5), ("e1", "bbbbbbb2"): (3, 0.75), ("e3", "aaaaaaa9"): (1, 0.5)}
    best = {r["edit"]: r["sha"] for r in evidence.best_edit_commit(evidence.edit_overlap(edits, commits)).collect()}
    assert best == {"e1": "bbbbbbb2", "e3": "aaaaaaa9"}
    seen = spark.createDataFrame([(1, "aaaaaaa"), (2, "bbbbbbb"), (3, "aaaaaaa1"), (4, "ccccccc")], "session long, revision string")
    assert {(r["session"], r["sha"]) for r in evidence.observed_commits(seen, commits).collect()} == {(2, "bbbbbbb2"), (3, "aaaaaaa1")}


def test_stream_of_stretches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("pi", 1, start + timedelta(minutes=m)) for m in (0, 30, 200, 210, 2000)]
    spark.createDataFrame(rows, "harness string, session long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("harness string, session long, ts timestamp").parquet(str(tmp_path / "in"))
    query = ingest.stretches(stream).writeStream.outputMode("append").format("memory").queryName("stretched").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["turns"] for r in spark.sql("select * from stretched").collect()) == [2, 2]


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\nnot json\n')
    query = ingest.new_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lined").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["ok"] for r in spark.sql("select * from lined").collect()) == [False, True]


def test_instants_and_shapes(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02", "1704164645", "1704164645000", "1704164645.5", "soon", None]
    got = [r[0] and r[0].isoformat() for r in spark.createDataFrame([(x,) for x in rows], "t string").select(scalars.instant(F.col("t"))).collect()]
    assert got == ["2024-01-02T03:04:05", "2024-01-02T00:00:00", "2024-01-02T03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05.500000", None, None]
    shape = spark.createDataFrame([('{"a":1,"b":["x"]}',), ("{bad",)], "t string").select(scalars.json_shape(F.col("t")).alias("s")).collect()
    assert shape[0]["s"] == "OBJECT<a: BIGINT, b: ARRAY<STRING>>" and shape[1]["s"] is None


def test_titles_leave_envelopes_out(spark):
    from lagoon.operators import turns

    rows = [("<environment_context>cwd</environment_context>\n fix  it",), ("<skill>only</skill>",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(turns.title(F.col("t"))).collect()] == ["fix it", None]
