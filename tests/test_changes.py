"""Commands, patches, addresses, prices and projections on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lagoon.operators import changes, estimates, reading


@pytest.mark.parametrize(
    ("line", "commands"),
    [
        ("ls -la | grep 'a b' && echo \"x;y\"", [("", ["ls", "-la"]), ("|", ["grep", "a b"]), ("&&", ["echo", "x;y"])]),
        ("a; b & c || d", [("", ["a"]), (";", ["b"]), ("&", ["c"]), ("||", ["d"])]),
        ("echo one # two; three\nnext", [("", ["echo", "one"]), (";", ["next"])]),
        ("cat > out.txt 2>&1 < in", [("", ["cat"])]),
        ("cat <<EOF\nrm -rf x; y\nEOF\nls", [("", ["cat"]), (";", ["ls"])]),
        ("echo a\\ b \\\n c ''", [("", ["echo", "a b", "c", ""])]),
        ("", []),
        ("'unclosed", [("", ["unclosed"])]),
        ("echo x#y", [("", ["echo", "x#y"])]),
    ],
)
def test_commands_are_split(line, commands):
    assert changes.split_command(line) == commands


def test_programs_of_scripts_and_wrappers(spark):
    rows = [(1, '{"command":"sudo bash -lc \'cd /w && FOO=1 cargo test\'; env A=b /usr/bin/make"}'), (2, '{"cmd":["sh","-c","ls"]}'), (3, None), (4, '{"other":1}')]
    got = {r["k"]: [(i["program"]) for i in r["invocations"]] for r in changes.invocations(spark.createDataFrame(rows, "k long, arguments string"), ["k"]).collect()}
    assert got[1] == ["bash", "cd", "cargo", "make"] and got[3] == []
    assert got[2][0] == "sh"


def test_patches_and_unified_diffs(spark):
    patch = "*** Begin Patch\n*** Update File: a.py\n@@\n-old = 1\n+new = 2\n+}\n*** Add File: b.py\n+x = 1\n+x = 1\n*** End Patch"
    diff = "--- a/c.py\n+++ b/c.py\n@@ -1 +1 @@\n-was = 1\n+is = 2\n same = 3"
    rows = spark.createDataFrame([(1, patch), (2, diff), (3, "no patch"), (4, None)], "k long, text string")
    got = {(r["k"], r["path"]): (r["op"], len(r["added"]), len(r["removed"])) for r in changes.edited_digests(changes.patched_lines(rows, ["k"]), ["k"]).collect()}
    assert got == {(1, "a.py"): ("update", 1, 1), (1, "b.py"): ("add", 1, 0), (2, "c.py"): ("update", 1, 1)}


def test_evidence_files(spark):
    lines = [(0, '{"type":"header","version":1}'), (1, '{"type":"event","commit":"c1"}'), (2, "{broken"), (3, '{"type":"header"}'), (4, '{"type":"other"}')]
    good, bad = changes.evidence_records(spark.createDataFrame([("f", *x) for x in lines], "file string, line int, value string"), "type string, version int, commit string")
    assert [(r["line"], r["type"]) for r in good.orderBy("line").collect()] == [(0, "header"), (1, "event")]
    assert sorted(r["line"] for r in bad.collect()) == [2, 3, 4]


def test_rows_a_price_table_may_not_hold(spark):
    d = datetime
    rows = [("a", None, d(2024, 1, 1), d(2024, 6, 1), 1), ("a", None, d(2024, 5, 1), None, 2), ("b", ["a"], d(2023, 1, 1), d(2023, 6, 1), 3), ("c", None, d(2024, 1, 1), d(2024, 1, 1), 1), ("d", None, None, None, -1), ("e", None, None, d(2024, 1, 1), 1), ("e", None, d(2024, 1, 1), None, 1)]
    prices = spark.createDataFrame(rows, "model string, aliases array<string>, from timestamp_ntz, until timestamp_ntz, price long")
    assert {(r["model"], r["reason"]) for r in estimates.refusals(prices, ["price"]).collect()} == {("a", "overlapping-validity"), ("c", "empty-validity"), ("d", "negative-price")}


def test_projection_cuts_whole_characters(spark):
    rows = [("pi", 1, 0, "tool", "é" * 2000), ("pi", 1, 1, "operator", "## heading\n=== x\nplain"), ("pi", 1, 2, "assistant", None)]
    got = {r["ordinal"]: r for r in reading.projection(spark.createDataFrame(rows, "harness string, session long, ordinal long, kind string, text string")).collect()}
    assert got[0]["projected"] == "## 0 tool\n" + "é" * 1024 and got[0]["omitted"] == 4000 - 2048
    assert got[1]["projected"] == "## 1 operator\n\\## heading\n\\=== x\nplain" and got[2]["projected"] == "## 2 assistant\n"


def test_export_writes_one_directory_for_each_view(spark, tmp_path):
    rows = [("pi", s, k, ("operator", "tool")[k % 2], f"text {k}") for s in (1, 2) for k in range(4)]
    made = reading.bundles(reading.projection(spark.createDataFrame(rows, "harness string, session long, ordinal long, kind string, text string")))
    manifest = {(r["session"], r["name"]): r["lines"] for r in reading.export(made, str(tmp_path / "out")).collect()}
    assert manifest == {(s, n): c for s in (1, 2) for n, c in (("context.md", 2), ("trace.md", 4), ("json", 4))}
    back = spark.read.text(str(tmp_path / "out" / "h=pi" / "s=1" / "v=json"))
    assert back.filter(F.col("value").contains('"ordinal":3')).count() == 1


def test_root_of_long_chains_and_circles(spark):
    from lagoon.operators import lineage

    rows = [(k, k - 1 if k else None) for k in range(100)] + [(200, 201), (201, 200), (300, 999)]
    got = {r["session"]: r["root"] for r in lineage.root_of(spark.createDataFrame(rows, "session long, parent long")).collect()}
    assert all(got[k] == 0 for k in range(100)) and got[300] == 300 and got[200] in (200, 201) and len(got) == 103
