"""Evidence by byte, commits found again, members, proofs of absence and subagents' windows on small cases worked out by hand."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lagoon.operators import commits, prefilter, spans
from lagoon.sources import copies, pins

DAY = dt.datetime(2026, 1, 1)


def test_copies_are_the_bytes_of_the_file(spark, tmp_path):
    rng = random.Random(3)
    raw = {}
    for i in range(4):
        rows = [{"n": k, "t": rng.choice(["é", "a\"b", "same"]), "x": [1, {"deep": rng.choice(["u", "v"])}]} for k in range(6)]
        raw[f"f{i}.jsonl"] = "".join(json.dumps(r, ensure_ascii=bool(i % 2), separators=rng.choice([(", ", ": "), (",", ":")])) + "\n" for r in rows).encode()
        (tmp_path / f"f{i}.jsonl").write_bytes(raw[f"f{i}.jsonl"])
    records, _ = pins.replay(pins.pin(spark, str(tmp_path), chunk=50))
    index = copies.index_values(records.select("file", "start", "end")).cache()
    kept, refused = copies.copies(index)
    held = {r["sha256"]: bytes(r["content"]) for r in kept.collect()}
    rows = index.collect()
    for r in rows:
        data = raw[r["file"].rsplit("/", 1)[1]][r["start"] : r["end"]]
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and held[r["sha256"]] == data
        line = raw[r["file"].rsplit("/", 1)[1]][r["record"] :].split(b"\n", 1)[0]
        value = json.loads(line)
        for step in r["pointer"].split("/")[1:]:
            value = value[int(step)] if isinstance(value, list) else value[step]
        assert json.loads(data) == value
    assert len(rows) == 24 * 7 and len(held) == len({r["sha256"] for r in rows}) and refused.count() == 0
    (tmp_path / "f0.jsonl").write_bytes(raw["f0.jsonl"].replace(b"same", b"SAME") + b"{}\n")
    changed = copies.changed_spans(index).collect()
    assert {r["file"].rsplit("/", 1)[1] for r in changed} == {"f0.jsonl"} and len(changed) == 2 * raw["f0.jsonl"].count(b"same")
    index.unpersist()


def diff(path, added, at=1, removed=(), mode=""):
    return "\n".join([f"diff --git a/{path} b/{path}", *([mode] if mode else []), "index 1..2 100644", f"--- a/{path}", f"+++ b/{path}", f"@@ -{at},3 +{at},4 @@ fn", " context", *[f"-{x}" for x in removed], *[f"+{x}" for x in added], " }"])


def sha(name):
    return hashlib.sha1(name.encode()).hexdigest()


def test_patch_id_ignores_place_order_and_blanks(spark):
    one, two = diff("a.rs", ["let x = 1;", "--- not a header"], 10), diff("b.rs", ["fn y() {"], 3, ["old"])
    rows = {
        "as is": one + "\n" + two, "moved": diff("a.rs", ["let x = 1;", "--- not a header"], 99) + "\n" + two, "other order": two + "\n" + one, "blanks": one.replace("let x", "let   x") + "\n" + two,
        "mode": diff("a.rs", ["let x = 1;", "--- not a header"], 10, mode="old mode 100644") + "\n" + two, "other file": one.replace("a.rs", "c.rs") + "\n" + two, "other line": one.replace("1;", "2;") + "\n" + two,
        "less": one, "empty": "diff --git a/x b/x\nold mode 1\nnew mode 2", "nothing": "",
    }
    got = {r["sha"]: r["patch_id"] for r in commits.patch_ids(spark.createDataFrame(list(rows.items()), "sha string, diff string")).collect()}
    assert len({got[k] for k in ("as is", "moved", "other order", "blanks", "mode")}) == 1
    assert len({got[k] for k in ("as is", "other file", "other line", "less")}) == 4
    assert "empty" not in got and "nothing" not in got


def test_observed_revisions(spark):
    lines = [f"line {i} of it" for i in range(8)]
    base = {n: sha(n) for n in ("kept", "rebased", "amended", "twin1", "twin2", "half", "tie1", "tie2")}
    set_ = [
        (base["kept"], diff("k", ["kept only"])), (base["rebased"], diff("r", ["rebased one", "rebased two"], 40)), (base["amended"], diff("m", [*lines[:7], "new end"])),
        (base["twin1"], diff("t", ["twin"])), (base["twin2"], diff("t", ["twin"], 70)), (base["half"], diff("h", ["h1", "h2", "other 1", "other 2"])),
        (base["tie1"], diff("x", ["t one", "t two", "t three", "q"])), (base["tie2"], diff("x", ["t one", "t two", "t three", "p"])),
    ]
    gone = {n: sha("old " + n) for n in ("rebased", "amended", "twin", "half", "tie", "bare")}
    objects = [
        (gone["rebased"], diff("r", ["rebased one", "rebased two"], 4)), (gone["amended"], diff("m", lines)), (gone["twin"], diff("t", ["twin"], 9)), (gone["half"], diff("h", ["h1", "h2", "x1", "x2"])),
        (gone["tie"], diff("x", ["t one", "t two", "t three", "z"])), (gone["bare"], "diff --git a/x b/x\nold mode 1"),
    ]
    asked = [base["kept"], base["kept"][:7].upper(), base["kept"][:5], gone["rebased"], gone["amended"][:9], gone["twin"], gone["half"], gone["tie"], gone["bare"], sha("never"), "main", "abc", ""]
    observed = spark.createDataFrame([(i % 2, r) for i, r in enumerate(asked)], "session int, revision string")
    got = {r["revision"]: (r["sha"], r["how"], r["reason"]) for r in commits.resolve_observed(observed, spark.createDataFrame(set_, "sha string, diff string"), spark.createDataFrame(objects, "sha string, diff string")).collect()}
    assert got == {
        base["kept"]: (base["kept"], "exact", None), base["kept"][:7]: (base["kept"], "exact", None), base["kept"][:5]: (None, None, "missing"), gone["rebased"]: (base["rebased"], "patch-equivalent", None),
        gone["amended"][:9]: (base["amended"], "line-majority", None), gone["twin"]: (None, None, "ambiguous"), gone["half"]: (None, None, "no-equivalent"), gone["tie"]: (None, None, "ambiguous"),
        gone["bare"]: (None, None, "no-equivalent"), sha("never"): (None, None, "missing"), "main": (None, None, "not-a-revision"), "abc": (None, None, "not-a-revision"), "": (None, None, "not-a-revision"),
    }


def test_members_by_rule(spark):
    t = lambda d: DAY + dt.timedelta(days=d)
    sessions = spark.createDataFrame([(i, t(0), t(1)) for i in range(1, 9)] + [(9, t(20), t(30)), (10, t(-9), t(-5)), (11, None, None)], "session int, started timestamp_ntz, last_activity timestamp_ntz")
    places = [
        (1, t(0), "/r/a/deep", None, True), (2, t(0), "/r/ab", None, False), (3, t(0), "/gone/x", "git@H.org:me/p.git", None), (4, t(0), "/gone/x", None, None), (5, t(0), "/made", None, None),
        (6, t(0), "/made", None, None), (7, t(0), "/other", "https://h.org/me/q", None), (9, t(20), "/r/a", None, True), (10, t(-9), "/r/a", None, True), (11, t(0), "/r/a", None, True), (5, t(3), "/later", None, None),
    ]
    locations = spark.createDataFrame(places, "session int, at timestamp_ntz, directory string, remote string, held boolean")
    c = sha("c")
    observed = spark.createDataFrame([(5, t(1), c[:10], True), (7, t(1), sha("d")[:10], True), (8, t(1), c, False)], "session int, at timestamp_ntz, sha string, created boolean")
    lineage = spark.createDataFrame([(2, 1), (12, 2), (13, 7), (1, None)], "session int, parent int")
    found = commits.gather(
        sessions, locations, observed, lineage, spark.createDataFrame([("/r/a",)], "path string"), spark.createDataFrame([("https://h.org/me/p",)], "remote string"), spark.createDataFrame([(c,)], "sha string"), "2026-01-01", "2026-01-05"
    )
    got = {r["session"]: (r["rules"], r["depth"]) for r in found.collect()}
    assert got == {
        1: (["location"], 0), 2: (["lineage"], 1), 12: (["lineage"], 2), 3: (["placed", "remote"], 0), 4: (["placed"], 0), 5: (["commit", "placed"], 0), 6: (["placed"], 0), 8: (["commit"], 0), 11: (["location"], 0),
    }


def test_no_needle_is_missed_however_it_is_written(spark):
    rng = random.Random(9)
    alphabet = 'aAbiIİkKsSßéÉ"\\/\n\tσςΣ語𝒳ǅK '
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(500)]

    def written(text):
        out = ""
        for c in text:
            kind = rng.randrange(3)
            if kind == 0 or ord(c) < 32 or c in '"\\':
                code = c.encode("utf-16-be").hex()
                forms = ["".join(f"\\u{code[i : i + 4]}" for i in range(0, len(code), 4)), "".join(f"\\u{code[i : i + 4].upper()}" for i in range(0, len(code), 4))]
                if c in prefilter.SHORT:
                    forms.append(prefilter.SHORT[c])
                out += rng.choice(forms)
            else:
                out += c
        return '{"text": "' + out + '"}'

    lines = [written(x) for x in texts]
    assert [json.loads(x)["text"] for x in lines] == texts
    frame = spark.createDataFrame(list(zip(texts, lines)), "text string, value string").cache()
    proved = 0
    for needle in ["a", "ki", "i", "é", '"', "\\", "/", "\n", "σ", "ς", "語", "𝒳", "ß", "İ", "aé", "k\"", "ǆ", " s"]:
        rows = frame.select((~F.contains(F.lower("text"), F.lower(F.lit(needle)))).alias("absent"), prefilter.may_hold(F.col("value"), needle).alias("may")).collect()
        assert all(r["may"] or r["absent"] for r in rows), needle
        proved += sum(not r["may"] for r in rows)
    assert proved > 4000
    frame.unpersist()


def test_the_filter_lies_below_the_parser(spark):
    records = spark.createDataFrame([("f", 0, '{"a": 1}')], "file string, line int, value string")
    found = prefilter.search_recordings(records, "needle", lambda r: r.withColumn("x", F.from_json("value", "a int")).filter("x.a > 0"), lambda t: t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and plan.index("from_json") < plan.index("RLIKE")  # further down is earlier in the flow
    assert prefilter.raw_pattern("a") != prefilter.raw_pattern("b") and found.count() == 0


def test_windows_of_families(spark):
    t = lambda h: DAY + dt.timedelta(hours=h)
    rows = [(1, t(1), 10, 1), (1, t(30), 99, 9), (2, t(2), 20, 2), (3, t(3), 30, 3), (5, t(4), 40, 4), (7, t(5), 50, 5), (8, t(6), 60, 6), (9, t(7), 70, 7), (20, t(1), 5, 5)]
    requests = spark.createDataFrame(rows, "session int, at timestamp_ntz, input int, output int")
    sessions = spark.createDataFrame(
        [(1, None, False, None), (2, 1, True, None), (3, 2, True, None), (4, None, False, None), (5, 4, True, None), (6, 4, False, None), (7, 99, True, None), (8, 1, True, 6), (9, 1, False, None)],
        "session int, parent int, subagent boolean, carried_from int",
    )
    got = {(r["session"], r["share"]): (r["reached"], r["requests"], r["sessions"], r["input"]) for r in spans.window_families(requests, sessions, "2026-01-01", "2026-01-02").collect()}
    assert got == {
        (1, "own"): ("window", 1, 1, 10), (1, "subagents"): ("window", 2, 2, 50), (4, "subagents"): ("subagents", 1, 1, 40), (6, "subagents"): ("subagents", 1, 1, 60), (9, "own"): ("window", 1, 1, 70),
        (7, "unclaimed"): ("subagents", 1, 1, 50), (20, "own"): ("window", 1, 1, 5),
    }
    assert sum(v[3] for v in got.values()) == 285


def test_patch_ids_and_added_lines_are_read_in_their_row(spark):
    """A diff is one value: its lines are neither shuffled nor put in order by a window."""
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n kept\n-old line\n+new line\n+ ;\ndiff --git a/y b/y\nindex 1..2\n"
    diffs = spark.createDataFrame([("a", text), ("b", text.replace("@@ -1 +1 @@", "@@ -7 +9 @@").replace("new line", "new  line")), ("c", "diff --git a/y b/y\nindex 1..2\n")], "sha string, diff string")
    ids = commits.patch_ids(diffs)
    got = {r["sha"]: r["patch_id"] for r in ids.collect()}
    assert set(got) == {"a", "b"} and got["a"] == got["b"]
    added = {r["sha"]: len(r["digests"]) for r in commits.added_lines(diffs).collect()}
    assert added == {"a": 1, "b": 1, "c": 0}
    assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()
