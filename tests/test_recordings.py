"""Readers on small recordings written here."""

import json
import os

from pyspark.sql import functions as F

from lagoon.operators import pairing, usage
from lagoon.plans import recorded
from lagoon.sources import recordings


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def test_lines_keep_order_and_gaps(spark, tmp_path):
    many = [{"n": k, "pad": "x" * (k % 50)} for k in range(3000)]
    path = write(tmp_path / "a.jsonl", [*many[:100], "{not json", *many[100:]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        records, gaps = recordings.lines(spark, path)
        got = [(r["line"], json.loads(r["value"])["n"]) for r in records.orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [n for _, n in got] == list(range(3000)) and [k for k, _ in got][99:101] == [99, 101]
    assert [(r["line"], r["reason"]) for r in gaps.collect()] == [(100, "malformed")]


def claude_rows():
    def assistant(uuid, request, parts, output):
        return {"type": "assistant", "sessionId": "s1", "uuid": uuid, "requestId": request, "timestamp": "2026-01-01T10:00:05Z", "message": {"role": "assistant", "model": "m-20250101", "content": parts, "usage": {"input_tokens": 10, "output_tokens": output, "cache_read_input_tokens": 3}}}

    return [
        {"type": "user", "sessionId": "s1", "uuid": "u1", "timestamp": "2026-01-01T10:00:00Z", "origin": {"kind": "human"}, "message": {"role": "user", "content": "please look"}},
        {"type": "user", "sessionId": "s1", "uuid": "u2", "isMeta": True, "message": {"role": "user", "content": "context"}},
        {"type": "user", "sessionId": "s1", "uuid": "u3", "message": {"role": "user", "content": "<command-name>/go</command-name>\n<command-args></command-args>"}},
        assistant("a1", "r1", [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "bash", "input": {"command": "ls"}}], 1),
        "{broken",
        assistant("a2", "r1", [{"type": "text", "text": "done"}], 7),
        {"type": "user", "sessionId": "s1", "uuid": "u4", "timestamp": "2026-01-01T10:00:09Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}]}},
        {"type": "user", "sessionId": "s1", "uuid": "u5", "message": {"role": "user", "content": "[Request interrupted by user]"}},
    ]


def test_claude(spark, tmp_path):
    records, gaps = recordings.lines(spark, write(tmp_path / "s1.jsonl", claude_rows()))
    turns = recordings.claude_turns(records).orderBy("ordinal").collect()
    assert [r["kind"] for r in turns] == ["operator", "ambient", "control", "reasoning", "tool", "assistant", "tool", "notice"]
    assert gaps.count() == 1 and json.loads(turns[4]["arguments"]) == {"command": "ls"}
    events = recordings.claude_turns(records).filter("direction IS NOT NULL")
    call = pairing.pair_events(events).filter("direction = 'call'").first()
    assert call["pair"] == 6 and call["duration_ms"] == 4000
    folded = usage.fold_requests(recordings.claude_requests(records), ["session", "request"]).collect()
    assert [(r["request"], r["records"], r["input"], r["output"], r["cache_write"]) for r in folded] == [("r1", 2, 10, 7, None)]


def test_codex(spark, tmp_path):
    def item(**payload):
        return {"timestamp": "2026-01-01T10:00:00Z", "type": "response_item", "payload": payload}

    def count(total, last=None):
        info = {"total_token_usage": {"input_tokens": total}, "last_token_usage": last and {"input_tokens": last}} if total else None
        return {"timestamp": "2026-01-01T10:00:01Z", "type": "event_msg", "payload": {"type": "token_count", "info": info, "rate_limits": {"limit_id": "codex", "primary": {"used_percent": "12.5", "window_minutes": 300, "resets_at": 1767265200}}}}

    rows = [
        {"timestamp": "2026-01-01T10:00:00Z", "type": "session_meta", "payload": {"id": "c1", "cwd": "/w"}},
        {"timestamp": "2026-01-01T10:00:00Z", "type": "turn_context", "payload": {"model": "big", "effort": "high"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "<environment_context>x</environment_context>"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "<turn_aborted>x</turn_aborted>"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "fix it"}]),
        item(type="function_call", name="shell", arguments="{}", call_id="k1"),
        item(type="function_call_output", call_id="k1", output="fine"),
        {"timestamp": "2026-01-01T10:00:01Z", "type": "event_msg", "payload": {"type": "item_completed", "item": {"id": "k1", "type": "CommandExecution"}}},
        {"timestamp": "2026-01-01T10:00:01Z", "type": "event_msg", "payload": {"type": "item_completed", "item": {"id": "k2", "type": "FileChange"}}},
        count(10, 10), count(25, 15), count(5, 5), count(5, 5), count(None), count(9),
    ]
    records, _ = recordings.lines(spark, write(tmp_path / "rollout.jsonl", rows))
    turns = recordings.codex_turns(records).orderBy("ordinal").collect()
    assert [(r["kind"], r["direction"]) for r in turns] == [("ambient", None), ("notice", None), ("operator", None), ("tool", "call"), ("tool", "result"), ("tool", "call")]
    assert {r["session"] for r in turns} == {"c1"} and turns[2]["model"] == "big" and turns[5]["call_id"] == "k2"
    told = usage.classify_totals(recordings.codex_totals(records), ["session"])
    assert [(r["classification"], r["counted"], r["epoch"], r["model"]) for r in told.orderBy("ordinal").collect()] == [
        ("advance", True, 0, "big"), ("advance", True, 0, "big"), ("reset-advance", True, 1, "big"), ("unchanged-total", False, 1, "big"), ("quota-only", False, 1, "big"), ("advance", False, 1, "big")
    ]
    whole = usage.totals_accounting(told, ["session"]).first()
    assert (whole["input"], whole["requests"], whole["requests_input"], whole["coverage"]) == (9, 3, 10 + 15 + 5, "since-reset")
    tail = usage.classify_totals(recordings.codex_totals(records), ["session"], bounded=True).orderBy("ordinal").first()
    assert tail["classification"] == "leading-uncounted"
    assert {(r["pool"], r["percent"], r["window_minutes"]) for r in recordings.codex_quota(records).collect()} == {("codex/primary", 12.5, 300)}


def test_pi_active_branch(spark, tmp_path):
    def entry(i, parent, role, text, **more):
        return {"type": "message", "id": i, "parentId": parent, "timestamp": "2026-01-01T10:00:00Z", "message": {"role": role, "timestamp": 1767261600000, "content": [{"type": "text", "text": text}], **more}}

    used = {"usage": {"input": 1, "output": 2, "totalTokens": 3, "cost": {"total": 0.0}}, "model": "m"}
    rows = [{"type": "session", "id": "p1", "version": 1, "cwd": "/w"}, entry("a", None, "user", "one"), entry("b", "a", "assistant", "left", **used), entry("c", "a", "assistant", "right", **used)]
    rows += [entry(f"d{k}", f"d{k - 1}" if k else "c", "user", f"more {k}") for k in range(9)]
    records, _ = recordings.lines(spark, write(tmp_path / "x_p1.jsonl", rows))
    assert [r["text"] for r in recordings.pi_turns(records).orderBy("ordinal").collect()] == ["one", "right", *[f"more {k}" for k in range(9)]]
    requests = {r["request"]: r for r in recordings.pi_requests(records).collect()}
    assert {k: r["active"] for k, r in requests.items()} == {"b": False, "c": True} and requests["b"]["unpriced"] and requests["b"]["cost"] is None


def test_opencode(spark):
    messages = spark.createDataFrame([("m1", "o1", 1, '{"role":"user"}'), ("m2", "o1", 2, '{"role":"assistant","modelID":"z","cost":0.5,"tokens":{"input":3,"output":4,"reasoning":1,"cache":{"read":0,"write":2}}}')], "id string, session_id string, time_created long, data string")
    parts = spark.createDataFrame([("q2", "m2", "o1", 5, '{"type":"tool","tool":"bash","callID":"k","state":{"status":"error","input":"{}"}}'), ("q1", "m1", "o1", 4, '{"type":"text","text":"hi"}')], "id string, message_id string, session_id string, time_created long, data string")
    assert [(r["ordinal"], r["kind"], r["is_error"]) for r in recordings.opencode_turns(messages, parts).orderBy("ordinal").collect()] == [(0, "operator", None), (1, "tool", True)]
    assert [(r["input"], r["cache_write"], r["cost"]) for r in recordings.opencode_requests(messages).collect()] == [(3, 2, 0.5)]


def test_exports(spark):
    listed = {"id": "e1", "title": "t", "messages": [{"id": "1", "role": "user", "content": "q"}, {"id": "2", "role": "assistant", "content": "a"}]}
    asked = {"context_uuid": "e2", "entries": [{"query": "q1", "answer": "a1", "created_at": "2026-01-01"}, {"query": "q2", "answer": "a2"}]}
    mapped = {"conversation_id": "e3", "mapping": {"n": {"parent": None}}}
    both = {"conversations": [], "mapping": {"n": {}}}
    frame = spark.createDataFrame([(json.dumps(x),) for x in (listed, asked, mapped, both, {"z": 1})], "value string")
    assert [r[0] for r in frame.select(recordings.export_format(F.col("value"))).collect()] == ["chatgpt-exporter", "perplexity", "openai", "ambiguous", None]
    got = [(r["session"], r["ordinal"], r["kind"], r["text"]) for r in recordings.export_turns(frame).orderBy("session", "ordinal").collect()]
    assert got == [("e1", 0, "operator", "q"), ("e1", 1, "assistant", "a"), ("e2", 0, "operator", "q1"), ("e2", 1, "assistant", "a1"), ("e2", 2, "operator", "q2"), ("e2", 3, "assistant", "a2")]


def test_exported_graphs_and_pairs(spark):
    def node(i, parent, role=None, *parts):
        return {"id": i, "parent": parent, "message": role and {"id": i, "author": {"role": role}, "create_time": 1767261600.5, "content": {"content_type": "text", "parts": list(parts)}}}

    graph = {"conversation_id": "g1", "current_node": "d", "mapping": {x["id"]: x for x in (node("r", None), node("a", "r", "user", "one", "two"), node("b", "a", "assistant", "left"), node("c", "a", "assistant", "right"), node("d", "c", "user", "more"))}}
    pair = {"id": "g2", "prompt": "why", "answer": "so"}
    frame = spark.createDataFrame([(json.dumps(x),) for x in (graph, pair)], "value string")
    got = [(r["session"], r["ordinal"], r["kind"], r["text"]) for r in recordings.export_turns(frame).orderBy("session", "ordinal").collect()]
    assert got == [("g1", 0, "operator", "one\ntwo"), ("g1", 1, "assistant", "right"), ("g1", 2, "operator", "more"), ("g2", 0, "operator", "why"), ("g2", 1, "assistant", "so")]


def test_catalog_and_line_numbers_over_blocks(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"s{k}.jsonl").write_text("".join(json.dumps({"n": i, "pad": "x" * 50}) + "\n" for i in range(200 + k)) + "\n{bad\n")
        os.utime(tmp_path / f"s{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
    listed = recordings.catalog(spark, str(tmp_path), limit=3).orderBy("rank").collect()
    assert [r["file"][-8:] for r in listed] == ["s3.jsonl", "s2.jsonl", "s1.jsonl"] and all(r["scan_truncated"] for r in listed)
    assert recordings.catalog(spark, str(tmp_path), limit=9, modified_after="2023-11-14T22:13:21").count() == 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        records, gaps = recordings.lines(spark, str(tmp_path))
        assert records.filter(F.get_json_object("value", "$.n").cast("long") != F.col("line")).count() == 0 and records.count() == 806
        assert sorted(r["line"] for r in gaps.collect()) == [201, 202, 203, 204]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_canonical_path(spark):
    nodes = [("a", "r", None, "n6"), *[("a", f"n{k}", f"n{k - 1}" if k else "r", "n6") for k in range(7)], ("a", "side", "n2", "n6"), ("b", "x", "y", "x"), ("b", "y", "x", "x"), ("c", "z", "gone", "z")]
    frame = spark.createDataFrame(nodes, "session string, id string, parent string, current string")
    got = {(r["session"], r["id"]): r["depth"] for r in recordings.mapping_path(frame, ["session"]).collect()}
    assert got == {("a", "r"): 7, **{("a", f"n{k}"): 6 - k for k in range(7)}, ("b", "x"): 0, ("b", "y"): 1, ("c", "z"): 0}


def test_bundled_recordings_read_as_files_do(spark, tmp_path):
    """Numbers, gaps and blank lines of many recordings are those of files of their own, in few files."""
    rows = [(f"r{s}", n, "" if n == 3 else "{bad" if n % 4 == 1 else json.dumps({"s": s, "n": n, "tab": "\t"})) for s in range(300) for n in range(6 + s % 3)]
    recordings.bundle(spark.createDataFrame(rows, "name string, n long, value string").repartition(7), f"{tmp_path}/bundle", "n")
    assert len(list((tmp_path / "bundle").glob("part-*"))) <= 8
    for s in range(0, 300, 60):
        write(tmp_path / "files" / f"r{s}", [v for name, _, v in rows if name == f"r{s}"])
    (records, gaps), (there, its_gaps) = recordings.bundled_lines(spark, f"{tmp_path}/bundle"), recordings.lines(spark, f"{tmp_path}/files")
    some = F.col("file").isin(*[f"r{s}" for s in range(0, 300, 60)])
    own = F.element_at(F.split("file", "/"), -1)
    for a, b in ((records.filter(some), there), (gaps.filter(some), its_gaps)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.withColumn("file", own).collect()))


def test_the_conversations_recordings_are_few_files(spark):
    folder = recorded.recorded(spark, "/root/testdata/sf0.001", [F.to_json(F.struct("role"))])
    files = spark.read.text(folder).inputFiles()
    assert len(files) <= 8 < spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
