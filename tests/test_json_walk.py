"""Walks over JSON of any shape against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from lagoon.operators import json_walk

KEYS = ["content_references", "items", "sources", "source", "type", "url", "title", "start_idx", "path", "sha256", "size", "a", "b"]


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 6 else 4)
    if kind >= 5 or depth < 2:
        return {k: made(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(1, 6))}
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return ["text", rng.randrange(-3, 9), None, True][kind]


def text(value, *keys):
    return next((value[k] for k in keys if isinstance(value.get(k), str)), None)


def number(value, *keys):
    return next((value[k] for k in keys if isinstance(value.get(k), int) and not isinstance(value.get(k), bool) and value[k] >= 0), None)


def children(value):
    return [(k, value[k]) for k in sorted(value, key=str.encode)] if isinstance(value, dict) else list(enumerate(value))


def references(value, depth=0, out=None):
    out = [] if out is None else out
    if depth >= json_walk.DEPTH:
        return out
    if isinstance(value, dict):
        found = (text(value, "uri", "url", "href", "asset_pointer"), text(value, "path"), text(value, "digest", "sha256", "file_id", "fileId"), number(value, "bytes", "size", "byte_count", "size_bytes"))
        if any(x is not None for x in found):
            out.append(found)
    if isinstance(value, dict | list):
        for _, v in children(value):
            references(v, depth + 1, out)
    return out


def cited(value):
    out = []

    def fields(v):
        found = (text(v, "type"), text(v, "uri", "url", "href"), text(v, "title"), number(v, "start_idx", "start_index", "start"), number(v, "end_idx", "end_index", "end"))
        return found if any(x is not None for x in found) else None

    def seek(v):
        if isinstance(v, dict):
            for k, x in children(v):
                take(x) if k == "content_references" else seek(x)

    def take(v):
        if isinstance(v, dict) and fields(v):
            mine = [fields(v), []]
            out.append(mine)
            for k, x in children(v):
                if k in json_walk.SOURCES:
                    below(x, mine[1])
        elif isinstance(v, dict | list):
            for _, x in children(v):
                take(x)

    def below(v, held):
        if isinstance(v, dict) and fields(v):
            held.append(fields(v))
            for k, x in children(v):
                if k in json_walk.SOURCES:
                    below(x, held)
        elif isinstance(v, dict | list):
            for _, x in children(v):
                below(x, held)

    seek(value)
    return out


def test_walks_equal_recursion(spark):
    rng = random.Random(6)
    values = [made(rng) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "no json"), (901, None), (902, "[]"), (903, "7")], "doc int, value string")
    got = {}
    for r in json_walk.artifact_references(rows, ["doc"], "value", most=5).orderBy("doc", "place").collect():
        got.setdefault(r["doc"], []).append((r["uri"], r["path"], r["digest"], r["bytes"]))
    assert got == {i: references(v)[:5] for i, v in enumerate(values) if references(v)}
    found, told = json_walk.citations(rows, ["doc"], "value", most=4)
    held, sources = {}, {}
    for r in found.orderBy("doc", "place", "source").collect():
        where = held.setdefault(r["doc"], []) if r["source"] is None else sources.setdefault((r["doc"], r["place"]), [])
        where.append((r["kind"], r["uri"], r["title"], r["start"], r["end"]))
    want = {i: cited(v) for i, v in enumerate(values)}
    assert held == {i: [c[0] for c in v[:4]] for i, v in want.items() if v}
    assert sources == {(i, n + 1): c[1][:4] for i, v in want.items() for n, c in enumerate(v[:4]) if c[1]}
    counts = {r["doc"]: (r["citations"], r["omitted"], r["incomplete"]) for r in told.collect()}
    assert all(counts[i] == (min(len(v), 4), max(len(v) - 4, 0), False) for i, v in want.items() if v)


def test_depth_ends_the_walk(spark):
    deep = {"path": "bottom"}
    for _ in range(40):
        deep = {"a": deep}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps({"a": {"path": "top"}}))], "doc int, value string")
    assert [r["doc"] for r in json_walk.artifact_references(rows, ["doc"], "value").collect()] == [2]
    _, told = json_walk.citations(rows, ["doc"], "value")
    assert {r["doc"]: r["incomplete"] for r in told.collect()} == {1: True, 2: False}


def test_texts_are_read_as_variants_are(spark):
    texts = [
        '{"path": "a", "size": 9223372036854775807}', '{"path": "b", "size": 9223372036854775808}', '{"path": "c", "size": 1.0}', '{"path": "d", "size": ' + "9" * 5000 + "}", '{"path": "e", "size": 1e3}',
        '{"path": "f", "path": "twice"}', '{"path": NaN}', '  {"path": "\\ud83d\\ude00"}', '{"path": "\\ud83d"}', '{"\ud83d\ude00": {"path": "astral"}, "\uffee": {"path": "wide"}}', '{"path": "g"', '{"path": 3, "bytes": true}',
    ]
    rows = spark.createDataFrame(list(enumerate(t.encode("utf-16", "surrogatepass").decode("utf-16") for t in texts)), "doc int, value string")
    got = sorted(json_walk.artifact_references(rows, ["doc"], "value").select("doc", "place", "path", "bytes").collect(), key=lambda r: r[:2])
    # what Spark itself makes of them
    path, size = F.expr("try_variant_get(try_parse_json(value), '$.path', 'string')"), F.expr("try_variant_get(try_parse_json(value), '$.size', 'bigint')")
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(value), '$.size', 'variant'))")
    plain = rows.filter("doc NOT IN (9, 11) AND try_parse_json(value) IS NOT NULL").select("doc", F.lit(1), path, F.when(kind == "BIGINT", size)).filter(F.col(rows.columns[0]) >= 0)
    want = sorted([*map(tuple, plain.filter(path.isNotNull()).collect()), (9, 1, "astral", None), (9, 2, "wide", None)])
    assert [tuple(r) for r in got] == want


def test_one_pass_without_rounds(spark, monkeypatch):
    """A walk is one step of tasks: nothing is written between levels."""
    monkeypatch.setattr("lagoon.storage.materialize", None)
    rows = spark.createDataFrame([(1, '{"a":{"b":[{"path":"p"}]}}')], "doc int, value string")
    plan = json_walk.artifact_references(rows, ["doc"], "value")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "lagoon-" not in plan and "Exchange" not in plan
