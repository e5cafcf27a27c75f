"""Ends of files by byte and members of archives against reads of the whole; spans of JSON values against the parser."""

import json
import os
import random
import zipfile

import pytest

from lagoon.functions.json_spans import value_spans
from lagoon.sources import ranges


@pytest.fixture(scope="module")
def known(spark):
    ranges.register(spark)
    return spark


def tails(spark, folder, **options):
    got = spark.read.format("recording_tail").options(anyBytes="1", **options).load(str(folder))
    return sorted((os.path.basename(r["file"]), r["part"], r["start"], r["end"], r["value"], r["reason"]) for r in got.collect())


def test_tail_is_cut_at_lines(known, tmp_path):
    body = b'{"a": 1}\n\n{"b": "x"}\n{"c": "\xc3\xa9"}\n{"d": 4}'
    (tmp_path / "a.jsonl").write_bytes(body)
    lines = [(m, m + len(x)) for x in (b'{"a": 1}\n', b'{"b": "x"}\n', b'{"c": "\xc3\xa9"}\n', b'{"d": 4}') for m in [body.index(x)]]
    for n in range(1, len(body) + 5):
        got = tails(known, tmp_path, bytes=str(n))
        begin = max(0, len(body) - n)
        want = [("a.jsonl", "tail", a, b, body[a:b].decode().strip("\n"), None) for a, b in lines if a >= begin]
        assert [r for r in got if r[1] == "tail"] == want
        if begin:
            assert ("a.jsonl", "gap", 0, begin, None, "outside-tail-bound") in got
            assert [r[2:4] for r in got if r[1] == "head"] == lines
            split = [r for r in got if r[5] == "discarded-partial-record"]
            assert bool(split) == (body[begin - 1 : begin] != b"\n")
            for r in split:
                assert (r[2], r[3]) == (begin, (body.find(b"\n", begin) + 1) or len(body))
        else:
            assert len(got) == 4


def test_tail_reads_the_planned_ranges_only(tmp_path):
    class Watched:
        def __init__(self, data):
            self.data, self.asked = data, []

        def read_at(self, n, offset):
            self.asked.append((offset, offset + n))
            return self.data[offset : offset + n]

    data = b"".join(b'{"n": %d, "pad": "%s"}\n' % (i, b"x" * 900) for i in range(3000))
    file = Watched(data)
    list(ranges.read_tail(file, len(data), 70_000, 1 << 20))
    assert file.asked == [(len(data) - 70_001, len(data)), (0, ranges.HEAD_BYTES)]
    long = Watched(b'{"a": "' + b"x" * 200_000 + b'"}\n' + data)
    got = list(ranges.read_tail(long, len(long.data), 1000, 1 << 20))
    assert long.asked[-1] == (0, ranges.MOST_HEAD) and next(r for r in got if r[0] == "head")[2] == 200_010
    assert list(ranges.read_tail(Watched(data[:100]), 200, 500, 1 << 20))[0] == ("gap", 100, 200, None, "changed-during-read")


def test_tails_of_many_files_are_packed(known, tmp_path):
    for i in range(20):
        (tmp_path / f"f{i:02}.jsonl").write_text("".join(f'{{"n": {k}}}\n' for k in range(i)))
    (tmp_path / "_hidden.jsonl").write_text("{}\n")
    (tmp_path / "other.txt").write_text("{}\n")
    frame = known.read.format("recording_tail").options(partitionBytes="100").load(str(tmp_path))
    assert frame.rdd.getNumPartitions() > 5
    assert frame.filter("part = 'tail'").groupBy("file").count().count() == 19  # the first is empty
    assert frame.filter("part <> 'tail'").count() == 0
    with pytest.raises(Exception, match="bytes must be"):
        known.read.format("recording_tail").options(bytes="10").load(str(tmp_path)).count()
    empty = tmp_path / "none"
    empty.mkdir()
    assert known.read.format("recording_tail").load(str(empty)).count() == 0


def test_lines_too_long_are_told(known, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"b": "' + "x" * 500 + '"}\n{"c": 3}\n')
    got = tails(known, tmp_path, recordBytes="100")
    assert [(r[1], r[2], r[5]) for r in got] == [("gap", 9, "oversize"), ("tail", 0, None), ("tail", 519, None)]


def test_members_and_budgets(known, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("conversations.json", json.dumps([{"id": i, "t": "é, [x] \\\" }"} for i in range(50)]))
        z.writestr("deep/more.json", '{"one": [1, 2]}')
        z.writestr("picture.png", b"\x00")
        z.writestr("../out.json", "{}")
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k": 2}\n\n')
    (tmp_path / "c.zip").write_bytes(b"no archive")
    (tmp_path / "d.json").write_text('[{"x": 1}, 7, "s", {"y": [1')

    def read(**options):
        got = known.read.format("export_members").options(**options).load(str(tmp_path)).collect()
        return sorted(((os.path.basename(r["file"]), r["member"] or "", -1 if r["start"] is None else r["start"], r["value"], r["reason"]) for r in got))

    got = read()
    values = [json.loads(r[3]) for r in got if r[1] == "conversations.json"]
    assert values == [{"id": i, "t": "é, [x] \\\" }"} for i in range(50)]
    rest = [r for r in got if r[1] != "conversations.json"]
    assert rest == [
        ("a.zip", "../out.json", -1, None, "unsafe-member-name"), ("a.zip", "deep/more.json", 0, '{"one": [1, 2]}', None),
        ("b.json", "", 0, '{"k": 1}', None), ("b.json", "", 9, '{"k": 2}', None), ("c.zip", "", -1, None, "malformed-archive"),
        ("d.json", "", 0, None, "incomplete-top-level-array"), ("d.json", "", 1, '{"x": 1}', None), ("d.json", "", 11, "7", None), ("d.json", "", 14, '"s"', None),
    ]
    assert {(r[0], r[1], r[4]) for r in read(memberBytes="100")} >= {("a.zip", "conversations.json", "member-bytes-bound")}
    tight = {(r[0], r[1]): r[4] for r in read(decodedBytes="30")}
    assert tight["a.zip", "conversations.json"] == "decoded-byte-budget" and tight["a.zip", "deep/more.json"] is None and tight["b.json", ""] == "decoded-byte-budget"
    assert sum(r[4] == "member-count-bound" for r in read(members="1")) == 3
    assert [r[4] for r in read(recordBytes="10") if r[0] == "a.zip" and r[1] == "deep/more.json"] == ["record-bytes-bound"]


def test_a_member_larger_than_its_directory_says_is_refused(known, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.json", "[" + "1," * 500 + "1]")
    data = path.read_bytes()
    at = data.rindex(b"PK\x01\x02")
    path.write_bytes(data[: at + 24] + (10).to_bytes(4, "little") + data[at + 28 :])
    (row,) = known.read.format("export_members").load(str(tmp_path)).collect()
    assert row["reason"] in ("size-differs", "malformed-member") and row["value"] is None


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 5 else 4)
    if kind == 4:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice(["a", "b/c", "d~e", 'q"', "é", ""]): nested(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [rng.choice([1, -2.5e3]), rng.choice(['x"y\\', "[{,:", "é\n"]), None, True][kind]


def step(value, pointer):
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        value = value[int(part)] if isinstance(value, list) else value[part]
    return value


def test_spans_equal_the_parser():
    rng = random.Random(4)
    for _ in range(300):
        value = nested(rng)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])).encode()
        found = list(value_spans(b"  " + text + b"\n", 9))
        assert found[-1] == (0, "", 2, 2 + len(text))
        for depth, pointer, start, end in found:
            assert json.loads((b"  " + text)[start:end]) == step(value, pointer) and pointer.count("/") == depth

        def count(v):
            return 1 + sum(map(count, v.values() if isinstance(v, dict) else v if isinstance(v, list) else []))

        assert len(found) == count(value)
    assert [x[:2] for x in value_spans(b'[1, {"a": "x', 5)] == [(1, "/0"), (-1, "")]
