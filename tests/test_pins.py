"""Pinned recordings: what was appended, cut, changed and lost, and pages backwards."""

import random

import pytest

from lagoon.sources import pins


def rows(frame):
    return sorted(((r["file"].rsplit("/", 1)[1], r["start"], r["end"], r["value"]) for r in frame.collect()))


def lines_in(name, data):
    out, at = [], 0
    for x in data.splitlines(keepends=True):
        if x.strip():
            out.append((name, at, at + len(x), x.decode().rstrip("\n")))
        at += len(x)
    return out


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_replay_after_append_truncate_and_rewrite(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    held = {}
    for i in range(7):
        data = b"".join(b'{"n": %d, "t": "%s"}\n' % (k, b"x" * rng.randrange(30)) for k in range(i + 1))
        data = data if i % 2 else data[:-1]
        held[f"f{i}.jsonl"] = data
        (tmp_path / f"f{i}.jsonl").write_bytes(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    pinned = pins.pin(spark, str(tmp_path), chunk=chunk).cache()
    assert pinned.filter("sha256 IS NULL").count() == 0
    before = {r["file"]: r["revision"] for r in pins.revision(pinned).collect()}
    (tmp_path / "f1.jsonl").write_bytes(held["f1.jsonl"] + b'{"later": 1}\n')
    (tmp_path / "f2.jsonl").write_bytes(held["f2.jsonl"] + b", more of the last line\n")
    (tmp_path / "f3.jsonl").write_bytes(held["f3.jsonl"][:-3])
    (tmp_path / "f4.jsonl").write_bytes(held["f4.jsonl"].replace(b'"n": 2', b'"n": 9'))
    (tmp_path / "f5.jsonl").write_bytes(b"{}\n" + held["f5.jsonl"])
    (tmp_path / "f6.jsonl").unlink()
    states = {r["file"].rsplit("/", 1)[1]: r["state"] for r in pins.verify(pinned).collect()}
    assert states == {"f0.jsonl": "same", "f1.jsonl": "grown", "f2.jsonl": "grown", "f3.jsonl": "truncated", "f4.jsonl": "changed", "f5.jsonl": "changed", "f6.jsonl": "missing", "empty.jsonl": "same"}
    lines, refused = pins.replay(pinned)
    assert rows(lines) == sorted(x for n in ("f0.jsonl", "f1.jsonl", "f2.jsonl") for x in lines_in(n, held[n]))
    assert refused.count() == 4
    again = {r["file"]: r["revision"] for r in pins.revision(pins.pin(spark, str(tmp_path), chunk=chunk)).collect()}
    assert {f.rsplit("/", 1)[1] for f in before if again.get(f) == before[f]} == {"f0.jsonl", "empty.jsonl"}
    pinned.unpersist()


@pytest.mark.parametrize("size", [30, 1000])
def test_pages_backwards_give_every_line_once(spark, tmp_path, size):
    data = b"".join(b'{"n": %d}\n' % k for k in range(9)) + b'{"long": "' + b"y" * 90 + b'"}\n{"end": 1}'
    (tmp_path / "a.jsonl").write_bytes(data)
    pinned = pins.pin(spark, str(tmp_path), chunk=32).cache()
    (tmp_path / "a.jsonl").write_bytes(data + b'\n{"later": 2}\n')
    cursors, got, pages = pinned.select("file", pinned["size"].alias("end")).distinct(), [], 0
    while cursors.filter("end IS NOT NULL").count():
        lines, cursors = pins.page(pinned, cursors, size)
        page = rows(lines)
        got += page
        cursors = spark.createDataFrame(cursors.collect(), cursors.schema)
        pages += 1
        assert pages < 60
    assert sorted(got) == lines_in("a.jsonl", data)
    (tmp_path / "a.jsonl").write_bytes(data[:-4] + b"2345")
    end = pinned.select("file", pinned["size"].alias("end")).distinct()
    lines, after = pins.page(pinned, end, 20)
    assert lines.count() == 0 and [r["state"] for r in after.collect()] == ["changed"]
    early = end.withColumn("end", end["end"] * 0 + 27)  # the change lies in chunks that this page doesn't touch
    assert pins.page(pinned, early, 27)[0].count() == 3
    pinned.unpersist()
