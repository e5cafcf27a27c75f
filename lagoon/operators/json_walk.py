"""JSON of any shape walked in one pass, and what two walks collect: citations and references to artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions.scalars import byte_capped

#: Levels below the root that are looked at, references told of one value, bytes of one field of a citation.
DEPTH, REFERENCES, FIELD_BYTES = 32, 64, 4 << 10

URI = ("uri", "url", "href")
START = ("start_idx", "start_index", "start")
END = ("end_idx", "end_index", "end")
SOURCES = ("items", "sources", "source")
DIGEST = ("digest", "sha256", "file_id", "fileId")
BYTES = ("bytes", "size", "byte_count", "size_bytes")
ARTIFACT = frozenset((*URI, "asset_pointer", "path", *DIGEST, *BYTES))


def text_in(value: dict, *keys: str) -> str | None:
    """The first of the fields that is a text; numbers don't count."""
    for key in keys:
        if key in value and isinstance(x := value[key], str):
            return x if x.isascii() else x.encode("utf-8", "replace").decode()
    return None


def count_in(value: dict, *keys: str) -> int | None:
    """The first of the fields that is an integer of 0 or more and fits a long."""
    for key in keys:
        if key in value and type(x := value[key]) is int and 0 <= x < 1 << 63:
            return x
    return None


def in_order(keys: list[str]) -> list[str]:
    """Keys as Spark's variants have them: by UTF-16 units."""
    return sorted(keys) if all(map(str.isascii, keys)) else sorted(keys, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def walk(value: object, state: int, hit: Callable, enter: Callable, follow: Callable, depth: int, level: int = 0) -> Iterator[tuple[int, tuple | None, bool]]:
    """``(state, found, cut)`` of the containers that ``hit(state, value)`` finds something in, and of those at ``depth`` that would have been entered (``cut``), in the order of a depth-first walk.

    Containers that ``enter(state, value, found)`` lets in are opened, objects in the order of their keys; ``follow(state, found, key)`` is the state of a child.
    """
    shape = type(value)
    if shape is not dict and shape is not list:
        return
    found = hit(state, value) if shape is dict else None
    opened = enter(state, value, found)
    cut = opened and level == depth
    if found is not None or cut:
        yield state, found, cut
    if opened and not cut:
        below = [k for k in value if type(value[k]) in (dict, list)] if shape is dict else range(len(value))
        for key in in_order(below) if shape is dict else below:
            yield from walk(value[key], follow(state, found, key), hit, enter, follow, depth, level + 1)


def collected(rows: DataFrame, keys: list[str], value: str, collect: Callable[[object], Iterator[tuple]], columns: str) -> DataFrame:
    """``keys`` and ``columns``: the rows that ``collect`` makes of each JSON text; texts that aren't JSON to Spark give none. A text is parsed and walked once, where it lies; ``keys`` tell texts apart."""
    given = rows.filter(F.try_parse_json(value).isNotNull()).select(*keys, value)
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # integers beyond a long are numbers of another kind, however many digits they have
        decoder = json.JSONDecoder(parse_int=lambda x: int(x) if len(x) < 20 else float("inf"))
        for batch in batches:
            of, out = [], []

            def made(of: list = of, out: list = out, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                told = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                of.clear()
                out.clear()
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *told], names=[*keys, *names])

            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for row in collect(decoder.raw_decode(text.lstrip(" \t\r\n"))[0]):
                    of.append(i)
                    out.append(row)
                    if len(of) >= 8192:
                        yield made()
            if of:
                yield made()

    return given.mapInArrow(run, ", ".join([*[f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys], columns]))


def artifact_references(rows: DataFrame, keys: list[str], value: str, most: int = REFERENCES, depth: int = DEPTH) -> DataFrame:
    """``keys, place, kind, uri, path, digest, bytes``: objects anywhere in a value that describe an artifact, the first ``most`` in walking order.

    An object counts if a field names a place (uri, url, href, asset_pointer; path), a digest (digest, sha256, file_id, fileId) or a size (bytes, size, byte_count, size_bytes). Texts
    are never searched for what looks like a path. Objects ``depth`` levels down and below aren't looked at.
    """

    def hit(state: int, v: dict) -> tuple | None:
        if ARTIFACT.isdisjoint(v):
            return None
        found = (text_in(v, *URI, "asset_pointer"), text_in(v, "path"), text_in(v, *DIGEST), count_in(v, *BYTES))
        return None if found == (None,) * 4 else found

    def collect(root: object) -> Iterator[tuple]:
        place = 0
        for _, found, _ in walk(root, 0, hit, lambda *_: True, lambda state, *_: state, depth - 1):
            if found is not None:
                place += 1
                yield (place, "recorded-artifact", *found)
            if place == most:
                return

    return collected(rows, keys, value, collect, "place int, kind string, uri string, path string, digest string, bytes bigint")


def citations(rows: DataFrame, keys: list[str], value: str, most: int = REFERENCES, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(found, told)``: citations below any ``content_references`` and their sources; of each value how many were left out.

    ``found``: keys, place (of the citation), source (null for a citation, else its place among the citation's sources), kind, uri, title, start, end. An object is a citation if it has a
    text (type, uri, url, href, title) or an offset; what lies in its ``items``, ``sources`` and ``source`` are its sources, of which nested ones come with their outermost citation. Other
    objects and lists are entered. Before the first ``content_references`` only objects are entered. The first ``most`` citations are told, and of each the first ``most`` sources; fields are
    cut at 4 KiB. ``told``: keys, citations, omitted, incomplete (something lay deeper than ``depth``).
    """

    # states: 0 before the references, 1 in them, 2 an object of sources, 3 a field of a citation that isn't looked at
    def hit(state: int, v: dict) -> tuple | None:
        found = (text_in(v, "type"), text_in(v, *URI), text_in(v, "title"), count_in(v, *START), count_in(v, *END)) if state in (1, 2) else (None,) * 5
        return None if found == (None,) * 5 else found

    def enter(state: int, v: object, found: tuple | None) -> bool:
        return isinstance(v, dict) if state == 0 else state != 3

    def follow(state: int, found: tuple | None, key: str | int) -> int:
        if state == 0:
            return int(key == "content_references")
        return state if found is None else 2 if key in SOURCES else 3

    def collect(root: object) -> Iterator[tuple]:
        place, source, incomplete = 0, 0, False
        for state, found, cut in walk(root, 0, hit, enter, follow, depth - 1):
            incomplete |= cut
            if found is not None:
                place, source = (place + 1, 0) if state == 1 else (place, source + 1)
                if place <= most and source <= most:
                    yield (place, source or None, *found, None, None)
        if isinstance(root, dict):
            yield (None, None, None, None, None, None, None, place, incomplete)

    told = collected(rows, keys, value, collect, "place int, source int, kind string, uri string, title string, start bigint, end bigint, n bigint, incomplete boolean")
    found = told.filter("place IS NOT NULL").drop("n", "incomplete").withColumns({c: byte_capped(F.col(c), FIELD_BYTES) for c in ("kind", "uri", "title")})
    left = F.greatest(F.col("n") - most, F.lit(0))
    return found, told.filter("place IS NULL").select(*keys, F.least("n", F.lit(most)).alias("citations"), left.alias("omitted"), "incomplete")
