"""Parts of files as Python data sources: the ends of recordings by byte, and the members of export archives.

Nothing but the planned ranges is read. Files are opened by Arrow's file systems, so a folder may lie on local disk, HDFS or an object
store. ``register(spark)`` makes ``spark.read.format("recording_tail")`` and ``format("export_members")`` known.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lagoon.functions.json_spans import value_spans

#: Bytes of a tail and its bounds, of the probe of a file's head and what it may grow to, of one whole record.
TAIL_BYTES, LEAST_TAIL, MOST_TAIL = 4 << 20, 64 << 10, 1 << 30
HEAD_BYTES, MOST_HEAD = 64 << 10, 1 << 20
RECORD_BYTES = 64 << 20

BLANK = b" \t\n\r\x0b\x0c"


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """``(file, bytes)`` of the files below a folder (or the one file) whose name fits, by name; hidden ones are left out."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else path[: path.index(":") + 1]
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    fits = [f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and (fnmatch(f.base_name, pattern) or info.is_file)]
    return sorted((prefix + f.path, f.size) for f in fits)


def opened(file: str) -> pa.NativeFile:
    fs, path = pafs.FileSystem.from_uri(file) if ":" in file.split("/", 1)[0] else (pafs.LocalFileSystem(), file)
    return fs.open_input_file(path)


@dataclass
class Pieces(InputPartition):
    """Some files (or members of an archive) of about one partition's bytes."""

    pieces: list[tuple]


def packed(pieces: list[tuple], sizes: list[int], target: int) -> list[Pieces]:
    """Neighbouring pieces together up to ``target`` bytes; a larger one stands alone."""
    out: list[Pieces] = []
    held = 0
    for piece, size in zip(pieces, sizes):
        if out and held + size <= target:
            out[-1].pieces.append(piece)
            held += size
        else:
            out.append(Pieces([piece]))
            held = size
    return out


def split_lines(data: bytes, start: int, most: int) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """``start, end, line, reason`` of each line that isn't blank; one longer than ``most`` comes without its bytes."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at) + 1 or len(data)
        line = data[at:end].rstrip(b"\n")
        if line.strip(BLANK):
            yield (start + at, start + end, None, "oversize") if len(line) > most else (start + at, start + end, line, None)
        at = end


def read_tail(file: pa.NativeFile, size: int, tail: int, most: int) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """The last ``tail`` bytes of the planned ``size``, and a probe of the head where they don't reach it: ``part, start, end, value, reason``.

    A first line that the window splits is left out and told as ``discarded-partial-record``; the byte before the window says
    whether it is split. What lies before is ``outside-tail-bound``. The probe grows once if it holds no whole line.
    """
    begin = max(0, size - tail)
    before = max(0, begin - 1)
    data = file.read_at(size - before, before)
    if len(data) < size - before:
        yield "gap", before + len(data), size, None, "changed-during-read"
    window, skip = (data[1:], 0) if begin else (data, 0)
    if begin:
        yield "gap", 0, begin, None, "outside-tail-bound"
        if data[:1] != b"\n":
            skip = window.find(b"\n") + 1 or len(window)
            yield "gap", begin, begin + skip, None, "discarded-partial-record"
    for at, end, line, reason in split_lines(window[skip:], begin + skip, most):
        yield "tail" if reason is None else "gap", at, end, line, reason
    if begin:
        probe = file.read_at(min(HEAD_BYTES, size), 0)
        if b"\n" not in probe and len(probe) < size:
            probe = file.read_at(min(MOST_HEAD, size), 0)
        whole = probe if len(probe) >= size else probe[: probe.rfind(b"\n") + 1]
        for at, end, line, reason in split_lines(whole, 0, most):
            yield "head" if reason is None else "gap", at, end, line, reason


class RecordingTail(DataSource):
    """``file, size, part, start, end, value, reason``: the last bytes of each recording below a folder, line by line.

    ``part`` is tail, head (the opening lines of a file that the window doesn't reach) or gap. Options: ``bytes`` (64 KiB to 1 GiB, 4 MiB unless given), ``pattern``,
    ``recordBytes`` and ``partitionBytes``. The plan knows every range before a byte is read: a task opens its files, seeks and reads those ranges only.
    """

    @classmethod
    def name(cls) -> str:
        return "recording_tail"

    def schema(self) -> str:
        return "file string, size bigint, part string, start bigint, end bigint, value string, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(self.options)


class _TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.tail = int(options.get("bytes", TAIL_BYTES))
        if not LEAST_TAIL <= self.tail <= MOST_TAIL and not options.get("anyBytes"):
            raise ValueError(f"bytes must be {LEAST_TAIL} to {MOST_TAIL}")
        self.most, self.target = int(options.get("recordBytes", RECORD_BYTES)), int(options.get("partitionBytes", 32 << 20))

    def partitions(self) -> list[Pieces]:
        files = listed(self.path, self.pattern)
        return packed(files, [min(size, self.tail) for _, size in files], self.target) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        for name, size in partition.pieces:
            with opened(name) as file:
                for part, start, end, value, reason in read_tail(file, size, self.tail, self.most):
                    text = None if value is None else value.decode("utf-8", "replace")
                    yield name, size, part, start, end, text, reason


class ExportMembers(DataSource):
    """``file, member, bytes, start, value, reason``: exports below a folder, plain files and members of ZIP archives, each value of a top-level array a row.

    Budgets hold for the whole read and are dealt while planning, from the archives' directories alone: files by name, their members by name. ``decodedBytes`` bounds what is
    decoded in all, ``memberBytes`` one member, ``members`` their number; what doesn't fit is a row with a ``reason`` and no value (``decoded-byte-budget``, ``member-bytes-bound``, ``member-count-bound``), as are
    members that are encrypted, whose name leaves the archive or is too long, that hold more than their directory says (``size-differs``), and files that are no archive. A member of several
    values is cut at its top level; ``recordBytes`` bounds one value.
    """

    @classmethod
    def name(cls) -> str:
        return "export_members"

    def schema(self) -> str:
        return "file string, member string, bytes bigint, start bigint, value string, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options)


class _MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.json")
        self.decoded, self.member = int(options.get("decodedBytes", 512 << 20)), int(options.get("memberBytes", 512 << 20))
        self.members, self.most = int(options.get("members", 10_000)), int(options.get("recordBytes", 8 << 20))
        self.target = int(options.get("partitionBytes", 32 << 20))

    def _found(self) -> Iterator[tuple[str, str | None, int, str | None]]:
        for file, size in listed(self.path, "*"):
            if not file.lower().endswith(".zip"):
                if fnmatch(file.rsplit("/", 1)[1], self.pattern):
                    yield file, None, size, None
                continue
            try:
                with opened(file) as held, zipfile.ZipFile(held) as archive:
                    entries = sorted((e for e in archive.infolist() if not e.is_dir()), key=lambda e: e.filename)
            except (zipfile.BadZipFile, pa.ArrowInvalid):
                yield file, None, size, "malformed-archive"
                continue
            seen: set[str] = set()
            for e in entries:
                odd = e.filename.startswith("/") or ".." in e.filename.split("/") or "\\" in e.filename
                reason = "unsafe-member-name" if odd or len(e.filename.encode()) > 4096 else "repeated-member-name" if e.filename in seen else "encrypted-member" if e.flag_bits & 1 else None
                seen.add(e.filename)
                if reason or fnmatch(e.filename.rsplit("/", 1)[-1], self.pattern):
                    yield file, e.filename, e.file_size, reason

    def partitions(self) -> list[Pieces]:
        planned, used, count = [], 0, 0
        for file, member, size, reason in self._found():
            if reason is None:
                count += 1
                reason = "member-count-bound" if count > self.members else "member-bytes-bound" if size > self.member else "decoded-byte-budget" if used + size > self.decoded else None
                used += size if reason is None else 0
            planned.append((file, member, size, reason))
        return packed(planned, [p[2] if p[3] is None else 0 for p in planned], self.target) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        for file, member, size, reason in partition.pieces:
            if reason is not None:
                yield file, member, size, None, None, reason
                continue
            with opened(file) as held:
                if member is None:
                    data = held.read(size + 1)
                else:
                    try:
                        with zipfile.ZipFile(held) as archive, archive.open(member) as inner:
                            data = inner.read(size + 1)
                    except (zipfile.BadZipFile, pa.ArrowInvalid, EOFError, NotImplementedError):
                        yield file, member, size, None, None, "malformed-member"
                        continue
            if len(data) != size:
                yield file, member, size, None, None, "size-differs"
                continue
            for start, value, why in top_values(data, self.most):
                yield file, member, size, start, None if value is None else value.decode("utf-8", "replace"), why


def top_values(data: bytes, most: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """``start, value, reason`` of each value of a top-level array, or of each value at the top level itself (one, or one a line).

    Values are cut by where they lie, not parsed. Of an array that ends too early the whole values come, then ``incomplete-top-level-array``.
    """
    held: list[tuple[int, int]] = []
    for depth, _, start, end in value_spans(data, 1):
        if depth == 1:
            held.append((start, end))
            continue
        array = data[start : start + 1] == b"["
        for a, b in held if array else [(start, end)] if depth == 0 else []:
            yield (a, data[a:b], None) if b - a <= most else (a, None, "record-bytes-bound")
        if depth < 0:
            yield start, None, "incomplete-top-level-array" if array else "incomplete-record"
        held = []


def register(spark: SparkSession) -> None:
    for source in (RecordingTail, ExportMembers):
        spark.dataSource.register(source)
