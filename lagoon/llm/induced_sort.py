"""Suffix order and common prefixes of one shard by induced sorting with queues on disk.

Following the published external-memory method of Bingmann, Fischer and Osipov (2013): the
left-most S suffixes are named and sorted by recursion, all others are induced from them, and each
tuple carries the suffix and its common prefix with the one before. A suffix's first symbol is its
priority; among equal ones the order of arrival is the sorted order, so the priority queue is one
first-in-first-out run for each symbol, or for each range of symbols where there are many: a range is taken apart when its turn
comes. Beyond a memory bound queues and arrays are files, read in blocks. The files are the task's own scratch, as
Spark's spill files are; a lost task makes them anew.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Runs of a queue on disk at once: one for each symbol or range of symbols.
_FAN = 256


class _Files:
    """Arrays and names of files in one folder, and the bound beyond which an array is a file."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.made = folder, memory, 0

    def name(self) -> str:
        self.made += 1
        return os.path.join(self.folder, f"f{self.made}")

    def array(self, n: int, kind: type | np.dtype) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory:
            return np.zeros(n, dtype=kind)
        return np.memmap(self.name(), dtype=kind, mode="w+", shape=(n,))

    @property
    def block(self) -> int:
        """Elements handled at a time."""
        return max(256, self.memory // 64)


class DiskQueue:
    """Tuples (suffix, common prefix) by first symbol, first in first out; what exceeds the memory bound goes to files."""

    def __init__(self, files: _Files, text: np.ndarray, symbols: int, kind: np.dtype, base: int = 0):
        self.files, self.text, self.kind, self.base, self.symbols = files, text, kind, base, symbols
        self.step = -(-symbols // _FAN)
        self.held: dict[int, list[np.ndarray]] = defaultdict(list)
        self.paths: dict[int, str] = {}
        self.seen: dict[int, int] = defaultdict(int)
        self.size: dict[int, int] = defaultdict(int)
        self.bytes = 0
        self.opened, self.inner = -1, None

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        chunk = np.empty(len(at), dtype=self.kind)
        chunk["at"], chunk["lcp"] = at, lcp
        self._add(symbol - self.base, chunk)

    def _add(self, symbol: int, chunk: np.ndarray) -> None:
        run = symbol // self.step
        if run == self.opened:
            self.inner._add(symbol - run * self.step, chunk)
            return
        self.held[run].append(chunk)
        self.bytes += chunk.nbytes
        if self.bytes > self.files.memory:
            for k, chunks in self.held.items():
                path = self.paths.setdefault(k, self.files.name())
                with open(path, "ab") as f:
                    for x in chunks:
                        f.write(x.tobytes())
                        self.size[k] += len(x)
            self.held.clear()
            self.bytes = 0

    def _front(self, run: int) -> np.ndarray:
        """The next block of a run, empty if there is none."""
        left = self.size[run] - self.seen[run]
        if left:
            n = min(left, self.files.block)
            got = np.fromfile(self.paths[run], dtype=self.kind, count=n, offset=self.seen[run] * self.kind.itemsize)
            self.seen[run] += n
            if n == left:
                self._forget(run)
            return got
        chunks = self.held.pop(run, [])
        self.bytes -= sum(x.nbytes for x in chunks)
        return np.concatenate(chunks) if chunks else np.empty(0, dtype=self.kind)

    def _forget(self, run: int) -> None:
        os.unlink(self.paths.pop(run))
        self.seen.pop(run, None), self.size.pop(run, None)

    def _open(self, run: int) -> DiskQueue:
        """The queue of one range's symbols, filled in order."""
        if run != self.opened:
            inner = DiskQueue(self.files, self.text, self.step, self.kind, self.base + run * self.step)
            while len(block := self._front(run)):
                symbols = self.text[block["at"]] - inner.base
                order = np.argsort(symbols, kind="stable")
                edge = np.flatnonzero(np.diff(symbols[order], prepend=-1))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                    inner._add(int(symbols[order[a]]), block[order[a:b]])
            self.opened, self.inner = run, inner
        return self.inner

    def pop(self, symbol: int) -> np.ndarray:
        """The next tuples of the symbol in order of arrival, at most a block from disk or what is in memory; empty when there are no more."""
        symbol -= self.base
        if self.step == 1:
            return self._front(symbol)
        return self._open(symbol // self.step).pop(symbol + self.base)

    def back(self, symbol: int) -> Iterator[np.ndarray]:
        """All tuples of the symbol in blocks from the last to the first, each block in order of arrival."""
        symbol -= self.base
        if self.step > 1:
            yield from self._open(symbol // self.step).back(symbol + self.base)
            return
        chunks = self.held.pop(symbol, [])
        self.bytes -= sum(x.nbytes for x in chunks)
        if chunks:
            yield np.concatenate(chunks)
        end = self.size[symbol]
        while end:
            n = min(end, self.files.block)
            yield np.fromfile(self.paths[symbol], dtype=self.kind, count=n, offset=(end - n) * self.kind.itemsize)
            end -= n
            if not end:
                self._forget(symbol)


class _Carried:
    """For each symbol the least common prefix seen since its last push: the suffix minima of the scans, and what its own scan left."""

    def __init__(self, symbols: int, cap: int):
        self.rest = np.full(symbols, cap, dtype=np.int32)
        self.time = np.zeros(symbols, dtype=np.int64)
        self.cap, self.now, self.times, self.values = cap, 0, [], []

    def get(self, symbol: int) -> int:
        k = bisect_right(self.times, self.time[symbol])
        return min(int(self.rest[symbol]), self.values[k] if k < len(self.values) else self.cap)

    def scanned(self, low: int, pushed: list[tuple[int, int]]) -> None:
        self.now += 1
        while self.values and self.values[-1] >= low:
            self.values.pop(), self.times.pop()
        self.values.append(low), self.times.append(self.now)
        for symbol, rest in pushed:
            self.rest[symbol], self.time[symbol] = rest, self.now


class _Shape:
    """Types, runs and left-most S positions of a text that ends in its only, least symbol 0; computed from the right in blocks."""

    def __init__(self, text: np.ndarray, files: _Files):
        n, at_kind = len(text), np.int64 if len(text) > 2**31 - 2 else np.int32
        self.text = text
        self.small = files.array(n, np.bool_)
        self.run = files.array(n, at_kind)  # how many equal symbols begin here
        self.small[n - 1], self.run[n - 1] = True, 1
        stop = n - 1
        while stop > 0:
            start = max(0, stop - files.block)
            t = np.asarray(text[start : stop + 1]).astype(np.int64)
            here = np.arange(len(t) - 1)
            last = np.where(t[1:] != t[:-1], here, len(t))
            last = np.minimum.accumulate(last[::-1])[::-1]
            inside = last < len(t)
            ends = last[inside]
            small, run = np.empty(len(t) - 1, dtype=bool), np.empty(len(t) - 1, dtype=np.int64)
            small[inside], run[inside] = t[ends + 1] > t[ends], ends - here[inside] + 1
            # runs that go on into the block before
            small[~inside], run[~inside] = self.small[stop], len(t) - 1 - here[~inside] + int(self.run[stop])
            self.small[start:stop], self.run[start:stop] = small, run
            stop = start
        count = sum(int((self.small[a + 1 : a + 1 + files.block] & ~self.small[a : a + files.block][: max(0, n - 1 - a)]).sum()) for a in range(0, n - 1, files.block))
        self.lms = files.array(count, at_kind)
        k = 0
        for a in range(0, n - 1, files.block):
            b = min(n - 1, a + files.block)
            found = np.flatnonzero(self.small[a + 1 : b + 1] & ~self.small[a:b]) + a + 1
            self.lms[k : k + len(found)] = found
            k += len(found)


def _spread(scan: np.ndarray, lcp: np.ndarray, shape: _Shape, small: bool, carried: _Carried, queue: DiskQueue, cap: int) -> None:
    """Push what the scanned suffixes induce: those one symbol longer, of the type asked for."""
    before = scan - 1
    take = np.flatnonzero((before >= 0) & (shape.small[before] == small))
    pushed = []
    if len(take):
        symbols = shape.text[before[take]]
        order = np.argsort(symbols, kind="stable")
        take, symbols = take[order], symbols[order]
        edge = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        padded = np.append(lcp, cap)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(take)]):
            k, symbol = take[a:b], int(symbols[a])
            least = np.minimum.reduceat(padded, np.concatenate(([0], k + 1)))
            got = least[:-1].copy()
            got[0] = min(int(got[0]), carried.get(symbol))
            queue.push(symbol, before[k], np.minimum(got + 1, cap))
            pushed.append((symbol, int(least[-1])))
    carried.scanned(int(lcp.min()), pushed)


def _induce(shape: _Shape, seeds: DiskQueue, symbols: int, cap: int, files: _Files) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in pieces from the last to the first, each piece in order, with the common prefix of each and the one before it.

    The one before a piece's first is the next piece's last; the first of a symbol has 0. ``seeds`` holds the left-most S suffixes of each symbol.
    """
    run, kind = shape.run, seeds.kind
    queue, kept = DiskQueue(files, shape.text, symbols, kind), DiskQueue(files, shape.text, symbols, kind)
    carried = _Carried(symbols, cap)
    for c in range(symbols):
        last, first = -1, True
        while len(batch := queue.pop(c)):
            at, lcp = batch["at"], batch["lcp"]
            if first:
                lcp[0], first = 0, False
            kept.push(c, at, lcp)
            last = int(at[-1])
            _spread(at, lcp, shape, False, carried, queue, cap)
        first = True
        while len(batch := seeds.pop(c)):
            at, lcp = batch["at"], batch["lcp"]
            if first:
                lcp[0], first = 0 if last < 0 else min(int(run[last]), int(run[at[0]]), cap), False
            _spread(at, lcp, shape, False, carried, queue, cap)
    queue = DiskQueue(files, shape.text, symbols, kind)
    carried = _Carried(symbols, cap)
    for c in range(symbols - 1, -1, -1):
        if c == 0:
            queue.push(0, np.array([len(shape.text) - 1]), np.array([0]))
        waits, lowest = np.empty(0, dtype=np.int64), -1  # the smallest suffix so far: what stands before it isn't known yet
        while len(batch := queue.pop(c)):
            at, lcp = batch["at"], batch["lcp"]
            if lowest < 0:
                lcp[0] = 0
            _spread(at, lcp, shape, True, carried, queue, cap)
            # a small suffix carries its common prefix with the next larger one: shift by one place
            all_at = np.concatenate((waits, at))
            common = lcp if len(waits) else lcp[1:]
            if len(all_at) > 1:
                yield all_at[:-1][::-1], common[::-1]
            waits, lowest = all_at[-1:], int(at[-1])
        largest = True
        after = 0
        for block in kept.back(c):
            at, lcp = block["at"], block["lcp"]
            if largest:
                after, largest = min(int(run[at[-1]]), int(run[lowest]), cap) if lowest >= 0 else 0, False
                if lowest >= 0:
                    yield waits, np.array([after])
            # from the largest down, each with the common prefix of the one scanned before it
            _spread(at[::-1], np.append(lcp[1:], after)[::-1].astype(lcp.dtype), shape, True, carried, queue, cap)
            after = int(lcp[0])
            yield at, lcp
        if largest and lowest >= 0:
            yield waits, np.array([0])


def _doubled(names: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``reach`` names, and common prefixes in names: the end of the recursion, in memory."""
    n = len(names)
    levels, width = [names.astype(np.int32)], 1
    while width < reach and levels[-1].max() + 1 < n:
        rank = levels[-1]
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:-width or None] = rank[width:] + 1 if width < n else 0
        _, nxt = np.unique(rank * np.int64(n + 1) + ahead, return_inverse=True)
        levels.append(nxt.astype(np.int32))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    same = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, w = levels[k], 1 << k
        inside = (i < n) & (j < n)
        equal = np.zeros(n - 1, dtype=bool)
        equal[inside] = rank[i[inside]] == rank[j[inside]]
        if k:  # a rank covers w names only where w names are left
            equal &= (np.maximum(i, j) + w <= n)
        step = np.where(equal, w, 0)
        same, i, j = same + step, i + step, j + step
    return order, np.concatenate(([0], same))


def _length(shape: _Shape, k: np.ndarray) -> np.ndarray:
    """Lengths of the left-most S substrings of the given numbers, the next one's first symbol included."""
    nxt = np.minimum(k + 1, len(shape.lms) - 1)
    return np.where(k + 1 < len(shape.lms), shape.lms[nxt] - shape.lms[k] + 1, 1)


def _named(shape: _Shape, pieces: Iterator[tuple[np.ndarray, np.ndarray]], files: _Files) -> tuple[np.ndarray, int]:
    """Names of the left-most S substrings in text order, from all suffixes in pieces from the last; equal substrings share a name."""
    names = files.array(len(shape.lms), np.int64)
    text, count, later = shape.text, 0, -1
    for at, _ in pieces:
        at = at[(at > 0)]
        at = at[shape.small[at] & ~shape.small[at - 1]]
        if not len(at):
            continue
        k = np.searchsorted(shape.lms, at)
        chain = np.append(k, later) if later >= 0 else k
        starts, size = shape.lms[chain], _length(shape, chain)
        equal = size[1:] == size[:-1]
        live, t = np.flatnonzero(equal), 0
        while len(live):
            differs = text[starts[live] + t] != text[starts[live + 1] + t]
            equal[live[differs]] = False
            t += 1
            live = live[~differs & (size[live] > t)]
        # names count down from the last: a substring that differs from the next larger one begins a new name
        below = np.cumsum(~equal[::-1])[::-1]
        if later < 0:
            names[k] = np.append(below, 0)
            count = int(names[k[0]])
        else:
            names[k] = count + below
            count += int(below[0])
        later = int(k[0])
    for a in range(0, len(names), files.block):
        names[a : a + files.block] = count - names[a : a + files.block]
    return names, count + 1


def suffixes(text: np.ndarray, cap: int, files: _Files | None = None, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` in order by their first ``cap`` symbols, in pieces from the last to the first.

    ``text`` ends in its only 0. A piece is in order, with the common prefix (capped) of each suffix and the one before: for a piece's first
    that is the next piece's last, for the first of a symbol it is 0. The string of names is sorted by the same function, or by doubling where
    it fits into a quarter of ``memory``. No more than a few blocks within ``memory`` are held, whatever the length of the text.
    """
    if files is None:
        with tempfile.TemporaryDirectory() as made:
            yield from suffixes(text, cap, _Files(made, memory), memory)
        return
    shape = _Shape(text, files)
    symbols = max(int(text[a : a + files.block].max()) for a in range(0, len(text), files.block)) + 1
    lms, block = shape.lms, files.block
    kind = np.dtype([("at", lms.dtype), ("lcp", np.int16 if cap < 32_000 else np.int32)])

    def filled(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> DiskQueue:
        made = DiskQueue(files, text, symbols, kind)
        for at, lcp in chunks:
            first = text[at]
            order = np.argsort(first, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(first[order]) != 0)))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                made.push(int(first[order[a]]), at[order[a:b]], lcp[order[a:b]])
        return made

    # any order of the seeds inside a symbol sorts their substrings by induction
    rough = filled((lms[a : a + block], np.zeros(len(lms[a : a + block]), dtype=np.int16)) for a in range(0, len(lms), block))
    names, count = _named(shape, _induce(shape, rough, symbols, cap, files), files)
    if count == len(lms):
        order, same = files.array(len(lms), np.int64), files.array(len(lms), np.int32)
        for a in range(0, len(lms), block):
            order[names[a : a + block]] = np.arange(a, min(a + block, len(lms)))
    elif 4 * names.nbytes <= files.memory:
        order, same = _doubled(names, cap // 2 + 2)
    else:
        order, same = files.array(len(lms), np.int64), files.array(len(lms), np.int32)
        stop = len(lms)
        for at, lcp in suffixes(names, cap, files, memory):
            order[stop - len(at) : stop], same[stop - len(at) : stop] = at, lcp
            stop -= len(at)

    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The left-most S suffixes in order, with common prefixes in symbols: whole equal names, then symbol by symbol to the first difference."""
        for start in range(0, len(lms), block):
            k = order[max(0, start - 1) : start + block]
            at = lms[k]
            ahead = np.minimum(k[1:] + same[max(0, start - 1) + 1 : start + block], len(lms) - 1)
            lcp = lms[ahead].astype(np.int64) - at[1:]
            a, b = at[:-1] + lcp, at[1:] + lcp
            live = np.flatnonzero(lcp < cap)
            while len(live):
                x, y = a[live], b[live]
                fits = np.maximum(x, y) < len(text)
                live, x, y = live[fits], x[fits], y[fits]
                live = live[text[x] == text[y]]
                lcp[live] += 1
                a[live] += 1
                b[live] += 1
                live = live[lcp[live] < cap]
            lcp = np.minimum(lcp, cap)
            yield (at[1:], lcp) if start else (at, np.concatenate(([0], lcp)))

    yield from _induce(shape, filled(seeds()), symbols, cap, files)


def repeated(pieces: list[bytes], length: int, memory: int = 64 << 20) -> list[np.ndarray]:
    """For each piece, the starts of its strings of ``length`` bytes that also start elsewhere in these pieces."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    with tempfile.TemporaryDirectory() as folder:
        files = _Files(folder, memory)
        text = files.array(int(sizes.sum()) + len(pieces) + 1, np.int16)
        for a, p in zip(starts.tolist(), pieces):
            text[a : a + len(p)] = np.frombuffer(p, dtype=np.uint8)
            text[a : a + len(p)] += 2
            text[a + len(p)] = 1
        marked = files.array(len(text), np.bool_)
        owed = False  # whether the next piece's last suffix begins as this one's first does
        for at, lcp in suffixes(text, length, files, memory):
            full = lcp >= length
            marked[at[full]] = True
            marked[at[:-1][full[1:]]] = True
            if owed:
                marked[at[-1]] = True
            owed = bool(full[0])
        return [np.flatnonzero(marked[a : max(a, b - length + 1)]) for a, b in zip(starts.tolist(), ends.tolist())]
