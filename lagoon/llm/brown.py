"""Operator 1: Brown class-based bigrams: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.heads import frequent
from lagoon.storage import materialize

#: Stands for the end of a text; no word holds white space.
END = b"\n"


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of bytes other than ASCII white space; then one end."""
    return [*(text or b"").lower().split(), END]


def spelled(word: bytes, groups: int) -> int:
    """The group of a word outside the vocabulary: words that end in the same three bytes are clustered together."""
    return crc32(word[-3:]) % groups


@dataclass
class BrownModel:
    """Bounded by its parameters: ``counts`` has the most frequent words, ``assigned`` the class of each unit: vocabulary words, groups, the end."""

    counts: dict[bytes, int]
    ids: dict[bytes, int]
    assigned: np.ndarray
    transitions: np.ndarray
    groups: int
    tokens: int
    types: int
    group_tokens: np.ndarray
    group_types: np.ndarray
    words: DataFrame
    likelihoods: list[float]

    def tables(self) -> tuple:
        """log10 of transitions, of what each class's counts are divided by, and of the chance of a new word in it (times that)."""
        n = self.transitions.astype(np.float64)
        g = len(n)
        prior = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * g)
        smooth = np.log10((n + 10 * prior) / (n.sum(axis=1, keepdims=True) + 10))
        size = len(self.ids)
        own = np.fromiter((self.counts[w] for w in self.ids), dtype=np.float64, count=size)
        totals = np.bincount(self.assigned[: size + self.groups], weights=np.concatenate((own, self.group_tokens)), minlength=g)
        types = np.bincount(self.assigned[: size + self.groups], weights=np.concatenate((np.ones(size), self.group_types)), minlength=g)
        return smooth, np.log10(totals + 0.5), np.log10(0.5 * (types + 1))


def _word_counts(docs: DataFrame, text: Column, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.update(words_of(x))
                if len(held) > 600_000:
                    yield _counts_batch(held, groups)
                    held = Counter()
        if held:
            yield _counts_batch(held, groups)

    made = docs.select(text.cast("binary").alias("t")).mapInArrow(run, "word binary, grouped int, n long")
    return materialize(made.groupBy("word", "grouped").agg(F.sum("n").alias("n")))


def _counts_batch(held: Counter, groups: int) -> pa.RecordBatch:
    words = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.binary()), pa.array([spelled(w, groups) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())],
        names=["word", "grouped", "n"],
    )


#: The most frequent units' contexts are dealt in pieces: this many units, and pieces of each.
_HOT, _PIECES = 256, 16


def _contexts(docs: DataFrame, text: Column, ids: dict[bytes, int], size: int, groups: int) -> DataFrame:
    """``w, x, n``: for each unit its neighbours (id, and width + id for left ones) and counts; in pieces for the most frequent ones and the end.

    Counts meet by unit and piece, so no task holds all that stands beside a frequent word. A unit has at most
    2 * (size + groups + 1) neighbours, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    width = size + groups + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, count = shared.value, [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                tokens = words_of(x)
                row = [known[w] if w in known else size + crc32(w[-3:]) % groups for w in tokens]
                row[-1] = width - 1
                seq = np.array([width - 1, *row], dtype=np.int64)
                held.append(seq[:-1] * width + seq[1:])
                count += len(tokens)
                if count > 6_000_000:
                    yield from emit(held)
                    held, count = [], 0
        if held:
            yield from emit(held)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        a, b = code // width, code % width
        left = b < width - 1
        w, x, n = np.concatenate((a, b[left])), np.concatenate((b, width + a[left])), np.concatenate((n, n[left]))
        k = np.where((w < _HOT) | (w == width - 1), x % _PIECES, 0)
        for at in range(0, len(w), 500_000):
            s = slice(at, at + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(w[s].astype(np.int32)), pa.array(k[s].astype(np.int32)), pa.array(x[s].astype(np.int32)), pa.array(n[s])], names=["w", "k", "x", "n"])

    pairs = docs.select(text.cast("binary").alias("t")).mapInArrow(run, "w int, k int, x int, n long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = pairs.repartition(parts, "w", "k").groupBy("w", "k", "x").agg(F.sum("n").alias("n"))
    return materialize(summed.groupBy("w", "k").agg(F.collect_list("x").alias("x"), F.collect_list("n").alias("n")).drop("k"))


def _class_counts(contexts: DataFrame, classes: np.ndarray, g: int) -> np.ndarray:
    """How often each class follows each class: one small matrix from each task."""
    width = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((g, g), dtype=np.int64)
        for batch in batches:
            for w, x, n in _rows(batch):
                right = x < width
                total[classes[w]] += np.bincount(classes[x[right]], weights=n[right], minlength=g).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    out = np.zeros(g * g, dtype=np.int64)
    for row in contexts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most g * g cells
        out[row["cell"]] = row["n"]
    return out.reshape(g, g)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ids, ends = batch.column(0).to_pylist(), batch.column(1).offsets.to_numpy()
    x, n = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
    for k, w in enumerate(ids):
        yield w, x[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]]


def _f(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1.0))


def log_likelihood(counts: np.ndarray) -> float:
    """What the classes explain: the sum over class pairs of n log n less that over their margins (the rest of the likelihood is the words' own)."""
    n = counts.astype(np.float64)
    return float(_f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum())


def best_class(a: int, r: np.ndarray, l: np.ndarray, n0: np.ndarray, learned: int) -> int:
    """Where a unit of class ``a`` whose right and left neighbours have class counts ``r`` and ``l`` adds most to the log-likelihood, all others held."""
    row, col = n0[a].copy(), n0[:, a].copy()
    n0[a] -= r
    n0[:, a] -= l
    np.maximum(n0, 0, out=n0)
    xs, ys = np.flatnonzero(r), np.flatnonzero(l)
    here = n0[:learned]
    gain = (_f(here[:, xs] + r[xs]) - _f(here[:, xs])).sum(axis=1)
    there = n0[:, :learned][ys]
    gain += (_f(there + l[ys][:, None]) - _f(there)).sum(axis=0)
    total = r.sum()
    out, into = here.sum(axis=1), n0[:, :learned].sum(axis=0)
    gain -= _f(out + total) - _f(out) + _f(into + total) - _f(into)
    n0[a], n0[:, a] = row, col
    best = int(gain.argmax())
    return best if gain[best] > gain[a] + 1e-9 else a


def _sweep(contexts: DataFrame, classes: np.ndarray, counts: np.ndarray, learned: int, turn: int, of: int) -> dict[int, int]:
    """Moves of one sweep: each unit whose number leaves ``turn`` by ``of`` goes where the log-likelihood grows most, all others held."""
    width, g = len(classes), len(counts)

    def sides(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = x < width
        return np.bincount(classes[x[right]], weights=n[right], minlength=g), np.bincount(classes[x[~right] - width], weights=n[~right], minlength=g)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n0 = counts.astype(np.float64)
        moved, target = [], []
        for batch in batches:
            for w, x, n in _rows(batch):
                c = best_class(int(classes[w]), *sides(x, n), n0, learned)
                if c != classes[w]:
                    moved.append(w)
                    target.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array(target, pa.int32())], names=["w", "c"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's neighbours by class: the first unit of a class stands for it."""
        for batch in batches:
            ws, xs, ns = [], [], []
            for w, x, n in _rows(batch):
                r, l = sides(x, n)
                for at, v in ((first, r), (width + first, l)):
                    k = np.flatnonzero(v)
                    ws.append(np.full(len(k), w))
                    xs.append(at[k])
                    ns.append(v[k].astype(np.int64))
            if ws:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ws).astype(np.int32)), pa.array(np.concatenate(xs).astype(np.int32)), pa.array(np.concatenate(ns))], names=["w", "x", "n"])

    first = np.zeros(g, dtype=np.int64)
    first[classes[::-1]] = np.arange(width)[::-1]
    due = contexts.filter((F.col("w") % of == turn) & (F.col("w") < width - 1))
    hot = due.filter(F.col("w") < _HOT).mapInArrow(cells, "w int, x int, n long").groupBy("w", "x").agg(F.sum("n").alias("n"))
    whole = hot.groupBy("w").agg(F.collect_list("x").alias("x"), F.collect_list("n").alias("n")).unionByName(due.filter(F.col("w") >= _HOT))
    return {r["w"]: r["c"] for r in whole.mapInArrow(move, "w int, c int").collect()}  # at most one row a unit


def fit(
    docs: DataFrame, text_col: str = "text", head: int = 1 << 18, vocabulary: int = 1 << 15, learned: int = 96, groups: int = 1 << 12, sweeps: int = 6
) -> BrownModel:
    """Class model of all texts of ``docs``.

    Every token of every text is counted, and every word is clustered by exchange into ``learned`` classes over the counts of all its
    neighbours: the ``vocabulary`` most frequent words (ties by bytes) each alone, all others together with those that end in the same bytes, in
    ``groups`` groups. A sweep moves half of the units, each to the class that gives the greatest log-likelihood with the
    others where they were, as distributed exchange clustering does. A sweep whose moves together lower the likelihood is undone, and
    from then on half as many units move at a time, so the likelihood never falls; sweeps end when nothing moves. The end of a text has
    a class of its own. What is broadcast or meets on the driver is bounded by these parameters: at most ``head`` words with counts, the class of each
    unit, and the classes' transition counts. All word counts stay a table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _word_counts(docs, text, groups)
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = frequent(words, "n", head).select("word", "n").toArrow()
    counts = dict(sorted(zip(top["word"].to_pylist(), top["n"].to_pylist()), key=lambda x: (-x[1], x[0])))
    ids = {w: i for i, w in enumerate([w for w in counts if w != END][:vocabulary])}
    size = len(ids)
    contexts = _contexts(docs, text, ids, size, groups)
    g = learned + 1
    classes = np.concatenate((np.arange(size + groups) % learned, [learned])).astype(np.int64)
    n = _class_counts(contexts, classes, g)
    likelihoods, of, still = [log_likelihood(n)], 2, 0
    for turn in range(sweeps):
        moves = _sweep(contexts, classes, n, learned, turn % of, of)
        still = 0 if moves else still + 1
        if still == of:
            break
        moved = classes.copy()
        moved[list(moves)] = list(moves.values())
        after = _class_counts(contexts, moved, g)
        if log_likelihood(after) < likelihoods[-1]:
            of *= 2
            continue
        classes, n = moved, after
        likelihoods.append(log_likelihood(n))
    tokens, types = np.zeros(groups), np.zeros(groups)
    for r in words.groupBy("grouped").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # ``groups`` rows
        tokens[r["grouped"]], types[r["grouped"]] = r["n"], r["v"]
    for w in [*ids, END]:
        if w in counts:
            tokens[spelled(w, groups)] -= counts[w]
            types[spelled(w, groups)] -= 1
    return BrownModel(counts, ids, classes, n, groups, facts["n"] or 0, facts["v"], tokens, types, words, likelihoods)


def score(docs: DataFrame, model: BrownModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score, unseen_score, perplexity`` for each row of ``docs``.

    A text's probability is the product, over its tokens, of the class's transition from the class
    before (the first follows an end) and the word's emission from its class. Every known word gives up half a count, which
    all together in a class are the chance of a new word there; a new word is of its group's class. ``unseen_score`` is the part of the
    score that new words' emissions make, so score - unseen_score is that of the known ones. Counts of the head come
    from the broadcast; those of all other words by a join with the table of counts, so each token of
    each text counts. Null and empty texts hold one token, their end.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.counts, model.ids, model.assigned, *model.tables(), model.groups, model.tokens, model.types))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids, assigned, moves, below, new, groups, tokens, types = shared.value
        size, end = len(ids), len(moves) - 1
        place = {w: i for i, w in enumerate(counts)}  # head words to rows of the arrays below
        count = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        cls = np.fromiter((end if w == END else assigned[ids[w] if w in ids else size + crc32(w[-3:]) % groups] for w in counts), dtype=np.int64, count=len(counts))
        base_below = np.log10(tokens + 0.5 * (types + 1))
        base = np.log10(count + 0.5) - base_below
        emit = np.where(cls == end, 0.0, np.log10(count - 0.5) - below[cls])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for text in batch.column(1).to_pylist():
                toks = words_of(text)
                at = np.array([place.get(w, -1) for w in toks], dtype=np.int64)
                far = at < 0
                seq = cls[at] if len(cls) else np.zeros(len(at), np.int64)
                seq[-1] = end
                away = [i for i in np.flatnonzero(far) if toks[i] is not END]
                rest = Counter(toks[i] for i in away)
                homes = [assigned[size + crc32(w[-3:]) % groups] for w in rest]
                if away:
                    seq[away] = [assigned[size + crc32(toks[i][-3:]) % groups] for i in away]
                near = at[~far]
                b, e = base[near].sum(), emit[near].sum()
                b -= len(away) * base_below
                if far[-1]:  # an end that was never seen in training
                    b += np.log10(0.5) - base_below
                e += moves[np.concatenate(([end], seq[:-1])), seq].sum()
                row += 1
                for col, v in zip(cols, (row, len(toks), len(near), float(b), float(e), list(rest), list(rest.values()), [float(new[c]) for c in homes], [float(below[c]) for c in homes])):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))))],
                names=[id_col, "row", "n_tokens", "near", "base", "emit", "rest", "times", "new", "below"],
            )

    near = materialize(
        docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(
            run, f"`{id_col}` {kind}, row long, n_tokens long, near long, base double, emit double, rest array<binary>, times array<long>, new array<double>, below array<double>"
        )
    )
    rest = near.select("row", F.explode(F.arrays_zip("rest", "times", "new", "below")).alias("z")).select("row", F.col("z.rest").alias("word"), "z.times", "z.new", "z.below")
    seen = F.col("n") > 0
    found = (
        rest.join(model.words.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("base_logs"),
            F.sum(F.col("times") * (F.when(seen, F.log10(F.col("n") - 0.5)).otherwise(F.col("new")) - F.col("below"))).alias("logs"),
            F.sum(F.when(seen, 0.0).otherwise(F.col("times") * (F.col("new") - F.col("below")))).alias("unseen"),
            F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("known"),
        )
    )
    total = F.col("emit") + F.coalesce("logs", F.lit(0.0))
    return near.drop("rest", "times", "new", "below").join(found, "row", "left").select(
        id_col,
        "n_tokens",
        (F.col("near") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_logs", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        F.coalesce("unseen", F.lit(0.0)).alias("unseen_score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
