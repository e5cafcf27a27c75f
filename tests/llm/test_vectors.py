"""Codes of vectors and hard negatives against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from lagoon.llm import hard_negatives, vector_codes
from lagoon.llm.queries import op12_vector_codes, op13_hard_negatives
from lagoon.session import table
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, uid string, q string, rank string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def codes_of(rows, parts=4, entries=256, rounds=4, scale=1024):
    rows = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if finite(v)]
    w = len(rows[0][1]) // parts
    books = [[q[p * w : (p + 1) * w] for _, q, _ in sorted(rows, key=lambda r: (r[0], r[1]))[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, q, _ in rows:
            best = []
            for p in range(parts):
                off = [sum((a - b) ** 2 for a, b in zip(q[p * w : (p + 1) * w], e)) for e in books[p]]
                best.append((off.index(min(off)), min(off)))
            out.append(best)
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [q[p * w : (p + 1) * w] for (_, q, _), b in zip(rows, at) if b[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    total = {}
    for (_, _, lab), b in zip(rows, at):
        total[lab] = total.get(lab, 0) + sum(x for _, x in b)
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for e, _ in b), sum(x for _, x in b), total[lab], sha) for (i, _, lab), b in zip(rows, at))


def coded(rows, **options):
    found, books = vector_codes.encode(rows, **options)
    return sorted(((r["vec_id"], r["code"] and r["code"].hex(), r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()), key=repr), books


def test_codes_equal_plain_loops(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [(100 + i, rows[3][1], 1) for i in range(30)]  # copies
    rows += [(300, None, 1), (301, [0.1] * 7 + [None], 1), (302, [float("nan")] * 8, 2), (303, [float("inf")] + [0.0] * 7, 2), (304, [0.0] * 8, 2)]
    table_ = frame(spark, rows).repartition(5)
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in table_.collect()]
    for most in (100, 0):  # sums by label broadcast, or in a shuffle
        got, _ = coded(table_, entries=16, most=most)
        assert got == sorted(codes_of(given, entries=16), key=repr)


def test_query_of_codes_equals_plain_loops(spark):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, DATA, "embeddings").limit(500).collect()]
    got = sorted(tuple(r) for r in op12_vector_codes(spark, DATA).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    first, *_ = codes_of(given[:300], rounds=0)
    assert len(got) == len(given) and len(first[1]) == 8
    found, books = vector_codes.encode(table(spark, DATA, "embeddings"))
    assert got[0][4] == vector_codes.fingerprint(books) and books.shape == (4, 256, 16)
    for r in found.limit(40).collect():  # each code is the first of the nearest entries
        q = np.floor(np.array(next(v for i, v, _ in given if i == r["vec_id"]), np.float64) * 1024).astype(np.int64).reshape(4, 16)
        off = ((q[:, None, :] - books) ** 2).sum(axis=2)
        assert bytes(off.argmin(axis=1).tolist()) == bytes(r["code"]) and off.min(axis=1).sum() == r["error"]


def test_nearest_is_the_first_of_several_and_exact_for_large_integers():
    book = np.array([[5, 5], [0, 0], [0, 0], [2**28, 2**28]])
    at, off = vector_codes.nearest(np.array([[0, 0], [1, 1], [2**28 - 1, -(2**28)]]), book)
    assert at.tolist() == [1, 1, 1] and off.tolist() == [0, 2, (2**28 - 1) ** 2 + 2**56]


def test_codes_edges(spark):
    assert coded(frame(spark, []))[0] == []
    assert coded(frame(spark, [(1, None, 1), (2, [float("nan")], 1)]))[0] == []
    rows = [(None, [0.5] * 4, 1), (1, [0.25] * 4, None), (1, [0.25] * 4, None), (2, [0.1] * 5, 3), (3, [], 3), (4, [1e30] * 4, 3)]
    got, books = coded(frame(spark, rows))
    assert books.shape == (4, 3, 1) and books[0, :, 0].tolist() == [256, 256, 512]  # the null id comes last
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:4])
    assert by_id[1] == [("00000000", 0, 0)] * 2 and by_id[None] == [("02020202", 0, 0)]
    assert by_id[2] == by_id[3] == by_id[4] == [(None, None, None)]
    with pytest.raises(ValueError):
        vector_codes.encode(frame(spark, rows), entries=300)


def mined(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """All pairs; rows stand for themselves, so equal ids are rows of their own."""
    rows = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if finite(v) and lab is not None]
    last = float("inf")
    out = []
    for a, (aid, av, al) in enumerate(rows):
        if aid is None or not anchor(aid):
            continue
        score = [sum(x * y for x, y in zip(av, v)) for _, v, _ in rows]
        order = sorted(range(len(rows)), key=lambda k: (-score[k], last if rows[k][0] is None else rows[k][0]))
        for p in [k for k in order if k != a and rows[k][2] == al][:positives]:
            fits = [k for k in order if rows[k][2] != al and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(aid, rows[p][0], n + 1, rows[k][0], score[p], score[k]) for n, k in enumerate(fits[:negatives])]
    return sorted(out, key=repr)


def found(frame_, **options):
    return sorted((tuple(r) for r in frame_.collect()), key=repr)


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_hard_negatives_equal_all_pairs(spark, spread):
    """Tight, middling and no clusters: bounds prune much, some, and nothing."""
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, spread) for x in c], rng.randrange(4)))
    given = frame(spark, rows).repartition(3)
    plain = [(r["vec_id"], r["embedding"], r["label"]) for r in given.collect()]
    want = mined(plain, lambda i: i % 4 == 0)
    assert len(want) > 300
    for options in ({}, {"per_pivot": 4, "most_pivots": 16, "block": 50}):
        assert found(hard_negatives.hard_negatives(given, F.col("vec_id") % 4 == 0, **options)) == want


def test_pruning_keeps_candidates_from_other_cells(spark, monkeypatch):
    """Of tight clusters a candidate reaches few cells, and what is left out could not have counted."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (8, 5))
    cells = hard_negatives.Cells(centres, float((centres**2).sum(axis=1).max()) + 100)
    x = np.floor(np.concatenate([c + rng.normal(0, 1, (50, 5)) for c in centres]))
    off = cells.distances(x, anchor=True)
    own = off.argmin(axis=1)
    spread = np.array([off[own == i, i].max(initial=-np.inf) for i in range(8)])
    least = np.sort(x @ x.T, axis=1)[:, -6]
    reach = np.sqrt(np.maximum((x * x).sum(axis=1) + cells.longest - 2 * least, 0))
    within = np.array([reach[own == i].max(initial=-np.inf) for i in range(8)])
    sent = cells.serves(x, spread, np.tile(within, (len(x), 1)), np.zeros(8))
    sent[np.arange(len(x)), cells.distances(x).argmin(axis=1)] = True
    needed = np.argwhere(x @ x.T >= least[:, None])
    assert all(sent[k, own[a]] for a, k in needed)
    assert sent.mean() < 0.9


def test_hard_negatives_with_copies_ties_and_negative_scores(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(120)]
    rows += [(1000 + i, [1.0, 1.0, 0.0], 1) for i in range(40)] + [(1000 + i, [1.0, 1.0, 0.0], 2) for i in range(20)]
    rows += [(10, [1.0, 0.0, 1.0], 1)] * 3 + [(None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 2)]
    rows += [(20, None, 1), (30, [1.0, float("nan"), 1.0], 1), (40, [1.0, None, 1.0], 0), (50, [1.0, 1.0, 1.0], None)]
    given = frame(spark, rows).repartition(4)
    got = found(hard_negatives.hard_negatives(given, F.col("vec_id") % 10 == 0, per_pivot=3, block=16))
    assert got == mined([r[:3] for r in rows], lambda i: i % 10 == 0)
    assert {r[0] for r in got} >= {10, 1010}


def test_query_of_hard_negatives_equals_all_pairs(spark):
    rows = table(spark, DATA, "embeddings").collect()
    plain = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    assert found(op13_hard_negatives(spark, DATA)) == mined(plain, lambda i: i % 50 == 0)


def test_hard_negatives_edges(spark):
    ask = lambda rows: found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 2 == 0))
    assert ask([]) == []
    assert ask([(1, [1.0], 1)]) == []
    assert ask([(2, [1.0], 1)]) == []
    assert ask([(2, [0.0, 0.0], 1), (3, [0.0, 0.0], 1), (5, [0.0, 0.0], 2)]) == [(2, 3, 1, 5, 0, 0)]
    two = [(2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.75, 0.0], 2), (5, [0.9, 0.0], 2), (7, [1.0], 2), (9, [1e30, 0.0], 2)]
    assert ask(two) == mined(two[:4], lambda i: i % 2 == 0)
    wide = [(i, [2.0**24 + i, 1.0, 0.5], i % 2 + (i > 2)) for i in range(8)]
    assert ask(wide) == mined(wide, lambda i: i % 2 == 0)
    labels = spark.createDataFrame([(2, [1.0], "a"), (3, [1.0], "a"), (4, [0.75], "b")], "vec_id int, embedding array<double>, label string")
    assert found(hard_negatives.hard_negatives(labels, F.col("vec_id") == 2)) == [(2, 3, 1, 4, 65536, 49152)]
