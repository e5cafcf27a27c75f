"""Quality rules against plain loops, the forest against a walk of its trees, and the verdict on labelled texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm import rule_forest
from lagoon.llm.queries import op11_rule_forest
from lagoon.session import table

DATA = "/root/testdata/sf0.001"
BLANKS = " \t\n\v\f\r"


def words_of(text):
    out, word = [], ""
    for c in text:
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def base(text):
    text = text or ""
    w = words_of(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_rules_equal_plain_loops(spark):
    docs = table(spark, DATA, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = op11_rule_forest(spark, DATA).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_repeats_equal_plain_loops_on_few_words():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "c", "é"]) + rng.choice([" ", "  ", "\n", " | "]) for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    texts += ["", " \n ", "a", "a b c d e f g", "a b c d e f g h", "a " * 9, "x" * 5000, "a\x0bb\x0cc d\x85e"]
    got = rule_forest.rule_counts([t.encode() for t in texts])
    for t, r in zip(texts, got):
        assert tuple(r[:5]) == base(t)[:5], t


def test_forest_equals_a_walk_of_each_tree():
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.uniform(0.2, 0.3, 500), np.zeros(500), rng.uniform(0, 1, 500)))
    forest = rule_forest.grow(x, trees=40, sample=64, depth=9, seed=1)
    asked = np.array([[0.25, 0.0, 0.5], [0.25, 0.9, 0.5], [0.9, 0.0, 0.5], [0.0, 1.0, 1.0]])
    usual = 2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64

    def walk(at, row):
        while forest.child[at] >= 0:
            at = forest.child[at] + (row[forest.feature[at]] >= forest.cut[at])
        return forest.path[at]

    for row, score in zip(asked, forest.scores(asked)):
        mean = sum(float(walk(r, row)) for r in forest.roots) / 40
        assert score == pytest.approx(2 ** (-mean / usual), abs=1e-6)
    usual_row, *others = forest.scores(asked)
    assert min(others) > usual_row + 0.05  # also along the statistic that no row of the sample varies in
    again = rule_forest.grow(x, trees=40, sample=64, depth=9, seed=1)
    assert (again.scores(asked) == forest.scores(asked)).all()


def test_leaves_count_every_row_of_the_sample():
    x = np.random.default_rng(0).uniform(0, 1, (300, 2))
    forest = rule_forest.grow(x, trees=3, sample=256, depth=7, seed=2)
    assert rule_forest.expected_path(1) == 0 and rule_forest.expected_path(2) == 1
    assert forest.path.max() <= 7 + float(rule_forest.expected_path(256))
    assert rule_forest.grow(np.zeros((0, 2)), 2, 8, 4, 1).scores(x[:3]).shape == (3,)


def test_threshold_by_hand():
    counts = [(300, False, 95), (400, False, 4), (500, False, 1), (450, True, 8), (600, True, 2)]
    assert rule_forest.threshold_of(counts, loss=0.0, cost=10) == 600
    assert rule_forest.threshold_of(counts, loss=0.02, cost=10) == 450
    assert rule_forest.threshold_of(counts, loss=0.02, cost=100) == 600
    assert rule_forest.threshold_of([(1, True, 5)], 0.1, 1) is None
    assert rule_forest.threshold_of([(1, False, 99), (7, False, 1)], 0.01, 10) == 7


def test_flagged_words_are_counted_by_context(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(50)]

    def text(*more):
        return " ".join(x for _ in range(40) for x in (rng.choice(plain), *(more and [rng.choice(more)] if rng.random() < 0.3 else [])))

    rows = [(i, text("Vile,", "nasty")) for i in range(60)] + [(i, text()) for i in range(60, 160)]
    copy = "only copies say zig zag " + text()
    rows += [(i, copy) for i in range(160, 220)]
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.col("text").cast("binary").alias("text"))
    marks = spark.createDataFrame([(i, i < 60 or i >= 160, i < 60 or i >= 160) for i in range(220)], "id long, toxic boolean, bad boolean")
    assert rule_forest.flagged_words(docs, marks, per_class=1000) == {b"vile", b"nasty"}
    assert rule_forest.flagged_words(docs, marks.filter("NOT toxic"), per_class=1000) == frozenset()


def test_least_is_bounded_and_repeats_stay_together(spark):
    rows = spark.range(5000).selectExpr("id % 1000 as key", "id % 2 = 0 as odd")
    got = rule_forest._least(rows, ["key"], F.col("odd"), 600, 1).groupBy("class", "key").count().collect()
    sizes = Counter()
    for r in got:
        assert r["count"] == 5
        sizes[r["class"]] += 5
    assert all(400 <= n <= 600 for n in sizes.values()) and len(sizes) == 2


def test_labelled_texts_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    got = op11_rule_forest(spark, d).filter("NOT base_failed").join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    clean = [r["kept"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in held if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(clean) / len(clean) >= 0.99 and sum(bad) / len(bad) <= 0.08


def test_edges(spark, edge, empty):
    labels = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    none = spark.createDataFrame([], labels)
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, None), (None, 0, 1), (8, None, None), (99, 1, 0)], labels)
    for given in (none, some):
        got = rule_forest.judge_quality(edge, given).collect()
        assert len(got) == 14
        for r, (n, chars, *_, failed) in [(r, base("été à la plage " * 400)) for r in got if r["doc_id"] == 7]:
            assert (r["n_words"], r["word_chars"], r["base_failed"]) == (n, chars, failed)
        assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (3, 4, 5, 8))
    assert rule_forest.judge_quality(empty, some).count() == 0
