"""Rows kept apart: null and repeated ids in the mix, columns of the operators' own names, tables of two runs."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagoon.llm import language_id, mixing, rows
from lagoon.session import table
from lagoon.storage import Scope, materialize

DATA = "/root/testdata/sf0.001"


def test_occurrences_number_equal_keys(spark):
    frame = materialize(spark.range(1000).repartition(7).select((F.col("id") % 13 % 5).alias("k"), "id", F.monotonically_increasing_id().alias("row")))
    got = rows.occurrences(frame, "k", "row", "nth").collect()
    assert len(got) == 1000
    for k in range(5):
        assert sorted(r["nth"] for r in got if r["k"] == k) == list(range(sum(r["k"] == k for r in got)))
    alone = rows.occurrences(frame.filter("id < 1"), "k", "row", "nth").collect()
    assert [r["nth"] for r in alone] == [0]


@pytest.mark.parametrize("ids", ["null", "repeated", "none at all", "own"])
def test_mix_hits_its_targets_whatever_the_ids(spark, ids):
    rng = random.Random(5)
    made = []
    for i in range(900):
        source = "abc"[i % 3]
        words = 40 if i % 10 else 90
        text = " ".join(rng.choice("uvwxyz") * 3 for _ in range(words)) if i % 5 else "same text of a copy " * 8
        made.append(({"null": i if i % 2 else None, "repeated": i % 7, "none at all": None, "own": i}[ids], text, source))
    frame = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5)
    size = Counter()
    for _, t, s in made:
        size[s] += len(t.split())
    total = sum(size.values())
    want = {s: total * w / 6 for s, w in zip("abc", (1, 2, 3))}
    out = mixing.mix_rows(frame).collect()
    got = Counter()
    for r in out:
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - want[s]) <= 0.05 * want[s] for s in want), (got, want)
    again = Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in mixing.mix_rows(frame.repartition(3)).collect())
    assert again == Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in out)
    most = Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    there = Counter(made)
    assert all(most[k] <= 3 * there[k] for k in most)


def test_columns_of_the_operators_names_stay(spark):
    own = ["__row", "__id", "__n", "__copy", "__lang", "__held", "__score", "__text", "__letters", "__key", "__same", "__who", "kept__row", "__N2"]
    docs = table(spark, DATA, "documents").limit(60)
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in own})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}:{r['doc_id']}" for r in got for c in own)


def test_two_runs_in_one_driver_keep_their_tables(spark):
    before = materialize(spark.range(5))
    with Scope() as one:
        kept, lost = materialize(spark.range(7)), materialize(spark.range(3))
        with Scope() as two:
            inner = materialize(spark.range(11))
            two.sweep()
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            inner.collect()
        one.sweep(kept)
        assert kept.count() == 7 and before.count() == 5
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            lost.collect()
        first = corpus_pipeline.run(spark, DATA)
        second = corpus_pipeline.run(spark, DATA)
    assert first.count() == second.count() > 0


def test_texts_reach_python_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["n"])
    got = list(rows.pieces(iter([batch, batch]), 1000))
    assert [len(x) for x in got] == [1000, 1000, 500] * 2 and pa.Table.from_batches(got).column("n").to_pylist() == [*range(2500)] * 2


def test_a_language_is_told_once_and_texts_stay_in_the_plan(spark):
    """Beside the model, one column goes to Python: a filter of the language doesn't run it again, and no text comes back."""
    frame = spark.createDataFrame([(k, f"some words of text {k}" if k % 5 else None, "en") for k in range(40)], "doc_id long, text string, lang string")
    told = language_id.identify(frame)
    kept = told.filter("lang_pred <> 'und' AND score >= 0")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert kept.count() == 32 and told.filter("lang_pred = 'und' AND score = 0").count() == 8
