"""Language model against plain loops: features byte by byte, the family first, then every pair's vote."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.llm import language_id
from lagoon.session import table

DATA = "/root/testdata/sf0.001"
WORD = 2**32


def features(text):
    held = []
    for c in b" " + text + b" ":
        c = c + 32 if 65 <= c <= 90 else 32 if c <= 32 or 48 <= c <= 57 else c
        if c != 32 or not held or held[-1] != 32:
            held.append(c)
    counts = Counter(held)
    for a, b in zip(held, held[1:]):
        counts[(a * 257 + b) * 2_654_435_761 % WORD >> 19] += 1
    for a, b, c in zip(held, held[1:], held[2:]):
        counts[((a * 257 + b) * 65_599 + c) % WORD * 2_246_822_519 % WORD >> 19] += 1
    del counts[32]
    norm = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(n) / norm for k, n in counts.items() if n} if norm else {}


def margin(weights, x):
    return sum(float(weights[k]) * v for k, v in x.items()) + float(weights[-1])


def chance(m):
    return 1 / (1 + math.exp(-m))


def predict(model, text):
    x = features(text)
    names = list(model.families)
    margins = [model.scale * margin(w, x) for w in model.family_weights]
    best = max(range(len(names)), key=lambda k: margins[k])
    members = model.families[names[best]]
    votes, belief = [0] * len(members), [1.0] * len(members)
    for i, j, w in model.pairs.get(names[best], []):
        p = chance(model.scale * margin(w, x))
        votes[i if p >= 0.5 else j] += 1
        belief[i], belief[j] = min(belief[i], p), min(belief[j], 1 - p)
    pick = max(range(len(members)), key=lambda k: votes[k] + 0.5 * belief[k])
    return members[pick], min(max(chance(margins[best]) * belief[pick], 0.0), 1.0)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["lang"], (r["text"] or "").encode()) for r in table(spark, DATA, "documents").orderBy("doc_id").collect()]


def test_features_equal_plain_loops(texts):
    odd = [b"", b" ", b"A1b2 C\x00\xff", "ÉÜ語 İ".encode(), b"x" * 4000, b"1234"]
    for text in [t for _, t in texts[:60]] + odd:
        (row,) = language_id.features([text])
        want = features(text)
        assert np.flatnonzero(row).tolist() == sorted(k for k, v in want.items() if v)
        assert all(math.isclose(row[k], v, rel_tol=1e-4) for k, v in want.items())


def test_predictions_equal_plain_loops(texts):
    known = [(lang, t) for lang, t in texts if lang and t][:120]
    model = language_id.train(language_id.features([t for _, t in known]), [lang for lang, _ in known])
    got = model.predict([t for _, t in texts])
    for (_, text), lang, score in zip(texts, *got):
        name, value = predict(model, text)
        assert lang == name and math.isclose(score, value, rel_tol=1e-3, abs_tol=1e-5)


def test_query_equals_the_model_on_its_documented_sample(spark):
    """The whole query: the sample of least hashes, its model, and the vote of plain loops on every text."""
    docs = table(spark, DATA, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    sample = language_id.training_rows(docs.filter(~held), 600, 12_000, "doc_id", "text", "lang")
    model = language_id.train(*language_id._collect_features(sample))
    rng = random.Random(1)
    for r in rng.sample(language_id.identify(docs).collect(), 60):
        text = (r["text"] or "").encode()
        if r["lang_pred"] == "und":
            assert not any(c.isalpha() for c in r["text"] or "")
            continue
        name, value = predict(model, text)
        assert r["lang_pred"] == name and math.isclose(r["score"], value, rel_tol=1e-3, abs_tol=1e-5)
