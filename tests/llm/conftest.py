import pytest
from pyspark.sql import types as T

#: Columns that clash with names the operators use.
CLASHING = ["size", "score", "shard", "slot", "fp", "component_id", "held_out", "lang_pred", "n_tokens", "taken", "target", "row", "g", "h"]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "de", None),
    (None, "ein text ohne nummer steht hier allein", "de", "c"),
    (None, None, None, None),
    (6, "1234 5678 !!", "fr", "c"),
    (7, "été à la plage " * 400, "fr", "c"),
    (8, "one", "en", "a"),
    (9, "Licensed under the MIT License.\nmore text follows here", "en", "z"),
    (10, "ein anderer text mit vielen worten steht hier", "de", "c"),
    (11, "x" * 3000, "en", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * len(CLASHING)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
