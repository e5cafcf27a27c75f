"""A corpus made ready for training: each stage works on all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm.decontaminate import drop_contaminated
from lagoon.llm.language_id import identify
from lagoon.llm.mixing import mix_rows
from lagoon.llm.rows import shielded
from lagoon.llm.sharding import shard_by_bytes
from lagoon.llm.similar import drop_near_duplicates
from lagoon.session import table
from lagoon.storage import Scope, materialize

#: Least score of a predicted language; texts without letters have none.
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language (operator 7); ``lang`` is replaced by the one predicted, no other column changes."""

    @shielded
    def told(docs: DataFrame) -> DataFrame:
        found = identify(docs, names=("__held", "__lang", "__score")).filter((F.col("__lang") != "und") & (F.col("__score") >= MIN_SCORE))
        return found.withColumn("lang", F.col("__lang")).select(docs.columns)

    return told(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (operator 10, then Jaccard similarity 0.8 of five-word shingles): that of the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a test item (operator 6)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (operator 5): whole copies, the nearest number to the words taken."""

    @shielded
    def copies(docs: DataFrame) -> DataFrame:
        return mix_rows(docs, copy_col="__copy").select(docs.columns)

    return copies(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row (operator 8): the places of the corpus, without its texts."""
    return shard_by_bytes(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The stages hold learned models and hash selections that SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    with Scope() as made:
        for _, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir))
            made.sweep(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
