"""The registered queries over the test tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import brown
from lagoon.llm.decontaminate import contaminated
from lagoon.llm.embedding_dedup import close_pairs
from lagoon.llm.hard_negatives import hard_negatives
from lagoon.llm.language_id import identify
from lagoon.llm.license_scan import scan_licenses
from lagoon.llm.mixing import mix_sources
from lagoon.llm.oracles import ORACLE
from lagoon.llm.quality import quality_filter
from lagoon.llm.rule_forest import judge_quality
from lagoon.llm.sharding import shard_by_bytes
from lagoon.llm.simhash import near_duplicates
from lagoon.llm.suffix_dedup import remove_repeats
from lagoon.llm.vector_codes import encode
from lagoon.session import table


def op1_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = brown.score(docs, brown.fit(docs.filter(~brown.held_out())))
    return scored.select("doc_id", brown.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "unseen_score", "perplexity")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_pairs(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and the test item it holds a copy of."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taken`` is the sum of ``parts``, the words that fill each shard's block quotas."""
    return mix_sources(table(spark, sf_dir, "documents"))[0]


def op8_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: shards of near equal size, contiguous in document order."""
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))[0].select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id has the next label, so that labels aren't those of the clusters."""
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_brown_score, op2_quality, op3_license_scan, op4_embedding_dedup, op5_mix_sources, op6_decontaminate, op7_language_id, op8_shard_by_bytes, op9_suffix_dedup, op10_simhash, op11_rule_forest, op12_vector_codes, op13_hard_negatives)}

__all__ = ["ORACLE", "QUERIES"]
