"""The test tables read as sessions, turns, tool events, requests, lineage and quota observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.session import table
from lagoon.storage import spread

HARNESSES = ("claude", "codex", "pi", "opencode")


def harness_of(column: str):
    return F.element_at(F.array(*[F.lit(h) for h in HARNESSES]), (F.col(column) % 4 + 1).cast("int"))


def dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table dealt by ``keys``, so that a task's part doesn't grow with it; its rows are counted from the files' footers."""
    rows = table(spark, sf_dir, name)
    return spread(rows, rows.count(), *keys)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: no times; users are operators, systems control."""
    return table(spark, sf_dir, "conversations").select(
        harness_of("conv_id").alias("harness"),
        F.col("conv_id").alias("session"),
        F.col("turn").cast("long").alias("ordinal"),
        "role",
        F.when(F.col("role") == "user", "operator").when(F.col("role") == "assistant", "assistant").when(F.col("role") == "system", "control").otherwise("unknown").alias("kind"),
        "text",
    )


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a user's events in time order; clicks call a tool, purchases answer, half of them without its name."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = {"signup": "operator", "view": "assistant", "click": "tool", "purchase": "tool", "error": "notice"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.lit("claude").alias("harness"),
        F.col("user_id").alias("session"),
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        "ts",
        F.coalesce(kind[F.col("event_type")], F.lit("unknown")).alias("kind"),
        F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "purchase", "result").alias("direction"),
        (k % 4).alias("call_id"),
        F.when((F.col("event_type") != "purchase") | (k % 2 == 1), F.concat(F.lit("tool"), (k % 3).cast("string"))).alias("name"),
        F.when(k % 5 == 0, "error").alias("status"),
        "value",
        F.col("event_type").alias("pool"),
        "event_id",
    )


def line_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of an order: counters of each line; a cache write is recorded on odd lines only."""
    keys = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = dealt(spark, sf_dir, "lineitem", "l_orderkey").select("l_orderkey", *keys, "l_quantity", "l_returnflag", "l_linestatus")
    return lines.select(
        F.col("l_orderkey").alias("session"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*keys)).cast("long").alias("ordinal"),
        F.col("l_shipdate").alias("at"),
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.col("l_quantity").cast("long").alias("input"),
        (F.col("l_partkey") % 1000).alias("output"),
        ((F.col("l_partkey") % 1000) % 7).alias("reasoning"),
        (F.col("l_suppkey") % 100).alias("cache_read"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber").cast("long") * 10).alias("cache_write"),
    )


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from orders; the parent is the same customer's order before."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        harness_of("o_custkey").alias("harness"),
        F.col("o_orderkey").alias("session"),
        F.col("o_orderpriority").alias("directory"),
        F.when(F.col("o_orderstatus") == "F", "headless").when(F.col("o_orderstatus") == "O", "interactive").alias("launch"),
        F.col("o_orderdate").alias("last_activity"),
        F.lag("o_orderkey").over(before).alias("parent"),
    )
