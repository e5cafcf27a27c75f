"""Registered queries over recordings that grow: streams, ends of files, archives, pins; and over JSON of any shape."""

from __future__ import annotations

import uuid
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.operators import json_walk
from lagoon.plans.registry import PAIRS, register
from lagoon.sources import pins, ranges, tables
from lagoon.storage import materialize, shared_dir
from lagoon.streaming.open_calls import open_calls, pair_stream

BUCKETS = 8
#: A line of a conversation's recording: ids and a digest, so that both sides know its bytes.
LINES = f"""l AS (SELECT CAST(conv_id % {BUCKETS} AS INT) AS b, conv_id, turn, '{{"s":' || conv_id || ',"t":' || turn || ',"d":"' || md5(coalesce(text, '')) || '"}}' AS line FROM conversations),
  p AS (SELECT *, strlen(line) + 1 AS n, CAST(sum(strlen(line) + 1) OVER (PARTITION BY b ORDER BY conv_id, turn, line) AS BIGINT) AS stop, CAST(sum(strlen(line) + 1) OVER (PARTITION BY b) AS BIGINT) AS size FROM l)"""


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lagoon-{uuid.uuid4().hex}"


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit('{"s":'), F.col("conv_id").cast("string"), F.lit(',"t":'), F.col("turn").cast("string"), F.lit(',"d":"'), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit('"}')]
    return tables.table(spark, sf_dir, "conversations").select((F.col("conv_id") % BUCKETS).cast("int").alias("b"), "conv_id", "turn", F.concat(*parts).alias("line"))


def written(rows: DataFrame) -> str:
    """One file for each bucket, however many conversations it holds."""
    at = folder(rows.sparkSession)
    rows.repartition(BUCKETS, "b").sortWithinPartitions("b", "conv_id", "turn", "line").select("b", "line").write.partitionBy("b").text(at)
    return at


def bucket() -> Column:
    return F.regexp_extract("file", r"/b=(\d+)/", 1).cast("int")


@register(f"""WITH {PAIRS} SELECT harness, session, ordinal, direction, call_id, name, status, pair, pair_name, pair_status, duration_ms, incomplete FROM pairs""")
def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in three loads, the stream stops after each and goes on from its checkpoint; what it never closed is read from its state."""
    events = materialize(tables.event_turns(spark, sf_dir).filter("direction IS NOT NULL").select("harness", "session", "ordinal", "ts", "direction", "call_id", "name", "status"))
    came, went, kept = folder(spark), folder(spark), folder(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in ((0, 6), (6, 14), (14, 1 << 40)):
            events.filter(F.col("ordinal").between(low, high - 1)).write.mode("append").parquet(came)
            stream = spark.readStream.schema(events.schema).parquet(came)
            pair_stream(stream).writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(went).awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    told = spark.read.parquet(went).unionByName(open_calls(spark, kept))
    return told.withColumns({"session": F.col("session").cast("long"), "call_id": F.col("call_id").cast("long")})


@register(
    f"""WITH {LINES} SELECT b, any_value(size) AS size, count(*) FILTER (WHERE stop - n >= size - 4000) AS lines, CAST(sum(n) FILTER (WHERE stop - n >= size - 4000) AS BIGINT) AS bytes,
  bool_or(stop - n < size - 4000 AND stop > size - 4000) AS split, size > 4000 AS bounded, CASE WHEN size > 4000 THEN count(*) FILTER (WHERE stop <= 65536) ELSE 0 END AS head FROM p GROUP BY b, size"""
)
def recording_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 4,000 bytes of each recording, and its opening lines where it is longer."""
    ranges.register(spark)
    read = spark.read.format("recording_tail").options(bytes="4000", anyBytes="1", pattern="*.txt").load(written(line_rows(spark, sf_dir)))
    tail, gap = F.col("part") == "tail", F.coalesce("reason", F.lit(""))
    return read.groupBy(bucket().alias("b"), "size").agg(
        F.count_if(tail).alias("lines"), F.sum(F.when(tail, F.col("end") - F.col("start"))).alias("bytes"), F.bool_or(gap == "discarded-partial-record").alias("split"),
        F.bool_or(gap == "outside-tail-bound").alias("bounded"), F.count_if(F.col("part") == "head").alias("head"),
    )


def archives(rows: DataFrame) -> str:
    """ZIP archives of some 500 conversations each, with a JSON member for every one: lists of lines."""
    at = folder(rows.sparkSession)
    many = -(-rows.agg(F.approx_count_distinct("conv_id")).first()[0] // 500) or 1

    def pack(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        fs, root = pafs.FileSystem.from_uri(at)
        fs.create_dir(root)
        names = table.column("conv_id").to_pylist()
        members: dict = {}
        for name, _, line in sorted(zip(names, table.column("turn").to_pylist(), table.column("line").to_pylist())):
            members.setdefault(name, []).append(line)
        with fs.open_output_stream(f"{root}/b{b}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, lines in members.items():
                archive.writestr(f"c{name}.json", "[" + ",".join(lines) + "]")
        return pa.table({"b": [b]}, schema=pa.schema([("b", pa.int32())]))

    rows.withColumn("b", F.pmod(F.xxhash64("conv_id"), F.lit(many)).cast("int")).groupBy("b").applyInArrow(pack, "b int").count()
    return at


@register(
    f"""WITH {LINES}, m AS (SELECT b, conv_id, CAST(sum(strlen(line)) + count(*) + 1 AS BIGINT) AS bytes, count(*) AS n FROM l GROUP BY b, conv_id)
  SELECT b, conv_id AS session, bytes, CASE WHEN bytes > 600 THEN 0 ELSE n END AS records, CASE WHEN bytes > 600 THEN 'member-bytes-bound' END AS reason FROM m"""
)
def archived_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of up to 600 bytes are read from archives of conversations; larger ones are told and never decoded."""
    ranges.register(spark)
    read = spark.read.format("export_members").options(memberBytes="600", members="100000000").load(archives(line_rows(spark, sf_dir)))
    session = F.regexp_extract("member", r"^c(\d+)\.json$", 1).cast("long")
    return read.groupBy((session % BUCKETS).cast("int").alias("b"), session.alias("session"), "bytes", "reason").agg(F.count("value").alias("records"))


def later(rows: DataFrame) -> DataFrame:
    """The recordings some time on: of four buckets one is as it was, one has grown, one lost its last lines, one was rewritten."""
    grown = rows.filter("b % 4 = 1").groupBy("b").agg((F.max("conv_id") + 1).alias("conv_id")).select("b", "conv_id", F.lit(0).alias("turn"), F.lit('{"later":1}').alias("line"))
    last = rows.groupBy("b").agg(F.max("conv_id").alias("last"))
    kept = rows.join(last, "b").filter("b % 4 <> 2 OR conv_id < last").drop("last")
    changed = kept.withColumn("line", F.when(F.col("b") % 4 == 3, F.replace("line", F.lit('"d":"'), F.lit('"D":"'))).otherwise(F.col("line")))
    return changed.unionByName(grown)


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of the first state of the recordings, asked of where they lie in the second."""
    rows = line_rows(spark, sf_dir)
    first, second = written(rows), written(later(rows))
    now = spark.createDataFrame(ranges.listed(second, "*.txt"), "file string, size bigint").select(bucket().alias("b"), F.col("file").alias("moved"))
    held = pins.pin(spark, first, "*.txt", chunk=1000).withColumn("b", bucket())
    return held.join(now, "b", "left").withColumn("file", F.coalesce("moved", F.concat(F.lit(second), F.lit("/b="), F.col("b").cast("string"), F.lit("/none")))).drop("moved", "b")


@register(
    f"""WITH {LINES}, g AS (SELECT b, any_value(size) AS size, count(*) AS n, count(DISTINCT conv_id) AS c FROM p GROUP BY b)
  SELECT b, size, CASE b % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'grown' WHEN 2 THEN CASE WHEN c > 1 THEN 'truncated' ELSE 'missing' END ELSE 'changed' END AS state, CASE WHEN b % 4 < 2 THEN n ELSE 0 END AS lines, CASE WHEN b % 4 < 2 THEN size ELSE 0 END AS bytes FROM g"""
)
def pinned_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each pinned recording, and the lines that a replay gives: those of the pin and none that came later."""
    held = pinned(spark, sf_dir)
    lines, _ = pins.replay(held)
    read = lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.col("end") - F.col("start")).alias("bytes"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("lines", "bytes")}
    return pins.verify(held).join(read, "file", "left").select(bucket().alias("b"), "size", "state", zero["lines"], zero["bytes"])


@register(
    f"""WITH {LINES}, w AS (SELECT * FROM p WHERE b % 4 < 2 AND stop - n >= size - 1500), f AS (SELECT b, size, count(*) AS lines, min(stop - n) AS begun FROM w GROUP BY b, size)
  SELECT b, lines, CASE WHEN size > 1500 THEN begun END AS next FROM f"""
)
def pinned_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1,500 bytes of each pinned recording that still holds them, and where the page before ends."""
    held = pinned(spark, sf_dir)
    lines, after = pins.page(held, held.select("file", F.col("size").alias("end")).distinct(), 1500)
    read = lines.groupBy("file").agg(F.count("*").alias("lines"))
    return read.join(after.filter("state = 'read'"), "file").select(bucket().alias("b"), "lines", F.col("end").alias("next"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON value for each order: its lines as citations with sources, and files inside lists and objects."""
    part, supplier, n = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    line = tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
            F.struct(
                F.lit("webpage").alias("type"), F.concat(F.lit("u"), part).alias("url"), n.cast("long").alias("start_idx"),
                F.when(n % 2 == 1, F.array(F.struct(F.concat(F.lit("s"), supplier).alias("title"), F.lit(None).cast("string").alias("note")), F.struct(F.lit(None).cast("string").alias("title"), supplier.alias("note")))).alias("sources"),
            ).alias("ref"),
            F.struct(F.concat(F.lit("p"), part).alias("path"), F.when(n > 3, F.col("l_suppkey").cast("long")).alias("size"), F.struct(F.concat(F.lit("d"), supplier).alias("sha256")).alias("inner")).alias("file"),
        ).alias("x"),
    )
    both = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return both.select(F.col("l_orderkey").alias("doc"), F.to_json(F.struct(F.struct(F.col("x.ref").alias("content_references")).alias("meta"), F.array("x.file").alias("files"))).alias("value"))


PAPERS = """x AS (SELECT l_orderkey AS doc, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k FROM lineitem)"""


@register(
    f"""WITH {PAPERS} SELECT doc, CAST(k AS INT) AS place, NULL AS source, 'webpage' AS kind, 'u' || l_partkey AS uri, NULL AS title, CAST(l_linenumber AS BIGINT) AS start FROM x
  UNION ALL SELECT doc, k, 1, NULL, NULL, 's' || l_suppkey, NULL FROM x WHERE l_linenumber % 2 = 1"""
)
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and their sources, found below ``content_references`` wherever it stands."""
    found, _ = json_walk.citations(papers(spark, sf_dir), ["doc"], "value")
    return found.select("doc", "place", "source", "kind", "uri", "title", "start")


@register(
    f"""WITH {PAPERS}, f AS (SELECT doc, k, 0 AS j, NULL AS uri, 'p' || l_partkey AS path, NULL AS digest, CASE WHEN l_linenumber > 3 THEN CAST(l_suppkey AS BIGINT) END AS bytes FROM x
  UNION ALL SELECT doc, k, 1, NULL, NULL, 'd' || l_suppkey, NULL FROM x UNION ALL SELECT doc, 1000 + k, 0, 'u' || l_partkey, NULL, NULL, NULL FROM x)
  SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY k, j) AS INT) AS place, uri, path, digest, bytes FROM f QUALIFY place <= 20"""
)
def referenced_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 objects of each value that describe an artifact, in walking order."""
    return json_walk.artifact_references(papers(spark, sf_dir), ["doc"], "value", most=20).drop("kind")
