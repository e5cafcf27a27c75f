"""Registered roll-ups of consumption and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.operators import accounting, lineage, usage
from lagoon.plans.registry import PAIRS, REQUESTS, SESSIONS, TURNS, USED, paired, register, used_sessions
from lagoon.sources import tables

#: Orders as sessions whose figure is a recorded total or a sum, over the session, a part, or since a reset.
BASED = f"""{REQUESTS}, {SESSIONS}, {USED}, based AS (SELECT s.session, s.harness, s.directory, s.launch, CASE s.launch WHEN 'headless' THEN 'recorded-total' ELSE 'summed-requests' END AS accounting,
  CASE substring(s.directory, 1, 1) WHEN '1' THEN 'since-reset' WHEN '2' THEN 'read-window' ELSE 'session' END AS coverage, CASE WHEN s.session % 16 > 0 THEN u.input END AS input, CASE WHEN s.session % 16 > 0 THEN u.output END AS output,
  CASE WHEN s.session % 16 > 0 THEN u.reasoning END AS reasoning, CASE WHEN s.session % 16 > 0 THEN u.cache_read END AS cache_read, CASE WHEN s.session % 16 > 0 THEN u.cache_write END AS cache_write FROM sessions s LEFT JOIN used u USING (session))"""


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixteenth order's figure isn't recorded."""
    first = F.substring("directory", 1, 1)
    given = used_sessions(spark, sf_dir).withColumns({
        "accounting": F.when(F.col("launch") == "headless", "recorded-total").otherwise("summed-requests"),
        "coverage": F.when(first == "1", "since-reset").when(first == "2", "read-window").otherwise("session"),
    })
    return given.withColumns({c: F.when(F.col("session") % 16 > 0, F.col(c)) for c in usage.COUNTERS})


@register(
    f"""WITH {BASED}, c AS (SELECT harness, CASE WHEN coalesce(input, output, reasoning, cache_read, cache_write) IS NULL THEN 'none' WHEN coverage = 'since-reset' THEN coverage WHEN accounting = 'recorded-total' THEN accounting WHEN coverage = 'read-window' THEN 'summed-read-window' ELSE 'summed-session' END AS k FROM based)
  SELECT harness, count(*) FILTER (WHERE k = 'recorded-total') AS recorded_total, count(*) FILTER (WHERE k = 'summed-session') AS summed_session, count(*) FILTER (WHERE k = 'summed-read-window') AS summed_read_window, count(*) FILTER (WHERE k = 'since-reset') AS since_reset, count(*) FILTER (WHERE k = 'none') AS "none" FROM c GROUP BY harness"""
)
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.coverage_classes(based(spark, sf_dir), ["harness"])


@register(f"WITH {BASED} SELECT harness, accounting, count(*) AS sessions, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}, count({c}) AS {c}_sessions" for c in usage.COUNTERS) + " FROM based GROUP BY harness, accounting")
def accounting_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.accounting_partitions(based(spark, sf_dir))


@register(
    f"""WITH {BASED} SELECT directory, launch, count(*) AS sessions, count(DISTINCT harness) > 1 AS mixed_domain, count(DISTINCT accounting) > 1 AS mixed_accounting, CASE WHEN count(DISTINCT harness) <= 1 THEN CAST(sum(input) AS BIGINT) END AS input,
  CASE WHEN count(DISTINCT accounting) <= 1 THEN CAST(sum(input) AS BIGINT) END AS disjoint_input FROM based GROUP BY directory, launch"""
)
def partition_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.partition_withheld(based(spark, sf_dir), ["directory", "launch"])


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, r AS (SELECT r.*, s.harness FROM requests r JOIN sessions s USING (session)), e AS (
  SELECT session, 'uncached_input' AS counter, 'undetermined' AS reason FROM r WHERE harness = 'codex' AND (coalesce(cache_write, 1) <> 0 OR input < cache_read)
  UNION SELECT session, 'cache_write', 'missing-counter' FROM r WHERE cache_write IS NULL UNION SELECT session, 'reasoning', 'undetermined' FROM r WHERE reasoning > output)
  SELECT session, counter, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM e GROUP BY session, counter"""
)
def reason_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.line_requests(spark, sf_dir).join(tables.order_sessions(spark, sf_dir).select("session", "harness"), "session")
    each = requests.select("session", F.explode(accounting.disjoint_reasons()).alias("x")).select("session", "x.*")
    return accounting.reason_union(each, ["session"])


@register(
    """WITH r AS (SELECT l_orderkey AS session, l_suppkey % 3 AS request, CAST(l_quantity AS BIGINT) // 10 AS cache_write, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_quantity AS BIGINT) // 10 - l_linenumber % 2 END AS w5, CASE WHEN l_linenumber % 4 > 0 THEN CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber % 2 END END AS w1 FROM lineitem),
  t AS (SELECT session, request, max(cache_write) AS cache_write FROM r GROUP BY ALL), f AS (SELECT session, request, cache_write, count(DISTINCT (w5, w1)) AS n, min(w5) AS a, min(w1) AS b FROM r WHERE w5 + w1 = cache_write GROUP BY ALL)
  SELECT t.session, t.request, t.cache_write, CASE WHEN n = 1 THEN a END AS write_5m, CASE WHEN n = 1 THEN b END AS write_1h, CASE WHEN n IS NULL THEN 'unrecorded' WHEN n = 1 THEN 'recorded' ELSE 'conflict' END AS split
  FROM t LEFT JOIN f ON t.session = f.session AND t.request = f.request AND t.cache_write = f.cache_write"""
)
def ttl_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with one supplier class are one request; a fourth of them have no split, line 7's contradicts its total."""
    total, one, split = F.floor(F.col("l_quantity").cast("long") / 10), (F.col("l_linenumber") % 2).cast("long"), F.col("l_linenumber") % 4 > 0
    records = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), (F.col("l_suppkey") % 3).alias("request"), F.col("l_linenumber").alias("ordinal"), total.alias("cache_write"),
        F.when(split, total - one).alias("w5"), F.when(split, F.when(F.col("l_linenumber") == 7, 0).otherwise(one)).alias("w1"),
    )
    return accounting.ttl_witness(records, ["session", "request"])


@register(
    f"""WITH {REQUESTS}, r AS (SELECT session, ordinal, input, CASE WHEN ordinal % 5 > 0 THEN output % 4 END AS response FROM requests),
  n AS (SELECT *, row_number() OVER (PARTITION BY session, response ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY session, response) - 1 AS repeats FROM r)
  SELECT session, ordinal, input, response, CASE WHEN response IS NULL THEN 0 ELSE repeats END AS repeats FROM n WHERE n = 1 OR response IS NULL"""
)
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.line_requests(spark, sf_dir).select("session", "ordinal", "input", F.when(F.col("ordinal") % 5 > 0, F.col("output") % 4).alias("response"))
    return accounting.first_of_each(rows, ["session", "response"])


@register(
    f"""WITH {REQUESTS}, v AS (SELECT *, CASE WHEN reasoning > 3 THEN 'high' WHEN reasoning > 1 THEN 'low' END AS variant FROM requests)
  SELECT model, variant, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CASE WHEN variant IS NULL THEN model ELSE model || ' (' || variant || ')' END AS identity FROM v GROUP BY model, variant"""
)
def model_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.when(F.col("reasoning") > 3, "high").when(F.col("reasoning") > 1, "low")
    return accounting.model_split(tables.line_requests(spark, sf_dir).withColumn("variant", variant), [])


@register(
    f"""WITH {REQUESTS}, r AS (SELECT session, CASE WHEN reasoning > 0 THEN model END AS model FROM requests) SELECT session, count(*) AS observed, count(model) AS attributed, count(*) - count(model) AS unattributed FROM r GROUP BY session"""
)
def attribution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.line_requests(spark, sf_dir).withColumn("model", F.when(F.col("reasoning") > 0, F.col("model")))
    return accounting.attribution_coverage(rows, ["session"])


@register(
    """WITH x AS (SELECT l_orderkey AS session, unnest(['service_tier', 'speed', 'geo']) AS dimension, unnest([l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN 'fast' END, CAST(l_suppkey % 3 AS VARCHAR)]) AS value FROM lineitem)
  SELECT session, dimension, value, count(*) AS requests FROM x WHERE value IS NOT NULL GROUP BY ALL"""
)
def dimension_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), F.col("l_returnflag").alias("service_tier"), F.when(F.col("l_linenumber") % 2 == 0, "fast").alias("speed"), (F.col("l_suppkey") % 3).alias("geo")
    )
    return accounting.dimension_tally(rows, ["session"], ["service_tier", "speed", "geo"])


@register(
    """WITH p AS (SELECT conv_id % 4 AS h, CASE WHEN contains(text, '```') THEN 'code' WHEN contains(text, '?') THEN 'question' ELSE 'text' END AS carrier, CASE WHEN text IS NULL THEN 'absent' WHEN length(text) > 200 THEN 'reference-only' ELSE 'inline' END AS availability,
  strlen(text) AS bytes, CASE WHEN contains(text, '/') THEN 1 END AS artifact FROM conversations)
  SELECT h, carrier, availability, count(*) AS parts, CAST(sum(bytes) AS BIGINT) AS bytes, count(artifact) AS artifacts FROM p GROUP BY ALL"""
)
def content_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    parts = tables.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 4).alias("h"), F.when(text.contains("```"), "code").when(text.contains("?"), "question").otherwise("text").alias("carrier"),
        F.when(text.isNull(), "absent").when(F.length(text) > 200, "reference-only").otherwise("inline").alias("availability"), F.octet_length(text).cast("long").alias("bytes"), F.when(text.contains("/"), 1).alias("artifact"),
    )
    return accounting.content_inventory(parts, ["h"])


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, pr AS (SELECT parent, session AS fork FROM sessions WHERE parent IS NOT NULL), ev AS (SELECT session, ordinal AS entry, input // 5 AS digest, CASE WHEN reasoning <> 6 THEN input // 5 END AS v FROM requests),
  a AS (SELECT parent, fork, entry, digest AS d1, v AS v1, 1 AS i1 FROM pr JOIN ev ON parent = session), b AS (SELECT parent, fork, entry, digest AS d2, v AS v2, 1 AS i2 FROM pr JOIN ev ON fork = session),
  j AS (SELECT *, coalesce(v1, v2) AS v FROM a FULL JOIN b USING (parent, fork, entry)),
  g AS (SELECT parent, fork, count(*) AS "distinct", count(*) FILTER (WHERE i1 = 1 AND i2 = 1 AND d1 = d2) AS copies, count(*) FILTER (WHERE i1 = 1 AND i2 = 1 AND d1 <> d2) AS conflicts, count(*) FILTER (WHERE v IS NULL) AS unknown, sum(v) AS s,
    greatest(sum(v1), sum(v2)) AS at_least, CASE WHEN count(*) FILTER (WHERE (i1 = 1 AND v1 IS NULL) OR (i2 = 1 AND v2 IS NULL)) = 0 THEN coalesce(sum(v1), 0) + coalesce(sum(v2), 0) END AS at_most FROM j GROUP BY parent, fork)
  SELECT parent, fork, "distinct", copies, CASE WHEN conflicts = 0 AND unknown = 0 THEN CAST(s AS BIGINT) END AS total, CASE WHEN conflicts > 0 THEN 'copy-differs' WHEN unknown > 0 THEN 'missing-counter' END AS reason, CAST(at_least AS BIGINT) AS at_least, CAST(at_most AS BIGINT) AS at_most FROM g"""
)
def exact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order before as the parent; lines of one number are the same entry."""
    pair = tables.order_sessions(spark, sf_dir).filter("parent IS NOT NULL").select("parent", F.col("session").alias("fork"))
    fifth = F.floor(F.col("input") / 5)
    events = tables.line_requests(spark, sf_dir).select("session", F.col("ordinal").alias("entry"), fifth.alias("digest"), F.when(F.col("reasoning") != 6, fifth).alias("input"))
    return accounting.exact_union(pair, events)


@register(
    f"""WITH {TURNS}, m AS (SELECT session, pool, ordinal, CAST(sum(CASE WHEN name = 'tool2' AND ordinal % 11 = 0 THEN -400 ELSE CAST(floor(value) AS BIGINT) END) OVER (PARTITION BY session, pool ORDER BY ordinal) AS BIGINT) AS recorded, CAST(floor(value) AS BIGINT) % 60 AS explained FROM turns),
  f AS (SELECT *, coalesce((recorded < lag(recorded) OVER (PARTITION BY session, pool ORDER BY ordinal))::INT, 0) AS fell FROM m), r AS (SELECT *, sum(fell) OVER (PARTITION BY session, pool ORDER BY ordinal) AS run FROM f),
  k AS (SELECT *, sum(explained) OVER w AS held, sum(explained) OVER (PARTITION BY session, pool) AS alle, last_value(recorded) OVER (PARTITION BY session, pool ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest
    FROM (SELECT *, max(run) OVER (PARTITION BY session, pool) AS l FROM r) WHERE run = l WINDOW w AS (PARTITION BY session, pool ORDER BY ordinal)),
  p AS (SELECT session, pool, ordinal, least(greatest(0, newest - alle), greatest(0, max(recorded - held) OVER (PARTITION BY session, pool ORDER BY ordinal))) AS placed FROM k)
  SELECT session, pool, ordinal, CAST(placed - coalesce(lag(placed) OVER (PARTITION BY session, pool ORDER BY ordinal), 0) AS BIGINT) AS part FROM p"""
)
def unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of a user's events by type as totals, which sometimes fall."""
    seen = F.floor("value")
    step = F.when((F.col("name") == "tool2") & (F.col("ordinal") % 11 == 0), -400).otherwise(seen)
    by = Window.partitionBy("session", "pool").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    marks = tables.event_turns(spark, sf_dir).select("session", "pool", "ordinal", F.sum(step).over(by).alias("recorded"), (seen % 60).alias("explained"))
    return accounting.unexplained(marks, ["session", "pool"])


@register(
    f"""WITH RECURSIVE {REQUESTS}, {SESSIONS}, fam(session, family) AS (SELECT session, session FROM sessions WHERE parent IS NULL UNION ALL SELECT s.session, fam.family FROM sessions s JOIN fam ON s.parent = fam.session),
  q AS (SELECT family, r.session, r.ordinal, moment, r.input, r.output, s.harness || ':' || model || CASE WHEN reasoning > 3 THEN '#high' ELSE '' END AS agent, CASE WHEN s.parent IS NULL THEN 'root' WHEN s.launch = 'headless' THEN 'subagent' ELSE 'delegate' END AS role,
    CASE WHEN r.ordinal <> 4 THEN r.output END AS id FROM requests r JOIN sessions s USING (session) JOIN fam USING (session)),
  n AS (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY family, id ORDER BY moment NULLS LAST, session, ordinal) END AS n FROM q)
  SELECT family, agent, role, count(DISTINCT session) AS sessions, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM n WHERE n = 1 GROUP BY family, agent, role"""
)
def family_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are one family; request ids are the lines' outputs, some without."""
    sessions = tables.order_sessions(spark, sf_dir)
    role = F.when(F.col("parent").isNull(), "root").when(F.col("launch") == "headless", "subagent").otherwise("delegate")
    members = lineage.root_of(sessions.select("session", "parent")).join(sessions.select("session", role.alias("role")), "session").select("session", F.col("root").alias("family"), "role")
    requests = tables.line_requests(spark, sf_dir).join(sessions.select("session", "harness"), "session").withColumns({"variant": F.when(F.col("reasoning") > 3, "high"), "id": F.when(F.col("ordinal") != 4, F.col("output"))})
    return accounting.family_totals(members, requests)


@register(
    f"""WITH {PAIRS}, k AS (SELECT harness, count(DISTINCT session) AS sessions, count(*) AS turns, count(*) FILTER (WHERE kind = 'operator') AS n_operator, count(*) FILTER (WHERE kind = 'assistant') AS n_assistant, count(*) FILTER (WHERE kind = 'tool') AS n_tool, count(*) FILTER (WHERE kind = 'notice') AS n_notice, count(*) FILTER (WHERE kind = 'unknown') AS n_unknown FROM turns GROUP BY harness),
  t AS (SELECT harness, count(*) FILTER (WHERE direction = 'call') AS calls, count(*) FILTER (WHERE direction = 'call' AND pair IS NOT NULL) AS paired, count(*) FILTER (WHERE CASE direction WHEN 'call' THEN coalesce(status, '') = 'error' AND pair IS NULL ELSE coalesce(status, '') = 'error' OR coalesce(pair_status, '') = 'error' END) AS errors FROM pairs GROUP BY harness)
  SELECT * FROM k LEFT JOIN t USING (harness)"""
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.stats_summary(tables.event_turns(spark, sf_dir), paired(spark, sf_dir))


@register(f"WITH {PAIRS} SELECT harness, session, count(*) AS calls FROM pairs WHERE direction = 'call' GROUP BY harness, session")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.call_counts(paired(spark, sf_dir))
