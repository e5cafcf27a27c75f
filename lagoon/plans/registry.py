"""Registered queries over the test tables and their SQL twins.

Each query applies operators to the tables' adapters; its twin is written for DuckDB on the same
tables, on its own, so that the two check each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.operators import attribution, endings, evidence, lineage, listing, pairing, pricing, shares, spans, turns, usage
from lagoon.sources import tables
from lagoon.storage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HARNESS = "CASE CAST({} % 4 AS INT) WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'pi' ELSE 'opencode' END"
TALK = f"""talk AS (SELECT {HARNESS.format('conv_id')} AS harness, conv_id AS session, CAST(turn AS BIGINT) AS ordinal, role,
  CASE role WHEN 'user' THEN 'operator' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'control' ELSE 'unknown' END AS kind, text FROM conversations)"""
TURNS = """turns AS (SELECT 'claude' AS harness, user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal, ts,
  CASE event_type WHEN 'signup' THEN 'operator' WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'notice' ELSE 'unknown' END AS kind,
  CASE event_type WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'result' END AS direction,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS call_id, CASE WHEN event_type <> 'purchase' OR CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 THEN 'tool' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) END AS name,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0 THEN 'error' END AS status, value, event_type AS pool, event_id FROM events)"""
REQUESTS = """requests AS (SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
  l_shipdate AS moment, l_returnflag || l_linestatus AS model, CAST(l_quantity AS BIGINT) AS input, l_partkey % 1000 AS output, (l_partkey % 1000) % 7 AS reasoning, l_suppkey % 100 AS cache_read,
  CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber AS BIGINT) * 10 END AS cache_write FROM lineitem)"""
SESSIONS = f"""sessions AS (SELECT {HARNESS.format('o_custkey')} AS harness, o_orderkey AS session, o_orderpriority AS directory,
  CASE o_orderstatus WHEN 'F' THEN 'headless' WHEN 'O' THEN 'interactive' END AS launch, o_orderdate AS last_activity,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders)"""
USED = """used AS (SELECT session, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, count(*) AS requests FROM requests GROUP BY session)"""
#: Stretches and active time use 8 hours, which splits about half of the events' gaps.
IDLE_MS = 8 * 3_600_000
GAPS = f"""gaps AS (SELECT *, epoch_us(ts) AS us, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY harness, session ORDER BY ordinal)) / 1000) AS BIGINT) AS gap FROM turns)"""


def register(sql: str | None = None) -> Callable:
    """Add a query under its function's name, with its SQL twin where there is one."""

    def add(query: Callable) -> Callable:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE[query.__name__] = sql
        return query

    return add


def used_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with what they used; those without requests keep nulls."""
    return tables.order_sessions(spark, sf_dir).join(usage.session_usage(tables.line_requests(spark, sf_dir)), "session", "left")


@register(
    f"""WITH {REQUESTS}, {SESSIONS} SELECT harness, model, count(*) AS requests, count(DISTINCT session) AS sessions,
  CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write) AS BIGINT) AS cache_write, count(cache_write) AS cache_write_requests
  FROM requests JOIN sessions USING (session) GROUP BY ALL"""
)
def usage_by_harness_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables.order_sessions(spark, sf_dir).select("session", "harness")
    return tables.line_requests(spark, sf_dir).join(sessions, "session").groupBy("harness", "model").agg(
        F.count("*").alias("requests"), F.count_distinct("session").alias("sessions"), F.sum("input").alias("input"), F.sum("output").alias("output"),
        F.sum("cache_write").alias("cache_write"), F.count("cache_write").alias("cache_write_requests"),
    )


@register(
    f"""WITH {SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY harness ORDER BY last_activity DESC NULLS LAST, session, harness) AS rank FROM sessions)
  SELECT harness, session, directory, last_activity, rank FROM r WHERE rank <= 20"""
)
def list_newest_per_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.newest_per_harness(tables.order_sessions(spark, sf_dir), 20).select("harness", "session", "directory", "last_activity", "rank")


@register(
    f"""WITH {SESSIONS} SELECT harness, session, directory, launch, last_activity FROM sessions
  WHERE starts_with(CAST(session AS VARCHAR), '1') AND launch = 'headless' AND contains(lower(directory), 'urgent') AND last_activity >= TIMESTAMP '1993-01-01' AND last_activity < TIMESTAMP '1997-01-01'"""
)
def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.matching(tables.order_sessions(spark, sf_dir), prefix="1", launch="headless", directory="Urgent", since="1993-01-01", until="1997-01-01")
    return found.drop("parent")


@register(
    f"""WITH {SESSIONS}, x AS (SELECT session FROM sessions WHERE session % 3 = 0)
  SELECT harness, session, last_activity FROM sessions WHERE session NOT IN (SELECT session FROM x) ORDER BY last_activity DESC NULLS LAST, session, harness LIMIT 1"""
)
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables.order_sessions(spark, sf_dir)
    return listing.latest(sessions, sessions.filter("session % 3 = 0").select("harness", "session")).select("harness", "session", "last_activity")


@register(
    f"""WITH {SESSIONS}, stores AS (SELECT *, 1 AS store_rank FROM sessions WHERE session % 2 = 0 UNION ALL SELECT harness, session, 'late', launch, last_activity, parent, 2 FROM sessions),
  n AS (SELECT *, row_number() OVER (PARTITION BY harness, session ORDER BY store_rank) AS k FROM stores) SELECT harness, session, directory, store_rank FROM n WHERE k = 1"""
)
def store_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables.order_sessions(spark, sf_dir)
    stores = sessions.filter("session % 2 = 0").withColumn("store_rank", F.lit(1)).unionByName(sessions.withColumns({"directory": F.lit("late"), "store_rank": F.lit(2)}))
    return listing.first_store_wins(stores).select("harness", "session", "directory", "store_rank")


@register(
    f"""WITH {SESSIONS}, m AS (SELECT *, CASE WHEN CAST(session AS VARCHAR) = '12' THEN 0 WHEN starts_with(CAST(session AS VARCHAR), '12') THEN 1 END AS c FROM sessions),
  f AS (SELECT * FROM m WHERE c = (SELECT min(c) FROM m)) SELECT harness, session, (SELECT count(*) FROM f) AS matches FROM f"""
)
def resolve_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.resolve(tables.order_sessions(spark, sf_dir), "12").select("harness", "session", "matches")


@register(
    f"""WITH {TALK}, b AS (SELECT *, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY harness, session ORDER BY ordinal DESC) AS upto FROM talk), w AS (SELECT DISTINCT harness, session FROM b WHERE upto > 900),
  r AS (SELECT *, row_number() OVER (PARTITION BY harness, session ORDER BY ordinal DESC) AS n FROM b WHERE upto <= 900)
  SELECT r.harness, r.session, coalesce(bool_or(contains(lower(text), 'the')) FILTER (WHERE n <= 3), false) AS hit, count(*) FILTER (WHERE n <= 3) AS searched, count(*) < 3 AND bool_or(w.session IS NOT NULL) AS partial
  FROM r LEFT JOIN w ON r.harness = w.harness AND r.session = w.session GROUP BY r.harness, r.session"""
)
def search_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the last 900 bytes of each conversation: a miss is partial where fewer turns than asked for were read."""
    read, withheld = listing.tail_read(tables.conversation_turns(spark, sf_dir), 900)
    return listing.search_tail(read, "The", tail=3, withheld=withheld)


@register(
    f"""WITH {TALK}, b AS (SELECT *, CAST(sum(strlen(coalesce(text, ''))) OVER (PARTITION BY harness, session ORDER BY ordinal DESC) AS BIGINT) AS upto FROM talk)
  SELECT harness, session, count(*) FILTER (WHERE upto <= 500) AS turns, count(*) FILTER (WHERE upto > 500) > 0 AS withheld FROM b GROUP BY harness, session HAVING count(*) FILTER (WHERE upto <= 500) > 0"""
)
def tail_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, withheld = listing.tail_read(tables.conversation_turns(spark, sf_dir), 500)
    cut = withheld.withColumn("withheld", F.lit(True))
    return read.groupBy("harness", "session").agg(F.count("*").alias("turns")).join(cut, ["harness", "session"], "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))


@register(
    f"""WITH {TALK}, h AS (SELECT harness, session, ordinal, role, row_number() OVER (PARTITION BY harness, session ORDER BY ordinal) AS hit, count(*) OVER (PARTITION BY harness, session) AS n
  FROM talk WHERE contains(lower(text), 'the')) SELECT harness, session, ordinal, role, hit, n > 2 AS truncated FROM h WHERE hit <= 2"""
)
def search_full_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.search_whole(tables.conversation_turns(spark, sf_dir), "the", cap=2)


@register(f"WITH {TURNS} SELECT harness, session, ordinal, kind, ts FROM turns")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.timeline(tables.event_turns(spark, sf_dir))


@register(
    f"WITH {TURNS} SELECT harness, session, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in turns.KINDS)
    + ", count(*) AS total FROM turns GROUP BY harness, session"
)
def turns_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.count_kinds(tables.event_turns(spark, sf_dir))


@register(f"WITH {TURNS} SELECT harness, session, kind, count(*) AS omitted FROM turns WHERE kind NOT IN ('operator', 'assistant') GROUP BY ALL")
def kind_projection_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.select_kinds(tables.event_turns(spark, sf_dir), ("operator", "assistant"))[1]


@register(f"WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal DESC) AS n FROM turns) SELECT harness, session, ordinal, kind FROM r WHERE n <= 5")
def tail_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.tail(tables.event_turns(spark, sf_dir), 5).select("harness", "session", "ordinal", "kind")


@register(f"WITH {TALK} SELECT harness, session, ordinal, substring(text, 1, 40) AS text, length(text) AS text_chars, length(text) > 40 AS text_truncated FROM talk")
def text_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.capped(tables.conversation_turns(spark, sf_dir), 40).select("harness", "session", "ordinal", "text", "text_chars", "text_truncated")


@register(
    f"""WITH {TALK}, t AS (SELECT harness, session, ordinal, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM talk WHERE kind = 'operator')
  SELECT harness, session, arg_min(CASE WHEN length(flat) > 40 THEN substring(flat, 1, 39) || '…' ELSE flat END, ordinal) AS title FROM t WHERE length(flat) > 0 GROUP BY ALL"""
)
def derive_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.titles(tables.conversation_turns(spark, sf_dir), 40)


@register(
    f"""WITH {TURNS}, {GAPS}, s AS (SELECT *, sum(CASE WHEN gap > {IDLE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY harness, session ORDER BY ordinal) AS stretch FROM gaps)
  SELECT harness, session, CAST(stretch AS BIGINT) AS stretch, min(ts) AS first, max(ts) AS last, count(*) AS turns FROM s GROUP BY ALL"""
)
def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.stretches(tables.event_turns(spark, sf_dir), IDLE_MS)


@register(
    f"""WITH {TURNS}, {GAPS} SELECT harness, session, CASE WHEN count(*) >= 2 THEN coalesce(CAST(sum(gap) FILTER (WHERE gap BETWEEN 0 AND {IDLE_MS}) AS BIGINT), 0) END AS active_ms,
  max(gap) FILTER (WHERE gap >= 0) AS max_gap_ms, CASE WHEN count(*) >= 2 THEN CAST(floor((arg_max(us, ordinal) - arg_min(us, ordinal)) / 1000) AS BIGINT) END AS span_ms FROM gaps GROUP BY ALL"""
)
def active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.active_time(tables.event_turns(spark, sf_dir), IDLE_MS)


@register(
    f"""WITH {TURNS}, {GAPS}, d AS (SELECT harness, session, gap, row_number() OVER (PARTITION BY harness, session ORDER BY gap) AS k, count(*) OVER (PARTITION BY harness, session) AS n FROM gaps WHERE kind = 'assistant' AND gap >= 0)
  SELECT harness, session, max(n) AS n, min(gap) FILTER (WHERE k * 100 >= n * 50) AS p50, min(gap) FILTER (WHERE k * 100 >= n * 90) AS p90, max(gap) AS max FROM d GROUP BY harness, session"""
)
def response_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.nearest_ranks(turns.response_times(tables.event_turns(spark, sf_dir)), ["harness", "session"], "duration_ms")


@register(
    f"""WITH {REQUESTS}, c AS (SELECT *, CASE WHEN lag(model) OVER w IS NOT DISTINCT FROM model OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS new FROM requests WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ordinal) AS span FROM c) SELECT session, CAST(span AS BIGINT) AS span, arg_min(model, ordinal) AS model, min(ordinal) AS first, max(ordinal) AS last, count(*) AS size FROM s GROUP BY session, span"""
)
def model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.islands(tables.line_requests(spark, sf_dir), ["session"], "model")


@register(
    f"""WITH {SESSIONS}, p AS (SELECT o_custkey AS customer, o_orderpriority AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders),
  c AS (SELECT *, lag(place) OVER (PARTITION BY customer ORDER BY ordinal) AS b FROM p) SELECT customer, ordinal, place FROM c WHERE ordinal = 1 OR b IS DISTINCT FROM place"""
)
def location_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    placed = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.row_number().over(by).cast("long").alias("ordinal"), F.col("o_orderpriority").alias("place"))
    return turns.changes(placed, ["customer"], "place")


#: The pairing by running sums in SQL: the open-call depth and its running minimum give orphans and levels.
PAIRS = f"""{TURNS}, ev AS (SELECT * FROM turns WHERE direction IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN direction = 'call' THEN 1 ELSE -1 END) OVER (PARTITION BY session, call_id ORDER BY ordinal) AS s FROM ev),
  m AS (SELECT *, least(0, min(s) OVER (PARTITION BY session, call_id ORDER BY ordinal)) AS m FROM s),
  o AS (SELECT *, direction = 'result' AND m < coalesce(lag(m) OVER (PARTITION BY session, call_id ORDER BY ordinal), 0) AS orphan FROM m),
  l AS (SELECT *, CASE WHEN orphan THEN -1 ELSE s - m + CASE WHEN direction = 'result' THEN 1 ELSE 0 END END AS level FROM o),
  p AS (SELECT *, CASE WHEN orphan THEN NULL WHEN direction = 'call' AND lead(direction) OVER w = 'result' THEN lead(ordinal) OVER w WHEN direction = 'result' AND lag(direction) OVER w = 'call' THEN lag(ordinal) OVER w END AS pair,
    CASE WHEN NOT orphan THEN CASE WHEN direction = 'call' AND lead(direction) OVER w = 'result' THEN lead(name) OVER w WHEN direction = 'result' AND lag(direction) OVER w = 'call' THEN lag(name) OVER w END END AS pair_name,
    CASE WHEN NOT orphan THEN CASE WHEN direction = 'call' AND lead(direction) OVER w = 'result' THEN lead(status) OVER w WHEN direction = 'result' AND lag(direction) OVER w = 'call' THEN lag(status) OVER w END END AS pair_status,
    CASE WHEN NOT orphan AND direction = 'call' AND lead(direction) OVER w = 'result' THEN CAST(floor((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000) AS BIGINT) END AS duration_ms
    FROM l WINDOW w AS (PARTITION BY session, call_id, level ORDER BY ordinal)),
  pairs AS (SELECT harness, session, ordinal, call_id, name, status, direction, pair, pair_name, pair_status, duration_ms, CASE WHEN pair IS NOT NULL THEN NULL WHEN direction = 'call' THEN 'no-result-in-read' ELSE 'call-not-recorded' END AS incomplete FROM p)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.event_turns(spark, sf_dir).filter("direction IS NOT NULL")
    return pairing.pair_events(events).select("harness", "session", "ordinal", "call_id", "name", "status", "direction", "pair", "pair_name", "pair_status", "duration_ms", "incomplete")


@register(f"WITH {PAIRS} SELECT * FROM pairs")
def pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir)


@register(f"WITH {PAIRS} SELECT session, incomplete, count(*) AS events FROM pairs WHERE incomplete IS NOT NULL GROUP BY ALL")
def incomplete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).filter("incomplete IS NOT NULL").groupBy("session", "incomplete").agg(F.count("*").alias("events"))


@register(
    f"""WITH {PAIRS}, n AS (SELECT *, CASE direction WHEN 'call' THEN name ELSE coalesce(name, pair_name) END AS tool,
  CASE direction WHEN 'call' THEN coalesce(status, '') = 'error' AND pair IS NULL ELSE coalesce(status, '') = 'error' OR coalesce(pair_status, '') = 'error' END AS error FROM pairs)
  SELECT tool, count(*) FILTER (WHERE direction = 'call') AS calls, count(*) FILTER (WHERE direction = 'result') AS results, count(*) FILTER (WHERE direction = 'call' AND pair IS NOT NULL) AS paired, count(*) FILTER (WHERE error) AS errors,
  count(*) FILTER (WHERE incomplete = 'no-result-in-read') AS no_result_in_read, count(*) FILTER (WHERE incomplete = 'call-before-read-bound') AS call_before_read_bound, count(*) FILTER (WHERE incomplete = 'call-not-recorded') AS call_not_recorded,
  CAST(sum(duration_ms) AS BIGINT) AS duration_ms, max(duration_ms) AS longest_ms, count(duration_ms) AS timed FROM n GROUP BY tool"""
)
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.tool_stats(paired(spark, sf_dir))


@register(
    f"""WITH {PAIRS}, c AS (SELECT * FROM pairs WHERE name = 'tool1'), w AS (SELECT session, ordinal FROM c UNION SELECT session, pair FROM c WHERE pair IS NOT NULL)
  SELECT session, ordinal, name, direction FROM pairs WHERE (session, ordinal) IN (SELECT session, ordinal FROM w)"""
)
def events_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.filter_events(paired(spark, sf_dir), ("tool1",)).select("session", "ordinal", "name", "direction")


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, {USED}, j AS (SELECT s.harness, s.launch, u.* FROM sessions s LEFT JOIN used u USING (session))
  SELECT harness, launch, count(*) AS sessions, """
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}, count({c}) AS {c}_sessions" for c in usage.COUNTERS)
    + " FROM j GROUP BY harness, launch"
)
def usage_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_by(used_sessions(spark, sf_dir), ["harness", "launch"])


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, {USED}, j AS (SELECT s.launch, u.* FROM sessions s LEFT JOIN used u USING (session))
  SELECT launch, GROUPING(launch) > 0 AS is_total, count(*) AS sessions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM j GROUP BY GROUPING SETS ((launch), ())"""
)
def usage_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_with_total(used_sessions(spark, sf_dir), ["launch"])


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, {USED}, j AS (SELECT s.harness, (input IS NOT NULL)::INT + (output IS NOT NULL)::INT + (reasoning IS NOT NULL)::INT + (cache_read IS NOT NULL)::INT + (cache_write IS NOT NULL)::INT AS have FROM sessions s LEFT JOIN used u USING (session))
  SELECT harness, count(*) FILTER (WHERE have = 5) AS complete, count(*) FILTER (WHERE have BETWEEN 1 AND 4) AS partial, count(*) FILTER (WHERE have = 0) AS absent FROM j GROUP BY harness"""
)
def usage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.coverage(used_sessions(spark, sf_dir), ["harness"])


DISJOINT = f"""{REQUESTS}, {SESSIONS}, d AS (SELECT r.*, s.harness,
  CASE WHEN harness = 'codex' THEN CASE WHEN cache_write = 0 AND input >= cache_read THEN input - cache_read END ELSE input END AS d_uncached,
  CASE WHEN harness = 'opencode' THEN output + reasoning ELSE output END AS d_output FROM requests r JOIN sessions s USING (session)),
  e AS (SELECT *, CASE WHEN reasoning <= d_output THEN reasoning END AS d_reasoning, d_uncached + cache_read + cache_write + d_output AS d_total FROM d)"""


@register(
    f"""WITH {DISJOINT} SELECT harness, count(*) AS requests, CAST(sum(d_uncached) AS BIGINT) AS d_uncached, CAST(sum(d_output) AS BIGINT) AS d_output, CAST(sum(d_reasoning) AS BIGINT) AS d_reasoning,
  CAST(sum(cache_read) AS BIGINT) AS d_cache_read, CAST(sum(cache_write) AS BIGINT) AS d_cache_write, CASE WHEN bool_and(d_total IS NOT NULL) THEN CAST(sum(d_total) AS BIGINT) END AS d_total FROM e GROUP BY harness"""
)
def disjoint_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.line_requests(spark, sf_dir).join(tables.order_sessions(spark, sf_dir).select("session", "harness"), "session")
    return usage.disjoint_sums(usage.disjoint(requests), ["harness"])


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, {USED}, j AS (SELECT s.directory, s.launch, s.harness, u.input FROM sessions s LEFT JOIN used u USING (session) WHERE s.launch IS NULL OR s.harness = 'pi')
  SELECT directory, launch, count(*) AS sessions, count(DISTINCT harness) > 1 AS mixed, CASE WHEN count(DISTINCT harness) <= 1 THEN CAST(sum(input) AS BIGINT) END AS input FROM j GROUP BY directory, launch"""
)
def mixed_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.withheld(used_sessions(spark, sf_dir).filter("launch IS NULL OR harness = 'pi'"), ["directory", "launch"])


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, {USED}, u AS (SELECT s.harness, coalesce(s.parent, s.session) AS unit, max(input) AS m, sum(input) AS t, bool_and(input IS NOT NULL) AS a FROM sessions s LEFT JOIN used USING (session) GROUP BY 1, 2)
  SELECT harness, CAST(sum(m) AS BIGINT) AS at_least, CASE WHEN bool_and(a) THEN CAST(sum(t) AS BIGINT) END AS at_most FROM u GROUP BY harness"""
)
def identity_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = used_sessions(spark, sf_dir).withColumn("unit", F.coalesce("parent", "session"))
    return usage.identity_bounds(used, "unit", ["harness"])


@register(
    f"""WITH RECURSIVE {REQUESTS}, r AS (SELECT session, ordinal % 3 AS request, input, output, reasoning, cache_read, cache_write, row_number() OVER (PARTITION BY session, ordinal % 3 ORDER BY ordinal) AS n FROM requests),
  f AS (SELECT * FROM r WHERE n = 1 UNION ALL SELECT x.session, x.request, CASE WHEN d THEN x.input ELSE h.input END, CASE WHEN d THEN x.output ELSE h.output END, CASE WHEN d THEN x.reasoning ELSE h.reasoning END,
    CASE WHEN d THEN x.cache_read ELSE h.cache_read END, CASE WHEN d THEN x.cache_write ELSE h.cache_write END, x.n FROM f h JOIN r x ON h.session = x.session AND h.request = x.request AND x.n = h.n + 1,
    LATERAL (SELECT """
    + " AND ".join(f"(h.{c} IS NULL OR coalesce(x.{c} >= h.{c}, false))" for c in usage.COUNTERS)
    + """ AS d))
  SELECT session, request, n AS records, input, output, reasoning, cache_read, cache_write FROM f QUALIFY row_number() OVER (PARTITION BY session, request ORDER BY n DESC) = 1"""
)
def request_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tables.line_requests(spark, sf_dir).withColumn("request", F.col("ordinal") % 3)
    return usage.fold_requests(records, ["session", "request"])


#: Running totals of a user's events: two counters, one of them not always recorded; errors speak of quota alone.
TOTALS = f"""{TURNS}, totals AS (SELECT session, ordinal, CASE WHEN kind <> 'notice' THEN CAST(floor(value) AS BIGINT) END AS ti, CASE WHEN kind NOT IN ('notice', 'operator') THEN CAST(floor(value) AS BIGINT) % 50 END AS tu,
  CASE WHEN direction IS NULL THEN CASE WHEN kind <> 'notice' THEN CAST(floor(value) AS BIGINT) END END AS li, CASE WHEN direction IS NULL AND kind NOT IN ('notice', 'operator') THEN CAST(floor(value) AS BIGINT) % 50 END AS lu FROM turns),
  a AS (SELECT *, ti IS NOT NULL OR tu IS NOT NULL AS has FROM totals), b AS (SELECT *, row_number() OVER w AS n, lag(ti) OVER w AS pi, lag(tu) OVER w AS pu FROM a WINDOW w AS (PARTITION BY session, has ORDER BY ordinal)),
  classified AS (SELECT session, ordinal, ti, tu, li, lu, CASE WHEN NOT has THEN 'quota-only' WHEN n = 1 THEN CASE WHEN (li IS NOT NULL OR lu IS NOT NULL) AND ti IS NOT DISTINCT FROM li AND tu IS NOT DISTINCT FROM lu THEN 'advance' ELSE 'leading-uncounted' END
    WHEN ti - pi IS NULL AND tu - pu IS NULL THEN 'incomplete' WHEN coalesce(ti < pi, false) OR coalesce(tu < pu, false) THEN 'reset-advance' WHEN coalesce(ti > pi, false) OR coalesce(tu > pu, false) THEN 'advance' ELSE 'unchanged-total' END AS classification FROM b)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, kind = F.floor("value"), F.col("kind")
    total = {"total_input": F.when(kind != "notice", seen), "total_output": F.when(~kind.isin("notice", "operator"), seen % 50)}
    rows = tables.event_turns(spark, sf_dir).withColumns(total).withColumns({c.replace("total", "last"): F.when(F.col("direction").isNull(), F.col(c)) for c in total})
    return usage.classify_totals(rows.select("session", "ordinal", *total, "last_input", "last_output"), ["session"], ("input", "output"))


@register(
    f"""WITH {TOTALS} SELECT session, ordinal, classification, classification IN ('advance', 'reset-advance') AND (li IS NOT NULL OR lu IS NOT NULL) AS counted,
  CAST(count(*) FILTER (WHERE classification = 'reset-advance') OVER (PARTITION BY session ORDER BY ordinal) AS BIGINT) AS epoch FROM classified"""
)
def classified_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("session", "ordinal", "classification", "counted", "epoch")


@register(
    f"""WITH {TOTALS}, c AS (SELECT *, classification IN ('advance', 'reset-advance') AND (li IS NOT NULL OR lu IS NOT NULL) AS counted FROM classified)
  SELECT session, arg_max(ti, ordinal) FILTER (WHERE classification <> 'quota-only' AND ti IS NOT NULL AND ordinal = lasto) AS input, arg_max(tu, ordinal) FILTER (WHERE classification <> 'quota-only' AND tu IS NOT NULL AND ordinal = lasto) AS output, count(*) FILTER (WHERE counted) AS requests,
  CAST(sum(li) FILTER (WHERE counted) AS BIGINT) AS requests_input, CAST(sum(lu) FILTER (WHERE counted) AS BIGINT) AS requests_output, count(*) FILTER (WHERE classification = 'leading-uncounted') AS leading_uncounted,
  count(*) FILTER (WHERE classification = 'reset-advance') AS reset_advance, count(*) FILTER (WHERE classification = 'unchanged-total') AS unchanged_total, count(*) FILTER (WHERE classification = 'incomplete') AS incomplete, count(*) FILTER (WHERE classification = 'quota-only') AS quota_only,
  CASE WHEN bool_or(classification = 'reset-advance') THEN 'since-reset' ELSE 'session' END AS coverage
  FROM (SELECT *, max(ordinal) FILTER (WHERE classification <> 'quota-only') OVER (PARTITION BY session) AS lasto FROM c) GROUP BY session"""
)
def totals_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals_accounting(classified(spark, sf_dir), ["session"], ("input", "output"))


@register(
    f"""WITH {TURNS}, t AS (SELECT session, ordinal, CASE WHEN kind = 'operator' THEN 'tool' || name END AS chosen FROM turns)
  SELECT session, ordinal, last_value(chosen IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM t"""
)
def model_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tables.event_turns(spark, sf_dir).withColumn("chosen", F.when(F.col("kind") == "operator", F.concat(F.lit("tool"), "name")))
    return chosen.select("session", "ordinal", usage.as_of(chosen, ["session"], "chosen").alias("model"))


@register(
    f"""WITH {REQUESTS}, {USED}, a AS (SELECT session, CASE WHEN cache_write IS NOT NULL THEN input END AS recorded FROM used), b AS (SELECT session, CAST(sum(CASE WHEN cache_write IS NOT NULL OR ordinal > 2 THEN input END) AS BIGINT) AS summed FROM requests GROUP BY session),
  j AS (SELECT session, recorded, summed, recorded - summed AS difference FROM a FULL JOIN b USING (session))
  SELECT *, CASE WHEN difference IS NULL THEN 'unestablished' WHEN difference = 0 THEN 'equal' WHEN difference > 0 THEN 'total-above' ELSE 'requests-above' END AS status FROM j"""
)
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.line_requests(spark, sf_dir)
    recorded = usage.session_usage(requests).withColumn("input", F.when(F.col("cache_write").isNotNull(), F.col("input")))
    told = F.when(F.col("cache_write").isNotNull() | (F.col("ordinal") > 2), F.col("input"))
    return usage.reconcile(recorded, requests.groupBy("session").agg(F.sum(told).alias("input")), ["session"])


SPANS = "spans(span_id, a, b) AS (VALUES (1, TIMESTAMP '1993-01-01', TIMESTAMP '1994-06-01'), (2, TIMESTAMP '1994-01-01', TIMESTAMP '1995-01-01'), (3, NULL, TIMESTAMP '1992-06-01'), (4, TIMESTAMP '1998-01-01', NULL))"


def given_spans(spark: SparkSession) -> DataFrame:
    rows = [(1, "1993-01-01", "1994-06-01"), (2, "1994-01-01", "1995-01-01"), (3, None, "1992-06-01"), (4, "1998-01-01", None)]
    return spark.createDataFrame(rows, "span_id int, f string, t string").select("span_id", F.col("f").cast("timestamp_ntz").alias("from"), F.col("t").cast("timestamp_ntz").alias("to"))


@register(
    f"""WITH {REQUESTS}, {SPANS} SELECT coalesce(span_id, CASE WHEN moment IS NULL THEN -2 ELSE -1 END) AS span_id, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output
  FROM requests LEFT JOIN spans ON (a IS NULL OR moment >= a) AND (b IS NULL OR moment < b) GROUP BY 1"""
)
def span_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_usage(tables.line_requests(spark, sf_dir), given_spans(spark))


@register(
    f"""WITH {REQUESTS}, {SESSIONS} SELECT harness, launch, count(*) AS requests, count(DISTINCT session) AS sessions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output
  FROM requests JOIN sessions USING (session) WHERE moment >= TIMESTAMP '1994-01-01' AND moment < TIMESTAMP '1995-07-01' GROUP BY harness, launch"""
)
def window_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables.order_sessions(spark, sf_dir).select("session", "harness", "launch")
    return spans.window_usage(tables.line_requests(spark, sf_dir), sessions, "1994-01-01", "1995-07-01", ["harness", "launch"])


@register(f"WITH {REQUESTS} SELECT session, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input FROM requests WHERE ordinal BETWEEN 2 AND 4 GROUP BY session")
def request_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.request_range(tables.line_requests(spark, sf_dir), 2, 4).groupBy("session").agg(F.count("*").alias("requests"), F.sum("input").alias("input"))



@register(
    f"""WITH {TURNS}, obs AS (SELECT pool, session, event_id AS ordinal, ts AS observed_at, date_trunc('week', ts) + INTERVAL 7 DAY AS resets_at, value AS percent FROM turns),
  f AS (SELECT *, CASE WHEN resets_at - INTERVAL 7 DAY <= t AND t < resets_at THEN 0 WHEN resets_at <= t AND t < resets_at + INTERVAL 7 DAY THEN 1 END AS follows FROM obs, (SELECT TIMESTAMP '2024-04-03' AS t)),
  h AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY follows, observed_at DESC, resets_at DESC, ordinal DESC) AS n FROM f WHERE follows IS NOT NULL)
  SELECT pool, observed_at, percent, CASE follows WHEN 1 THEN resets_at ELSE resets_at - INTERVAL 7 DAY END AS window_from, CASE follows WHEN 1 THEN resets_at + INTERVAL 7 DAY ELSE resets_at END AS window_to, CASE follows WHEN 1 THEN 'inferred' ELSE 'recorded' END AS boundary FROM h WHERE n = 1"""
)
def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.event_turns(spark, sf_dir).select(
        "pool", F.col("ts").alias("observed_at"), (F.date_trunc("week", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 7 DAY")).alias("resets_at"),
        F.lit(7 * 24 * 60).alias("window_minutes"), F.col("value").alias("percent"), F.col("event_id").alias("ordinal"),
    )
    return spans.quota_window(seen, "2024-04-03").select("pool", "observed_at", "percent", "window_from", "window_to", "boundary")


#: Prices in millionths for a million tokens: (model, aliases, from, until, uncached input, cache read, output, write 5m, write 1h)
PRICES = [
    ("AF", ["A"], "1992-01-01", "1993-06-01", 3, 1, 15, 4, 6),
    ("AF", ["A"], "1993-06-01", None, 2, 1, 10, 3, 5),
    ("NO", None, None, None, 5, None, 25, 6, 10),
    ("RF", None, "1994-01-01", None, 4, 1, 20, 5, None),
]
PRICED = """prices(model, f, u, pi, pc, po, w5, w1) AS (VALUES ('AF', TIMESTAMP '1992-01-01', TIMESTAMP '1993-06-01', 3, 1, 15, 4, 6), ('AF', TIMESTAMP '1993-06-01', NULL, 2, 1, 10, 3, 5),
  ('NO', NULL, NULL, 5, NULL, 25, 6, 10), ('RF', TIMESTAMP '1994-01-01', NULL, 4, 1, 20, 5, NULL)),
  pr AS (SELECT r.*, p.*, CASE WHEN r.model NOT IN (SELECT model FROM prices) THEN 'unlisted-model' WHEN p.model IS NULL THEN 'outside-validity' END AS price_reason
  FROM requests r LEFT JOIN prices p ON r.model = p.model AND (f IS NULL OR f <= moment) AND (u IS NULL OR moment < u))"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "model string, aliases array<string>, f string, u string, p_uncached_input long, p_cache_read long, p_output long, p_write_5m long, p_write_1h long")
    listed = rows.withColumns({"from": F.col("f").cast("timestamp_ntz"), "until": F.col("u").cast("timestamp_ntz")}).drop("f", "u")
    return pricing.price_of(tables.line_requests(spark, sf_dir), listed).withColumn("uncached_input", F.col("input"))


@register(
    f"""WITH {REQUESTS}, {PRICED}, a AS (SELECT r_model AS model, price_reason, input, cache_read, output, pi, pc, po FROM (SELECT *, model AS r_model FROM pr))
  SELECT model, price_reason, count(*) AS requests,
  CAST(sum(CASE WHEN input > 0 THEN coalesce(input * pi, 0) ELSE 0 END + CASE WHEN cache_read > 0 THEN coalesce(cache_read * pc, 0) ELSE 0 END + CASE WHEN output > 0 THEN coalesce(output * po, 0) ELSE 0 END) AS BIGINT) AS amount_micro,
  CAST(sum((input > 0 AND pi IS NULL)::INT + (cache_read > 0 AND pc IS NULL)::INT + (output > 0 AND po IS NULL)::INT) AS BIGINT) AS missing FROM a GROUP BY model, price_reason"""
)
def price_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price_plain(priced(spark, sf_dir)).groupBy("model", "price_reason").agg(F.count("*").alias("requests"), F.sum("amount_micro").alias("amount_micro"), F.sum("missing").cast("long").alias("missing"))


@register(f"WITH {REQUESTS}, {PRICED} SELECT model, price_reason, year(moment) AS year, count(*) AS requests FROM (SELECT * FROM pr) GROUP BY ALL")
def price_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("model", "price_reason", F.year("at").cast("long").alias("year")).agg(F.count("*").alias("requests"))


@register(
    f"""WITH {REQUESTS}, {PRICED}, b AS (SELECT model, CASE WHEN coalesce(cache_write, 0) = 0 THEN 0 WHEN w5 IS NOT NULL AND w1 IS NOT NULL THEN cache_write * least(w5, w1) END AS low,
  CASE WHEN coalesce(cache_write, 0) = 0 THEN 0 WHEN w5 IS NOT NULL AND w1 IS NOT NULL THEN cache_write * greatest(w5, w1) END AS high FROM pr)
  SELECT model, CAST(sum(low) AS BIGINT) AS low, CAST(sum(high) AS BIGINT) AS high, count(*) - count(low) AS unpriced FROM b GROUP BY model"""
)
def price_ttl_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.ttl_bounds(priced(spark, sf_dir)).groupBy("model").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), (F.count("*") - F.count("low")).alias("unpriced"))


@register(
    f"""WITH {REQUESTS}, {PRICED} SELECT model, input + cache_read >= 60 AS is_long, count(*) AS requests, CAST(sum(output * CASE WHEN input + cache_read >= 60 THEN w1 ELSE w5 END) AS BIGINT) AS amount FROM pr GROUP BY 1, 2"""
)
def price_long_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pricing.long_context(priced(spark, sf_dir), F.col("input") + F.col("cache_read"), 60, "p_write_5m", "p_write_1h")
    return rated.groupBy("model", "is_long").agg(F.count("*").alias("requests"), F.sum(F.col("output") * F.col("rate")).alias("amount"))


@register(
    f"""WITH {TURNS}, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS mi, isodow(ts) - 1 AS d FROM turns)
  SELECT kind, (mi >= 1320 AND d IN (0, 1, 2)) OR (mi < 360 AND (d + 6) % 7 IN (0, 1, 2)) AS night, mi >= 540 AND mi < 1020 AS office, (mi >= 480 AND d = 6) OR (mi < 480 AND d = 0) AS from_sunday, count(*) AS turns FROM m GROUP BY ALL"""
)
def time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window past midnight, one on every day, and one whose ends are equal: a whole day from its start."""
    at = F.col("ts")
    dims = [pricing.in_hours(at, 1320, 360, (0, 1, 2)).alias("night"), pricing.in_hours(at, 540, 1020).alias("office"), pricing.in_hours(at, 480, 480, (6,)).alias("from_sunday")]
    return tables.event_turns(spark, sf_dir).groupBy("kind", *dims).agg(F.count("*").alias("turns"))


@register(
    """WITH cur AS (SELECT p_partkey AS model, CAST(p_size AS BIGINT) AS price, TIMESTAMP '2024-01-01' AS "from", CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '2024-02-01' END AS until FROM part WHERE p_partkey % 7 <> 0),
  fet AS (SELECT p_partkey AS model, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS price FROM part WHERE p_partkey % 4 <> 0),
  kept AS (SELECT c.model, c.price, c."from", CASE WHEN c.until IS NULL AND f.model IS NOT NULL AND f.price IS DISTINCT FROM c.price THEN TIMESTAMP '2024-03-01' ELSE c.until END AS until FROM cur c LEFT JOIN fet f USING (model)),
  opened AS (SELECT f.model, f.price, TIMESTAMP '2024-03-01' AS "from", CAST(NULL AS TIMESTAMP) AS until FROM fet f LEFT JOIN (SELECT * FROM cur WHERE until IS NULL) c USING (model) WHERE c.price IS DISTINCT FROM f.price)
  SELECT * FROM kept UNION ALL SELECT * FROM opened"""
)
def scd2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    current = part.filter("p_partkey % 7 <> 0").select(
        F.col("p_partkey").alias("model"), F.col("p_size").cast("long").alias("price"), F.lit("2024-01-01").cast("timestamp_ntz").alias("from"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("2024-02-01").cast("timestamp_ntz")).alias("until"),
    )
    fetched = part.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("model"), (F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).cast("long").alias("price"))
    return pricing.scd2_merge(current, fetched, "2024-03-01")


@register(
    f"""WITH RECURSIVE {SESSIONS}, up(session, node, depth) AS (SELECT session, session, 0 FROM sessions UNION ALL SELECT up.session, s.parent, up.depth + 1 FROM up JOIN sessions s ON up.node = s.session WHERE s.parent IS NOT NULL AND up.depth < 32)
  SELECT session, arg_max(node, depth) AS root, CAST(max(depth) AS INT) AS depth FROM up GROUP BY session"""
)
def root_of_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.roots(tables.order_sessions(spark, sf_dir).select("session", "parent"))


@register(
    f"""WITH RECURSIVE {SESSIONS}, fam(session, depth) AS (SELECT session, 0 FROM sessions WHERE parent IS NULL UNION SELECT s.session, fam.depth + 1 FROM sessions s JOIN fam ON s.parent = fam.session)
  SELECT session, CAST(min(depth) AS INT) AS depth FROM fam GROUP BY session"""
)
def family_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables.order_sessions(spark, sf_dir).select("session", "parent")
    return lineage.closure(sessions, sessions.filter("parent IS NULL"))


@register(f"WITH {SESSIONS} SELECT parent, count(*) AS children, true AS resolved FROM sessions WHERE parent IS NOT NULL GROUP BY parent")
def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_counts(tables.order_sessions(spark, sf_dir))


@register(
    f"""WITH RECURSIVE {SESSIONS}, ids AS (SELECT DISTINCT harness, session, l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) || '-' || CAST(round(l_discount * 100) AS BIGINT) AS id FROM lineitem JOIN sessions ON session = l_orderkey),
  e AS (SELECT a.session AS a, b.session AS b FROM ids a JOIN ids b ON a.harness = b.harness AND a.id = b.id AND a.session <> b.session UNION SELECT c.session, c.parent FROM sessions c JOIN sessions p ON c.parent = p.session AND c.harness = p.harness),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(v, c) AS (SELECT session, session FROM sessions UNION SELECT s.b, reach.c FROM reach JOIN s ON s.a = reach.v WHERE reach.c < s.b)
  SELECT session, harness, min(c) AS component FROM reach JOIN sessions ON v = session GROUP BY session, harness"""
)
def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's part, supplier, quantity and discount make its request id; orders that share one, or a customer, overlap."""
    lines = tables.table(spark, sf_dir, "lineitem")
    dash = F.lit("-")
    id = F.concat("l_partkey", dash, "l_suppkey", dash, F.col("l_quantity").cast("long"), dash, F.round(F.col("l_discount") * 100).cast("long"))
    return lineage.overlap_groups(tables.order_sessions(spark, sf_dir), lines.select(F.col("l_orderkey").alias("session"), id.alias("id")))


@register(
    """WITH w AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 97 AS w FROM orders), s AS (SELECT *, sum(w) OVER (PARTITION BY k) AS s, row_number() OVER (PARTITION BY k ORDER BY id) AS pos FROM w),
  f AS (SELECT *, CASE WHEN s > 0 THEN (1000 * w) // s ELSE 0 END AS fl, CASE WHEN s > 0 THEN (1000 * w) % s ELSE 0 END AS re FROM s),
  r AS (SELECT *, 1000 - sum(fl) OVER (PARTITION BY k) AS l, row_number() OVER (PARTITION BY k ORDER BY re DESC, pos) AS rk FROM f)
  SELECT k, id, CAST(CASE WHEN s > 0 THEN fl + (rk <= l)::BIGINT WHEN pos = 1 THEN 1000 ELSE 0 END AS BIGINT) AS share FROM r"""
)
def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 97).alias("w"))
    return shares.apportion(weights, ["k"], "w", 1000, "id").select("k", "id", "share")


@register(
    f"""WITH {REQUESTS}, n AS (SELECT session, ordinal, input, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY ordinal) - 1 AS i, sum(input) OVER (PARTITION BY session) AS a FROM requests)
  SELECT session, ordinal, CAST(a // n + (i < a % n)::BIGINT AS BIGINT) AS share FROM n"""
)
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.line_requests(spark, sf_dir).withColumn("a", F.sum("input").over(Window.partitionBy("session")))
    return shares.even_split(parts, ["session"], "a", "ordinal").select("session", "ordinal", "share")


@register(
    f"""WITH {REQUESTS}, {USED}, p AS (SELECT session, model, CAST(sum(cache_write) AS BIGINT) AS c, count(*) AS n FROM requests GROUP BY ALL),
  q AS (SELECT session, CASE WHEN count(*) FILTER (WHERE c IS NULL AND n > 0) = 0 THEN coalesce(CAST(sum(c) AS BIGINT), 0) END AS parts FROM p GROUP BY session)
  SELECT session, cache_write AS whole, parts, CASE WHEN parts IS NULL OR cache_write IS NULL THEN 'unestablished' WHEN parts = cache_write THEN 'conserved' ELSE 'not-conserved' END AS status FROM used LEFT JOIN q USING (session)"""
)
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.line_requests(spark, sf_dir)
    return shares.conserved(usage.session_usage(requests, ["session", "model"]), usage.session_usage(requests), ["session"], "cache_write")


#: Quota observations: a user's events of one type are a pool; resets are each week's end, errors record none.
CHAINS = f"""{TURNS}, o AS (SELECT DISTINCT pool, session, ts AS tm, CAST(floor(value) AS BIGINT) AS percent, CASE WHEN pool <> 'error' THEN date_trunc('week', ts) + INTERVAL 7 DAY END AS resets_at FROM turns),
  n AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN false WHEN resets_at IS NULL AND lag(resets_at) OVER w IS NULL THEN percent < lag(percent) OVER w ELSE coalesce(abs(epoch_us(resets_at) - epoch_us(lag(resets_at) OVER w)) >= 61000000, true) END AS new FROM o WINDOW w AS (PARTITION BY pool, session ORDER BY tm, percent)),
  c AS (SELECT pool, session, tm, percent, resets_at, CAST(count(*) FILTER (WHERE new) OVER (PARTITION BY pool, session ORDER BY tm, percent) AS BIGINT) AS chain FROM n),
  j AS (SELECT *, coalesce(resets_at IS NOT NULL AND percent < max(percent) OVER (PARTITION BY pool, session, chain ORDER BY tm, percent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM c),
  chains AS (SELECT *, CASE WHEN NOT stale THEN lead(percent) OVER (PARTITION BY pool, session, chain, stale ORDER BY tm, percent) - percent END AS rise FROM j),
  iv AS (SELECT pool, session, chain, row_number() OVER w AS interval, tm AS s, lead(tm) OVER w AS e, rise FROM chains WHERE NOT stale WINDOW w AS (PARTITION BY pool, session, chain ORDER BY tm, percent))"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    resets = F.when(F.col("pool") != "error", F.date_trunc("week", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 7 DAY"))
    seen = tables.event_turns(spark, sf_dir).select("pool", "session", F.col("ts").alias("at"), F.floor("value").alias("percent"), resets.alias("resets_at"))
    return shares.quota_chains(seen, ["pool", "session"])


@register(f'WITH {CHAINS} SELECT pool, session, tm AS "at", percent, resets_at, chain, stale, rise FROM chains')
def quota_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(spark, sf_dir)


@register(f"WITH {CHAINS} SELECT pool, session, chain, interval, s AS start, e AS \"end\", rise FROM iv WHERE e IS NOT NULL")
def quota_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.chain_intervals(chained(spark, sf_dir), ["pool", "session"])


#: Shares of intervals for the bounds: a fixed part by the interval's number.
@register(
    f"""WITH {CHAINS}, w AS (SELECT pool, session, chain, interval, (interval % 4) / 4.0::DOUBLE AS share FROM iv WHERE e IS NOT NULL),
  k AS (SELECT pool, session, chain, percent, rise, row_number() OVER (PARTITION BY pool, session, chain ORDER BY tm, percent) AS i FROM chains WHERE NOT stale),
  x AS (SELECT k.*, coalesce(b.share, 0) - coalesce(a.share, 0) AS c, coalesce(a.share, 0) AS after FROM k LEFT JOIN w a ON k.pool = a.pool AND k.session = a.session AND k.chain = a.chain AND k.i = a.interval LEFT JOIN w b ON k.pool = b.pool AND k.session = b.session AND k.chain = b.chain AND k.i = b.interval + 1),
  f AS (SELECT *, coalesce((lag(percent) OVER w <> percent)::INT, 1) AS new FROM x WINDOW w AS (PARTITION BY pool, session, chain ORDER BY i)), g AS (SELECT *, sum(new) OVER (PARTITION BY pool, session, chain ORDER BY i) AS run FROM f),
  s AS (SELECT *, sum(c) OVER (PARTITION BY pool, session, chain, run ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM g),
  r AS (SELECT pool, session, (min(percent) - 0.5::DOUBLE) * sum(c) AS base, least(0, min(tail)) AS lo, greatest(0, max(tail)) AS hi, sum(after * coalesce(rise, 0)) AS e FROM s GROUP BY pool, session, chain, run)
  SELECT pool, session, round(sum(e), 6) AS estimate, round(greatest(0, sum(base + lo)), 6) AS at_least, round(sum(base + hi), 6) AS at_most FROM r GROUP BY pool, session"""
)
def plateau_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = chained(spark, sf_dir)
    share = shares.chain_intervals(chains, ["pool", "session"]).select("pool", "session", "chain", "interval", ((F.col("interval") % 4) / 4.0).alias("share"))
    bounds = shares.plateau_bounds(chains, ["pool", "session"], share)
    return bounds.select("pool", "session", *[F.round(c, 6).alias(c) for c in ("estimate", "at_least", "at_most")])


@register(
    f"""WITH {CHAINS}, p AS (SELECT pool, chain, interval, session, interval % 3 * 7 + session % 5 AS tokens, max(rise) OVER (PARTITION BY pool, chain, interval) AS rise FROM iv WHERE e IS NOT NULL),
  t AS (SELECT pool, chain, interval, sum(tokens) AS t, max(rise) AS r FROM p GROUP BY ALL), q AS (SELECT pool, chain, sum(t) AS a, sum(r) AS r FROM t WHERE t > 0 GROUP BY ALL), u AS (SELECT pool, chain, session, sum(tokens) AS s FROM p GROUP BY ALL)
  SELECT pool, chain, session, CAST(r * s AS DOUBLE) / CAST(a AS DOUBLE) AS percent FROM u JOIN q USING (pool, chain)"""
)
def smoothed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of one pool as its sessions, whose intervals of one number are one interval."""
    steps = shares.chain_intervals(chained(spark, sf_dir), ["pool", "session"])
    rise = F.max("rise").over(Window.partitionBy("pool", "chain", "interval"))
    parts = steps.select("pool", "chain", "interval", "session", (F.col("interval") % 3 * 7 + F.col("session") % 5).alias("tokens"), rise.alias("rise"))
    return shares.smoothed_shares(parts, ["pool"])


@register(
    """WITH l AS (SELECT p_brand AS brand, p_partkey AS session, CASE WHEN p_size % 6 > 0 THEN p_size / 2.0::DOUBLE END AS percent, CAST(p_partkey % 1000 AS BIGINT) AS tokens, CASE WHEN p_size % 10 > 0 THEN TIMESTAMP '2024-03-01' - to_minutes(CAST(p_size AS BIGINT)) END AS a FROM part),
  j AS (SELECT *, a IS NULL OR a > TIMESTAMP '2024-03-01' - INTERVAL 15 MINUTE OR percent IS NULL AS out FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY percent, session) AS i, count(*) OVER (PARTITION BY brand) AS n FROM j WHERE NOT out),
  f AS (SELECT brand, count(*) AS lanes, avg(percent) FILTER (WHERE i * 2 BETWEEN n AND n + 2) AS median, min(percent) FILTER (WHERE i * 10 >= n * 9) AS p90, max(percent) AS max, CASE WHEN sum(percent) > 0 THEN sum(tokens) / sum(percent) END AS tokens_per_percent FROM k GROUP BY brand),
  x AS (SELECT brand, count(*) FILTER (WHERE out) AS excluded FROM j GROUP BY brand) SELECT brand, excluded, coalesce(lanes, 0) AS lanes, median, p90, max, tokens_per_percent FROM x LEFT JOIN f USING (brand)"""
)
def lane_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lanes of their brand."""
    size, now = F.col("p_size"), F.lit("2024-03-01").cast("timestamp_ntz")
    lanes = tables.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("session"), F.when(size % 6 > 0, size / 2.0).alias("percent"), (F.col("p_partkey") % 1000).alias("tokens"),
        F.when(size % 10 > 0, now - F.make_dt_interval(mins=size.cast("int"))).alias("last_activity"),
    )
    return shares.lane_rates(lanes, ["brand"], "2024-03-01")


#: Evidence from orders: a customer's order covers 200 days from its date, as work named by its priority.
SEGMENTS = """sp AS (SELECT o_custkey AS k, o_orderpriority AS work, o_orderdate AS f, o_orderdate + INTERVAL 200 DAY AS t FROM orders),
  ed AS (SELECT k, f AS e FROM sp UNION SELECT k, t FROM sp),
  sg AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY e) AS segment, e AS a, lead(e) OVER (PARTITION BY k ORDER BY e) AS b FROM ed UNION ALL SELECT k, 0, NULL, min(e) FROM ed GROUP BY k),
  cv AS (SELECT sg.k, segment, a, b, list_sort(list(DISTINCT work) FILTER (WHERE work IS NOT NULL)) AS works FROM sg LEFT JOIN sp ON sg.k = sp.k AND sp.f <= sg.a AND sg.b <= sp.t GROUP BY 1, 2, 3, 4)"""


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("work"), F.col("o_orderdate").alias("from"), (F.col("o_orderdate") + F.expr("INTERVAL 200 DAY")).alias("to")
    )
    return attribution.segments(evidence, ["k"])


@register(f"WITH {SEGMENTS} SELECT k, segment, a AS \"from\", b AS \"to\", coalesce(array_to_string(works, ','), '') AS works FROM cv")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir).withColumn("works", F.array_join("works", ","))


@register(
    f"""WITH {SEGMENTS}, x AS (SELECT *, coalesce(len(works), 0) AS n, min(segment) FILTER (WHERE len(works) > 0) OVER (PARTITION BY k) AS fi, max(segment) FILTER (WHERE len(works) > 0) OVER (PARTITION BY k) AS la FROM cv)
  SELECT CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'overlap' WHEN fi IS NULL OR segment < fi THEN 'before-first-item' WHEN segment > la THEN 'after-last-item' ELSE 'between-items' END AS reason, count(*) AS segments FROM x GROUP BY 1"""
)
def segment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.reasons(cut(spark, sf_dir), ["k"]).groupBy("reason").agg(F.count("*").alias("segments"))


@register(
    f"""WITH {SEGMENTS}, r AS (SELECT works, segment * 3 + 1 AS requests, coalesce(len(works), 0) AS n FROM cv),
  e AS (SELECT requests, n, unnest(CASE WHEN n = 0 THEN [NULL] ELSE works END) AS work, unnest(CASE WHEN n = 0 THEN [0] ELSE range(n) END) AS i FROM r)
  SELECT work, CAST(sum(CASE WHEN n = 1 THEN requests ELSE 0 END) AS BIGINT) AS conserving, CAST(sum(CASE WHEN n > 1 THEN requests // n + (i < requests % n)::BIGINT WHEN n = 1 THEN requests ELSE 0 END) AS BIGINT) AS allocated,
  CAST(sum(CASE WHEN n = 0 THEN requests ELSE 0 END) AS BIGINT) AS unattributed FROM e GROUP BY work"""
)
def attribution_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.layers(cut(spark, sf_dir).withColumn("requests", F.col("segment") * 3 + 1), ["k"])


@register(
    f"""WITH {PAIRS}, f AS (SELECT harness, session, count(*) AS turns, max(ordinal) AS last, arg_max(kind, ordinal) AS last_kind, max(ordinal) FILTER (WHERE kind = 'operator') AS lo, max(ordinal) FILTER (WHERE kind = 'assistant') AS la,
    arg_max(ts, ordinal) FILTER (WHERE kind = 'operator') AS to_, arg_max(ts, ordinal) FILTER (WHERE kind = 'assistant') AS ta, arg_max(kind, ordinal) FILTER (WHERE kind NOT IN ('control', 'notice')) AS closing, bool_or(kind = 'unknown') AS kind_unknown, bool_and(ts IS NULL) AS no_timestamps FROM turns GROUP BY harness, session),
  oc AS (SELECT session, max(ordinal) FILTER (WHERE direction = 'result') AS r, max(ordinal) FILTER (WHERE direction = 'result' AND pair IS NOT NULL) AS answer, max(ordinal) FILTER (WHERE direction = 'call' AND pair IS NULL) AS open FROM pairs GROUP BY session)
  SELECT harness, f.session, turns, last, last_kind, lo AS last_operator, la AS last_assistant, kind_unknown, no_timestamps, lo IS NOT NULL AND la IS NOT NULL AND (to_ IS NULL OR ta IS NULL) AS by_ordinal,
  concat_ws(',', CASE WHEN lo IS NOT NULL AND (la IS NULL OR CASE WHEN to_ IS NOT NULL AND ta IS NOT NULL THEN to_ > ta ELSE lo > la END) THEN 'operator-turn-after-assistant' END, CASE WHEN last_kind = 'control' THEN 'control-turn-last' END, CASE WHEN last_kind = 'notice' THEN 'notice-turn-last' END,
  CASE WHEN open > coalesce(r, -1) THEN 'call-without-result' END, CASE WHEN last_kind = 'tool' AND answer = last THEN 'results-without-narration' END, CASE WHEN closing = 'assistant' THEN 'assistant-close' END) AS facts FROM f LEFT JOIN oc USING (session)"""
)
def endings_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.endings(tables.event_turns(spark, sf_dir), paired(spark, sf_dir))


@register(
    f"""WITH {TALK}, f AS (SELECT harness, session, count(*) AS turns, max(ordinal) AS last, arg_max(kind, ordinal) AS last_kind, max(ordinal) FILTER (WHERE kind = 'operator') AS lo, max(ordinal) FILTER (WHERE kind = 'assistant') AS la,
    arg_max(kind, ordinal) FILTER (WHERE kind NOT IN ('control', 'notice')) AS closing, bool_or(kind = 'unknown') AS kind_unknown FROM talk GROUP BY harness, session)
  SELECT harness, session, turns, last, last_kind, lo AS last_operator, la AS last_assistant, kind_unknown, true AS no_timestamps, lo IS NOT NULL AND la IS NOT NULL AS by_ordinal,
  concat_ws(',', CASE WHEN lo > coalesce(la, -1) THEN 'operator-turn-after-assistant' END, CASE WHEN last_kind = 'control' THEN 'control-turn-last' END, CASE WHEN closing = 'assistant' THEN 'assistant-close' END) AS facts FROM f"""
)
def endings_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.endings(tables.conversation_turns(spark, sf_dir))


@register(
    f"""WITH RECURSIVE {TALK}, t AS (SELECT harness, session, ordinal, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY harness, session ORDER BY ordinal) AS n FROM talk),
  f AS (SELECT *, CAST(0 AS BIGINT) AS lane, bytes AS filled FROM t WHERE n = 1 UNION ALL SELECT t.*, lane + (filled + t.bytes > 600)::BIGINT, CASE WHEN filled + t.bytes > 600 THEN t.bytes ELSE filled + t.bytes END
    FROM f JOIN t ON f.harness = t.harness AND f.session = t.session AND t.n = f.n + 1) SELECT harness, session, ordinal, bytes, lane FROM f"""
)
def workset_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.lanes(tables.conversation_turns(spark, sf_dir), 600)


@register(
    f"""WITH {TALK} SELECT harness, session, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'system') AS n_system,
  count(*) FILTER (WHERE role NOT IN ('user', 'assistant', 'system')) AS n_other, count(role) = count(*) AS complete FROM talk GROUP BY harness, session"""
)
def turns_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.count_roles(tables.conversation_turns(spark, sf_dir))


@register(
    f"""WITH {TALK}, n AS (SELECT *, row_number() OVER (PARTITION BY harness, session, kind ORDER BY ordinal DESC) AS k FROM talk WHERE kind IN ('operator', 'assistant'))
  SELECT harness, session, kind, ordinal, substring(text, 1, 60) AS text, length(text) > 60 AS cut FROM n WHERE k = 1"""
)
def text_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.newest_texts(tables.conversation_turns(spark, sf_dir), 60)


@register(
    f"""WITH {TALK}, c AS (SELECT harness, session, ordinal, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, row_number() OVER w AS n, sum(coalesce(strlen(text), 0)) OVER w AS s, count(*) OVER (PARTITION BY harness, session) AS a
    FROM talk WINDOW w AS (PARTITION BY harness, session ORDER BY ordinal DESC)), k AS (SELECT * FROM c WHERE n <= 4 AND s <= 600)
  SELECT harness, session, ordinal, bytes, a - count(*) OVER (PARTITION BY harness, session) AS omitted FROM k"""
)
def recent_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.recent_within(tables.conversation_turns(spark, sf_dir), 4, 600)


@register(
    f"""WITH {TURNS}, {GAPS}, d AS (SELECT harness, session, gap FROM gaps WHERE kind = 'assistant' AND gap >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY harness, session ORDER BY gap) AS k, count(*) OVER (PARTITION BY harness, session) AS n FROM d)
  SELECT harness, session, max(n) AS n, (CAST(min(gap) FILTER (WHERE 2 * k >= n) AS DOUBLE) + min(gap) FILTER (WHERE 2 * k > n)) / 2 AS median, min(gap) FILTER (WHERE 10 * k >= 9 * n) AS p90 FROM r GROUP BY harness, session"""
)
def response_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.medians(turns.response_times(tables.event_turns(spark, sf_dir)), ["harness", "session"], "duration_ms")


@register(
    f"""WITH {REQUESTS}, s AS (SELECT session, sum(input) AS i, sum(cache_read) AS r, sum(cache_write) AS w, bool_and(input IS NOT NULL AND cache_read IS NOT NULL AND cache_write IS NOT NULL) AS a FROM requests GROUP BY session)
  SELECT session, CASE WHEN a AND i + r + w > 0 THEN CAST(r AS DOUBLE) / CAST(i + r + w AS DOUBLE) END AS read_ratio, CASE WHEN a AND i + r + w > 0 THEN CAST(w AS DOUBLE) / CAST(i + r + w AS DOUBLE) END AS write_ratio FROM s"""
)
def cache_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cache_ratios(tables.line_requests(spark, sf_dir), ["session"])


@register(
    f"""WITH {REQUESTS} SELECT session, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, count(DISTINCT model) AS n_models, count(DISTINCT model) > 1 AS mixed FROM requests GROUP BY session"""
)
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.distinct_models(tables.line_requests(spark, sf_dir), ["session"])


@register(f"WITH {SESSIONS} SELECT parent, session, row_number() OVER (PARTITION BY parent ORDER BY last_activity NULLS LAST, session) AS position FROM sessions WHERE parent IS NOT NULL")
def children_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.children_in_order(tables.order_sessions(spark, sf_dir), "last_activity")


@register("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS sessions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 30")
def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("id"))
    return lineage.shared_ids(ids, 30)


@register(
    f"""WITH RECURSIVE {SESSIONS}, up(session, node, owner, depth) AS (SELECT s.session, s.session, CASE WHEN s.directory LIKE '1%' THEN 'k' || s.session END, 0 FROM sessions s
    UNION ALL SELECT up.session, p.session, CASE WHEN p.directory LIKE '1%' THEN 'k' || p.session END, up.depth + 1 FROM up JOIN sessions c ON up.node = c.session JOIN sessions p ON c.parent = p.session WHERE up.owner IS NULL)
  SELECT session, max(owner) AS owner FROM up GROUP BY session"""
)
def inherited_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = tables.order_sessions(spark, sf_dir).withColumn("owner", F.when(F.col("directory").startswith("1"), F.concat(F.lit("k"), F.col("session").cast("string"))))
    return lineage.inherited_owner(sessions)


@register(
    """WITH d AS (SELECT DISTINCT l_suppkey AS session, substring(sha256(CAST(l_partkey AS VARCHAR)), 1, 16) AS digest FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY digest) AS n, count(*) OVER (PARTITION BY session) AS a FROM d) SELECT session, digest, a > 2048 AS sampled FROM r WHERE n <= 2048"""
)
def id_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("id"))
    return lineage.bottom_k(ids, ["session"])


@register(
    f"""WITH {TURNS}, {GAPS}, s AS (SELECT *, sum(CASE WHEN gap > {IDLE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY harness, session ORDER BY ordinal) AS stretch FROM gaps),
  st AS (SELECT harness, session, CAST(stretch AS BIGINT) AS stretch, min(ts) AS first FROM s GROUP BY ALL)
  SELECT t.harness, t.session, t.ordinal, coalesce(max(st.stretch) FILTER (WHERE st.first <= t.ts), min(st.stretch)) AS stretch FROM turns t JOIN st ON t.harness = st.harness AND t.session = st.session WHERE t.kind = 'assistant' GROUP BY 1, 2, 3"""
)
def stretch_of_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tables.event_turns(spark, sf_dir)
    asked = told.filter("kind = 'assistant'").select("harness", "session", "ordinal", F.col("ts").alias("at"))
    return spans.stretch_of(asked, turns.stretches(told, IDLE_MS), ["harness", "session"]).drop("at")


#: Intervals of a pool: a year of order dates each; uses are the pool's line items.
@register(
    """WITH iv AS (SELECT p AS pool, y AS "interval", make_timestamp(y, 1, 1, 0, 0, 0) AS s, make_timestamp(y + 1, 1, 1, 0, 0, 0) AS e, CAST(y % 5 AS DOUBLE) AS rise FROM (VALUES ('A'), ('N'), ('R'), ('S')) a(p), range(1993, 1997) b(y)),
  u AS (SELECT l_returnflag AS pool, l_orderkey AS session, l_shipdate AS at, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem),
  j AS (SELECT iv.pool, "interval", session, CAST(sum(tokens) AS BIGINT) AS tokens, max(rise) AS rise FROM iv JOIN u ON iv.pool = u.pool AND u.at > s AND u.at <= e GROUP BY 1, 2, 3)
  SELECT pool, "interval", session, tokens, rise * tokens / CAST(sum(tokens) OVER (PARTITION BY pool, "interval") AS DOUBLE) AS share FROM j
  UNION ALL SELECT pool, "interval", NULL, 0, rise FROM iv WHERE (pool, "interval") NOT IN (SELECT pool, "interval" FROM j)"""
)
def allowance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, y, f"{y}-01-01", f"{y + 1}-01-01", float(y % 5)) for p in "ANRS" for y in range(1993, 1997)]
    intervals = spark.createDataFrame(rows, "pool string, interval long, s string, e string, rise double").select(
        "pool", "interval", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"), "rise"
    )
    lines = tables.table(spark, sf_dir, "lineitem")
    uses = lines.select(F.col("l_returnflag").alias("pool"), F.col("l_orderkey").alias("session"), F.col("l_shipdate").alias("at"), F.col("l_quantity").cast("long").alias("tokens"))
    return shares.allowance_shares(intervals, uses)


@register(
    """WITH p AS (SELECT p_partkey AS pool, CAST(p_size AS BIGINT) AS lanes, p_retailprice / 20 AS used FROM part), r AS (SELECT s_suppkey AS pool, s_nationkey / 10.0::DOUBLE AS low, s_nationkey / 5.0::DOUBLE AS high FROM supplier),
  m AS (SELECT pool, lanes, used, lanes * low AS need_low, lanes * high AS need_high, greatest(0, 100 - used - CASE WHEN used = floor(used) THEN 0.5::DOUBLE ELSE 0 END) AS left_low,
    least(100, 100 - used + CASE WHEN used = floor(used) THEN 0.5::DOUBLE ELSE 0 END) AS left_high FROM p LEFT JOIN r USING (pool))
  SELECT *, CASE WHEN need_low IS NULL THEN 'unmeasured' WHEN need_high <= left_low THEN 'yes' WHEN need_low > left_high THEN 'no' ELSE 'maybe' END AS fits FROM m"""
)
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pool"), F.col("p_size").cast("long").alias("lanes"), (F.col("p_retailprice") / 20).alias("used"))
    rates = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pool"), (F.col("s_nationkey") / 10.0).alias("low"), (F.col("s_nationkey") / 5.0).alias("high"))
    return shares.forecast(plans, rates, ["pool"])


@register(
    """WITH e AS (SELECT DISTINCT l_orderkey AS edit, l_partkey AS d FROM lineitem), n AS (SELECT edit, count(*) AS n FROM e GROUP BY edit HAVING count(*) >= 2),
  c AS (SELECT DISTINCT 'c' || o_custkey AS sha, l_partkey AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  m AS (SELECT e.edit, c.sha, count(*) AS common, count(*) / CAST(max(n.n) AS DOUBLE) AS overlap FROM e JOIN n USING (edit) JOIN c ON e.d = c.d GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY edit ORDER BY overlap DESC, sha) AS k FROM m WHERE overlap >= 0.5) SELECT edit, sha, common, overlap FROM r WHERE k = 1"""
)
def edit_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edits, customers as commits, parts as the digests of lines."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edit"), F.col("l_partkey").alias("d"))
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sha"))
    # an unknown part counts among an order's lines
    digests = F.when(F.bool_or(F.col("d").isNull()), F.array_append(F.collect_set("d"), F.lit(None))).otherwise(F.collect_set("d"))
    edits = spread(lines, lines.count(), "edit").groupBy("edit").agg(digests.alias("digests"))
    owned = edits.join(orders, F.col("edit") == F.col("o_orderkey")).select("sha", "digests")
    commits = spread(owned, orders.count(), "sha").groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_list("digests"))).alias("digests"))
    return evidence.best_overlaps(edits, commits)


@register(
    f"""WITH {REQUESTS}, c AS (SELECT o_orderpriority AS directory, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%' GROUP BY 1)
  SELECT o_orderpriority AS directory, last IS NULL OR moment > last AS uncommitted, count(*) AS requests FROM requests JOIN orders ON session = o_orderkey LEFT JOIN c ON o_orderpriority = directory GROUP BY 1, 2"""
)
def uncommitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    commits = orders.filter("o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%'").select(F.col("o_orderpriority").alias("directory"), F.col("o_orderdate").alias("committed_at"))
    placed = tables.line_requests(spark, sf_dir).join(tables.order_sessions(spark, sf_dir).select("session", "directory"), "session")
    return evidence.uncommitted(placed, commits).groupBy("directory", "uncommitted").agg(F.count("*").alias("requests"))
