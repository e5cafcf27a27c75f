"""Registered queries that trace evidence: copies by byte, commits found again, members of a repository, proofs of absence, subagents' windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.operators import commits, listing, prefilter, shares, spans
from lagoon.plans import recorded
from lagoon.plans.growing import LINES, bucket, line_rows, written
from lagoon.plans.registry import HARNESS, REQUESTS, SESSIONS, register
from lagoon.sources import copies, pins, recordings, tables


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = pins.replay(pins.pin(spark, written(line_rows(spark, sf_dir)), "*.txt"))
    return copies.index_values(lines.select("file", "start", "end"))


#: The values of each line and where they lie: its object and three fields.
VALUES = f"""{LINES}, v AS (SELECT b, stop - n AS record, conv_id::VARCHAR AS s, turn::VARCHAR AS t, n, line FROM p),
  x AS (SELECT b, record, '' AS pointer, record AS a, record + n - 1 AS z FROM v UNION ALL SELECT b, record, '/s', record + 5, record + 5 + strlen(s) FROM v
    UNION ALL SELECT b, record, '/t', record + 10 + strlen(s), record + 10 + strlen(s) + strlen(t) FROM v UNION ALL SELECT b, record, '/d', record + 15 + strlen(s) + strlen(t), record + n - 2 FROM v)"""


@register(f"WITH {VALUES} SELECT b, record, pointer, a AS start, z AS stop FROM x")
def value_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of each recorded line by byte of its file."""
    return indexed(spark, sf_dir).select(bucket().alias("b"), "record", "pointer", "start", F.col("end").alias("stop"))


@register(
    f"""WITH {VALUES}, o AS (SELECT line AS c FROM v UNION SELECT s FROM v UNION SELECT t FROM v UNION SELECT substr(line, strpos(line, '"d":') + 4, 34) FROM v) SELECT sha256(c) AS sha256, strlen(c) AS bytes, c AS content FROM o"""
)
def evidence_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different value once, byte for byte, named by its digest."""
    kept, _ = copies.copies(indexed(spark, sf_dir))
    return kept.select("sha256", "bytes", F.col("content").cast("string").alias("content"))


def diff_of(name: Column, lines: Column, at: Column) -> Column:
    """A unified diff of one file whose added lines are ``lines``."""
    return F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 1..2 100644\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), at, F.lit(",1 +"), at, F.lit(",9 @@\n context\n+"), F.array_join(lines, "\n+"))


@register(
    """WITH x AS (SELECT l_orderkey AS k, count(*) AS m FROM lineitem GROUP BY 1), o AS (SELECT o_custkey AS session, o_orderkey AS k, m FROM orders JOIN x ON k = o_orderkey),
  r AS (SELECT session, k, m, CASE k % 5 WHEN 0 THEN left(md5('new' || k), 12) WHEN 1 THEN md5('old' || k) WHEN 2 THEN md5('amended' || k) WHEN 3 THEN md5('gone' || k) ELSE 'branch-' || k END AS revision FROM o)
  SELECT session, revision, CASE WHEN k % 5 < 2 OR (k % 5 = 2 AND m > 2) THEN md5('new' || k) END AS sha, CASE WHEN k % 5 = 0 THEN 'exact' WHEN k % 5 = 1 THEN 'patch-equivalent' WHEN k % 5 = 2 AND m > 2 THEN 'line-majority' END AS how,
  CASE k % 5 WHEN 2 THEN CASE WHEN m > 2 THEN NULL ELSE 'no-equivalent' END WHEN 3 THEN 'missing' WHEN 4 THEN 'not-a-revision' END AS reason FROM r"""
)
def observed_commits_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of a file with a line for each item of an order: seen by the beginning of a name, before a rebase, before one line was amended, lost, and no revision at all."""
    item = F.concat_ws(" ", F.lit("item"), "l_orderkey", "n", "l_partkey")
    by = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    lines = tables.dealt(spark, sf_dir, "lineitem", "l_orderkey").withColumn("n", F.row_number().over(by))
    made = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n", item.alias("text")))).alias("x")).withColumn("texts", F.col("x.text"))
    name, key = F.concat(F.lit("f"), F.col("k").cast("string")), F.col("k").cast("string")
    amended = F.concat(F.slice("texts", 1, F.size("texts") - 1), F.array(F.lit("another last line")))
    named = {n: F.md5(F.concat(F.lit(n), key).cast("binary")) for n in ("new", "old", "amended", "gone")}
    set_ = made.select(named["new"].alias("sha"), diff_of(name, F.col("texts"), F.lit("10")).alias("diff"))
    objects = made.filter("k % 5 IN (1, 2)").select(
        F.when(F.col("k") % 5 == 1, named["old"]).otherwise(named["amended"]).alias("sha"), diff_of(name, F.when(F.col("k") % 5 == 1, F.col("texts")).otherwise(amended), F.lit("77")).alias("diff")
    )
    k = F.col("k") % 5
    seen = F.when(k == 0, F.substring(named["new"], 1, 12)).when(k == 1, named["old"]).when(k == 2, named["amended"]).when(k == 3, named["gone"]).otherwise(F.concat(F.lit("branch-"), key))
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("k")).join(made.select("k"), "k")
    return commits.resolve_observed(orders.select("session", seen.alias("revision")), set_, objects)


@register(
    f"""WITH RECURSIVE {SESSIONS}, c AS (SELECT session FROM sessions WHERE last_activity <= TIMESTAMP '1996-01-01' AND last_activity + INTERVAL 30 DAY >= TIMESTAMP '1995-01-01'),
  loc AS (SELECT o_orderkey AS session, '/w/r' || o_custkey % 7 || '/sub' AS directory, 'https://Git.h/team/p' || o_custkey % 11 || '.git' AS remote, o_custkey % 7 = 6 AS unheld, o_orderdate AS moment FROM orders JOIN c ON session = o_orderkey),
  seen AS (SELECT l_orderkey AS session, l_partkey AS p, l_linenumber = 1 AS created, l_shipdate AS moment FROM lineitem JOIN c ON session = l_orderkey WHERE l_partkey % 50 = 0),
  remote AS (SELECT DISTINCT session FROM loc WHERE remote = 'https://Git.h/team/p4.git'),
  placed AS (SELECT directory FROM loc JOIN remote USING (session) WHERE unheld UNION SELECT directory FROM loc JOIN seen USING (session) WHERE unheld AND created AND loc.moment <= seen.moment),
  m AS (SELECT session, 'location' AS rule FROM loc WHERE directory = '/w/r3/sub' UNION SELECT session, 'remote' FROM remote UNION SELECT session, 'commit' FROM seen UNION SELECT session, 'placed' FROM loc WHERE unheld AND directory IN (SELECT directory FROM placed)),
  own AS (SELECT session, array_to_string(list_sort(list(rule)), ',') AS rules FROM m GROUP BY session),
  d AS (SELECT session, 0 AS depth FROM own UNION ALL SELECT s.session, d.depth + 1 FROM sessions s JOIN d ON s.parent = d.session WHERE d.depth < 200)
  SELECT session, coalesce(rules, 'lineage') AS rules, min(depth) AS depth FROM d LEFT JOIN own USING (session) GROUP BY ALL"""
)
def gathered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one year that worked in a worktree, had the remote, named a commit or were placed beside one that did, and their descendants."""
    orders, key = tables.table(spark, sf_dir, "orders"), F.col("o_custkey")
    listed = tables.order_sessions(spark, sf_dir)
    sessions = listed.select("session", F.col("last_activity").alias("started"), (F.col("last_activity") + F.expr("INTERVAL 30 DAY")).alias("last_activity"))
    locations = orders.select(
        F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("at"), F.concat(F.lit("/w/r"), (key % 7).cast("string"), F.lit("/sub")).alias("directory"),
        F.concat(F.lit("https://Git.h/team/p"), (key % 11).cast("string"), F.lit(".git")).alias("remote"), F.when(key % 7 != 6, True).alias("held"),
    )
    sha = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    observed = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_shipdate").alias("at"), F.substring(sha("l_partkey"), 1, 20).alias("sha"), (F.col("l_linenumber") == 1).alias("created"))
    named = tables.table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(sha("p_partkey").alias("sha"))
    worktrees, remotes = spark.createDataFrame([("/w/r3",)], "path string"), spark.createDataFrame([("git@git.h:team/p4",)], "remote string")
    found = commits.gather(sessions, locations, observed, listed.select("session", "parent"), worktrees, remotes, named, "1995-01-01", "1996-01-01")
    return found.withColumn("rules", F.array_join("rules", ","))


@register(
    f"""WITH t AS (SELECT {HARNESS.format('conv_id')} AS h, conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
  SELECT 'c' || conv_id AS session, n AS ordinal FROM t WHERE contains(lower(text), 'ent an')"""
)
def prefiltered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search of native recordings that parses only those whose raw lines may hold the needle."""
    records, _ = recorded.claude(spark, sf_dir)
    found = prefilter.search_recordings(records, "ENT an", recordings.claude_turns, lambda turns: listing.search_whole(turns, "ENT an", 1 << 30))
    return found.select("session", "ordinal")


@register(
    f"""WITH RECURSIVE {REQUESTS}, {SESSIONS}, k AS (SELECT session, parent, parent IS NOT NULL AND session % 3 <> 0 AS sub FROM sessions), q AS (SELECT session, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output
    FROM requests WHERE moment >= TIMESTAMP '1996-01-01' AND moment < TIMESTAMP '1996-07-01' GROUP BY session),
  up AS (SELECT session, session AS root FROM q UNION ALL SELECT up.session, k.parent FROM up JOIN k ON k.session = up.root WHERE k.sub), top AS (SELECT up.session, root FROM up JOIN k ON k.session = up.root WHERE NOT k.sub),
  r AS (SELECT root AS session, CASE WHEN q.session = root THEN 'own' ELSE 'subagents' END AS share, CAST(sum(requests) AS BIGINT) AS requests, count(*) AS sessions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM q JOIN top USING (session) GROUP BY 1, 2)
  SELECT session, share, CASE WHEN max(share = 'own') OVER (PARTITION BY session) THEN 'window' ELSE 'subagents' END AS reached, requests, sessions, input, output FROM r"""
)
def window_by_subagents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year by listed session: its own requests and those of its subagents, however deep, also where it made none itself."""
    sessions = tables.order_sessions(spark, sf_dir)
    kinds = sessions.select("session", "parent", (F.col("parent").isNotNull() & (F.col("session") % 3 != 0)).alias("subagent"), F.lit(None).cast("long").alias("carried_from"))
    return spans.window_families(tables.line_requests(spark, sf_dir), kinds, "1996-01-01", "1996-07-01")


#: Events of a kind as a pool: purchases and errors observe its percent, all others use it; a kind's users are its sessions.
MEASURED = """ob AS (SELECT DISTINCT CAST(user_id % 6 AS BIGINT) AS pool, ts AS tm, floor(value / 3) AS percent, date_trunc('week', ts) + INTERVAL 7 DAY AS resets_at FROM events WHERE event_type IN ('purchase', 'error')),
  n AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN false ELSE coalesce(abs(epoch_us(resets_at) - epoch_us(lag(resets_at) OVER w)) >= 61000000, true) END AS new FROM ob WINDOW w AS (PARTITION BY pool ORDER BY tm, percent)),
  c AS (SELECT *, CAST(count(*) FILTER (WHERE new) OVER (PARTITION BY pool ORDER BY tm, percent) AS BIGINT) AS chain FROM n),
  j AS (SELECT *, coalesce(percent < max(percent) OVER (PARTITION BY pool, chain ORDER BY tm, percent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM c),
  iv AS (SELECT pool, chain, tm AS s, lead(tm) OVER w AS e, lead(percent) OVER w - percent AS rise FROM j WHERE NOT stale WINDOW w AS (PARTITION BY pool, chain ORDER BY tm, percent)),
  us AS (SELECT CAST(user_id % 6 AS BIGINT) AS pool, user_id AS session, ts AS tm, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events WHERE event_type NOT IN ('purchase', 'error')),
  sh AS (SELECT iv.pool, chain, s, session, sum(tokens) AS tokens, max(rise) AS rise FROM iv JOIN us ON us.pool = iv.pool AND us.tm > s AND us.tm <= e GROUP BY ALL),
  wh AS (SELECT *, CASE WHEN sum(tokens) OVER (PARTITION BY pool, chain, s) > 0 THEN rise * tokens / CAST(sum(tokens) OVER (PARTITION BY pool, chain, s) AS DOUBLE) END AS share FROM sh),
  la AS (SELECT pool, session, sum(share) AS percent, CAST(sum(tokens) AS BIGINT) AS tokens FROM wh GROUP BY ALL), ac AS (SELECT user_id AS session, max(ts) AS last FROM events GROUP BY 1)"""
NOW = "2024-01-20"


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    told = tables.table(spark, sf_dir, "events").withColumn("pool", F.col("user_id") % 6)
    watched = F.col("event_type").isin("purchase", "error")
    week = (F.date_trunc("week", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 7 DAY")).alias("resets_at")
    seen = told.filter(watched).select("pool", F.col("ts").alias("at"), F.floor(F.col("value") / 3).cast("double").alias("percent"), week)
    uses = told.filter(~watched).select("pool", F.col("user_id").alias("session"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return seen, uses, told.groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("last_activity"))


@register(f"WITH {MEASURED} SELECT pool, session, round(percent, 6) AS percent, tokens, last AS last_activity FROM la JOIN ac USING (session)")
def measured_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user took of its pool's observed rises."""
    seen, uses, sessions = measured(spark, sf_dir)
    return shares.measured_lanes(shares.quota_chains(seen, ["pool"]), uses, sessions).withColumn("percent", F.round("percent", 6))


@register(
    f"""WITH {MEASURED}, k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY percent, session) AS i, count(*) OVER (PARTITION BY pool) AS n FROM la JOIN ac USING (session) WHERE last <= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AND percent IS NOT NULL),
  r AS (SELECT pool, avg(percent) FILTER (WHERE i * 2 BETWEEN n AND n + 2) AS low, min(percent) FILTER (WHERE i * 10 >= n * 9) AS high FROM k GROUP BY pool),
  p AS (SELECT DISTINCT pool, 3 + pool AS lanes FROM us), u AS (SELECT pool, arg_max(percent, (tm, percent)) AS used FROM j WHERE NOT stale GROUP BY pool),
  m AS (SELECT pool, lanes, used, lanes * low AS need_low, lanes * high AS need_high, greatest(0, 100 - used - CASE WHEN used = floor(used) THEN 0.5::DOUBLE ELSE 0 END) AS left_low, least(100, 100 - used + CASE WHEN used = floor(used) THEN 0.5::DOUBLE ELSE 0 END) AS left_high FROM p JOIN u USING (pool) LEFT JOIN r USING (pool))
  SELECT pool, lanes, used, round(need_low, 6) AS need_low, round(need_high, 6) AS need_high, left_low, left_high, CASE WHEN need_low IS NULL THEN 'unmeasured' WHEN need_high <= left_low THEN 'yes' WHEN need_low > left_high THEN 'no' ELSE 'maybe' END AS fits FROM m"""
)
def measured_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether planned lanes fit, from the pool's own observations to the answer in one chain of operators."""
    seen, uses, sessions = measured(spark, sf_dir)
    plans = uses.select("pool").distinct().withColumn("lanes", F.col("pool") + 3)
    told = shares.measured_forecast(seen, uses, sessions, plans, NOW)
    return told.withColumns({c: F.round(c, 6) for c in ("need_low", "need_high")})
