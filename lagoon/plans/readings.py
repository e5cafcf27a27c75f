"""Registered reads, pages, scopes, briefs and projections, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.operators import endings, reading, spans, turns, usage
from lagoon.plans.registry import HARNESS, PAIRS, REQUESTS, SESSIONS, TALK, TURNS, USED, given_spans, paired, register
from lagoon.sources import tables


@register(
    f"""WITH {SESSIONS}, u AS (SELECT harness, session, directory, launch, 0 AS store_rank FROM sessions WHERE launch = 'headless' UNION ALL SELECT harness, session, NULL, launch, 1 FROM sessions WHERE launch IS NULL UNION ALL SELECT harness, session, directory, NULL, 2 FROM sessions WHERE launch = 'interactive')
  SELECT * FROM u WHERE NOT (harness = 'opencode' AND store_rank >= 1)"""
)
def union_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stores with other columns each; the second one of a harness can't be read, so what comes later is withheld."""
    s = tables.order_sessions(spark, sf_dir).drop("parent", "last_activity")
    stores = [s.filter("launch = 'headless'"), s.filter("launch IS NULL").drop("directory"), s.filter("launch = 'interactive'").drop("launch")]
    failed = spark.createDataFrame([("opencode", 1)], "harness string, store_rank int")
    return reading.without_failed(reading.union_of_stores(stores), failed).select("harness", "session", "directory", "launch", "store_rank")


@register(
    f"""WITH d AS (SELECT s_suppkey AS k, '/work/r' || (s_nationkey % 4) || CASE WHEN s_suppkey % 2 = 0 THEN '/sub' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE '' END AS directory, CASE WHEN s_nationkey % 3 > 0 THEN 'repo' || (s_nationkey % 3) END AS repository, s_suppkey % 5 > 0 AS resolved FROM supplier),
  dd AS (SELECT directory, max(repository) AS repository, bool_or(resolved) AS resolved FROM d GROUP BY directory), s AS (SELECT o_orderkey AS session, '/work/r' || (o_custkey % 5) || CASE WHEN o_custkey % 2 = 0 THEN '/sub' ELSE '' END || CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE '' END AS directory FROM orders)
  SELECT session, directory, CASE WHEN repository = 'repo1' THEN 'in' WHEN repository IS NULL AND (directory = '/work/r4' OR starts_with(directory, '/work/r4/')) THEN 'in' WHEN NOT coalesce(resolved, false) THEN 'unresolved' ELSE 'out' END AS scope FROM s LEFT JOIN dd USING (directory)"""
)
def in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places named from keys: a repository's, or below one root."""

    def place(n: str, k: str) -> Column:
        return F.concat(F.lit("/work/r"), F.col(n).cast("string"), F.when(F.col(k) % 2 == 0, "/sub").otherwise(""), F.when(F.col(k) % 7 == 0, "x").otherwise(""))

    d = tables.table(spark, sf_dir, "supplier").withColumns({"n": F.col("s_nationkey") % 4, "k": F.col("s_suppkey")})
    repo = F.when(F.col("s_nationkey") % 3 > 0, F.concat(F.lit("repo"), (F.col("s_nationkey") % 3).cast("string")))
    known = d.groupBy(place("n", "k").alias("directory")).agg(F.max(repo).alias("repository"), F.bool_or(F.col("k") % 5 > 0).alias("resolved"))
    s = tables.table(spark, sf_dir, "orders").withColumns({"n": F.col("o_custkey") % 5, "k": F.col("o_custkey")}).select(F.col("o_orderkey").alias("session"), place("n", "k").alias("directory"))
    return reading.in_scope(s, known, "repo1", "/work/r4").select("session", "directory", "scope")


@register(f"WITH {TALK} SELECT harness, session, ordinal, length(text) AS chars, substring(text, 1, 30) AS text FROM talk")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.conversation_turns(spark, sf_dir).select("harness", "session", "ordinal", reading.preview(F.col("text"), 30).alias("p")).select("harness", "session", "ordinal", "p.*")


@register(
    f"""WITH {TALK}, c AS (SELECT harness, session, CASE WHEN session % 3 > 0 THEN session % 6 END AS before FROM talk GROUP BY ALL), g AS (SELECT t.* FROM talk t JOIN c ON t.harness = c.harness AND t.session = c.session WHERE before IS NULL OR ordinal < before),
  r AS (SELECT *, row_number() OVER (PARTITION BY harness, session ORDER BY ordinal DESC) AS n, count(*) OVER (PARTITION BY harness, session) AS a FROM g)
  SELECT harness, session, ordinal, min(ordinal) OVER (PARTITION BY harness, session) AS next, a > 2 AS more FROM r WHERE n <= 2"""
)
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns a page; a third of the sessions from their newest, the others from a cursor."""
    talk = tables.conversation_turns(spark, sf_dir)
    cursors = talk.select("harness", "session", F.when(F.col("session") % 3 > 0, F.col("session") % 6).alias("before")).distinct()
    return reading.history_page(talk, cursors, 2).select("harness", "session", "ordinal", "next", "more")


@register(
    f"""WITH {TALK}, p AS (SELECT *, (row_number() OVER (PARTITION BY harness, session ORDER BY ordinal DESC) - 1) // 2 AS page FROM talk)
  SELECT harness, session, count(*) FILTER (WHERE page < 2 AND contains(lower(text), 'the')) AS hits, min(page) FILTER (WHERE page < 2 AND contains(lower(text), 'the')) AS page, count(*) FILTER (WHERE page < 2) AS searched, bool_or(page >= 2) AS partial FROM p GROUP BY harness, session"""
)
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.history_search(tables.conversation_turns(spark, sf_dir), "THE", 2, 2)


@register(
    f"""WITH {TURNS}, k AS (SELECT session, ordinal, name FROM turns WHERE name IS NOT NULL), c AS (SELECT *, lag(name) OVER (PARTITION BY session ORDER BY ordinal) AS b FROM k),
  r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal DESC) AS n, count(*) OVER (PARTITION BY session) AS a FROM c WHERE b IS NULL OR b <> name) SELECT session, ordinal, name, greatest(0, a - 4) AS omitted FROM r WHERE n <= 4"""
)
def metadata_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.metadata_history(tables.event_turns(spark, sf_dir).select("session", "ordinal", "name"), ["session"], "name", 4)


@register(
    """WITH r AS (SELECT p_brand AS brand, p_partkey AS lane, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS a FROM part) SELECT brand, lane, greatest(0, a - 3) AS rest FROM r WHERE n <= 3"""
)
def first_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("lane"), "p_size")
    return reading.first_lanes(lanes, ["brand"], 3, [F.desc("p_size"), F.col("lane")]).select("brand", "lane", "rest")


@register(
    f"""WITH {REQUESTS}, w AS (SELECT session, CAST(sum(input + output) AS BIGINT) AS consumed FROM requests WHERE moment >= TIMESTAMP '1995-01-01' AND moment < TIMESTAMP '1996-01-01' GROUP BY session)
  SELECT session, consumed, row_number() OVER (ORDER BY consumed DESC, session) AS place FROM w ORDER BY place LIMIT 50"""
)
def largest_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the fifty sessions that consumed most in a year."""
    year = tables.line_requests(spark, sf_dir).filter("at >= '1995-01-01' AND at < '1996-01-01'")
    return spans.largest_shares(year.groupBy("session").agg(F.sum(F.col("input") + F.col("output")).alias("consumed")), 50)


@register(
    f"""WITH s AS (SELECT o_orderkey AS session, {HARNESS.format('o_custkey')} AS harness, 'title ' || (o_orderkey % 5000) || '-' || (o_custkey % 3) AS title FROM orders), w AS (SELECT DISTINCT 'title ' || (p_partkey % 6000) || '-' || (p_size % 3) AS title FROM part)
  SELECT title, count(session) AS matches, CASE WHEN count(session) = 1 THEN max(harness) END AS harness, CASE WHEN count(session) = 1 THEN max(session) END AS session FROM w LEFT JOIN s USING (title) GROUP BY title"""
)
def by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(a: Column, b: Column) -> Column:
        return F.concat(F.lit("title "), a.cast("string"), F.lit("-"), b.cast("string")).alias("title")

    orders = tables.table(spark, sf_dir, "orders")
    titles = orders.select(tables.harness_of("o_custkey").alias("harness"), F.col("o_orderkey").alias("session"), named(F.col("o_orderkey") % 5000, F.col("o_custkey") % 3))
    return reading.by_title(tables.order_sessions(spark, sf_dir), titles, tables.table(spark, sf_dir, "part").select(named(F.col("p_partkey") % 6000, F.col("p_size") % 3)))


@register(
    """WITH r AS (SELECT l_orderkey AS session, l_returnflag AS place, l_partkey || '.' || (l_suppkey % 40) || '.' || l_linenumber AS uuid FROM lineitem), b AS (SELECT session, place, uuid FROM r WHERE session % 3 = 0), h AS (SELECT DISTINCT place, uuid, session AS s FROM r),
  m AS (SELECT b.session, b.uuid, CASE WHEN h.s <> b.session THEN h.s END AS s FROM b LEFT JOIN h USING (place, uuid)) SELECT session, uuid, CASE WHEN count(DISTINCT s) = 1 THEN max(s) END AS predecessor, count(DISTINCT s) AS candidates FROM m GROUP BY session, uuid"""
)
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records; the lines of a third of the orders are boundaries, as a recording has both."""
    lines = tables.table(spark, sf_dir, "lineitem")
    records = lines.select(F.col("l_orderkey").alias("session"), F.col("l_returnflag").alias("place"), F.concat_ws(".", "l_partkey", F.col("l_suppkey") % 40, "l_linenumber").alias("uuid"))
    return reading.continuations(records.filter("session % 3 = 0"), records)


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, f AS (SELECT s.session, s.parent, r.ordinal AS entry, r.input // 10 AS content FROM sessions s JOIN requests r USING (session) WHERE parent IS NOT NULL), p AS (SELECT DISTINCT session AS parent, ordinal AS entry, input // 10 AS c FROM requests)
  SELECT session, entry, coalesce(bool_or(content = c), false) AS verified FROM f LEFT JOIN p USING (parent, entry) GROUP BY session, entry"""
)
def verified_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.line_requests(spark, sf_dir).select("session", F.col("ordinal").alias("entry"), F.floor(F.col("input") / 10).alias("content"))
    forks = held.join(tables.order_sessions(spark, sf_dir).filter("parent IS NOT NULL").select("session", "parent"), "session")
    return reading.verified_copies(forks, held)


@register(
    """WITH a AS (SELECT p_partkey AS event, p_brand AS kind, CASE WHEN p_size % 3 > 0 THEN p_name END AS uri, CASE WHEN p_size % 2 > 0 THEN p_type END AS path, p_size AS digest, p_partkey % 5 AS bytes FROM part), c AS (SELECT event AS use, kind, uri, path, digest, CASE WHEN event % 4 > 0 THEN bytes END AS bytes FROM a)
  SELECT event, use FROM a JOIN c ON a.kind = c.kind AND a.uri IS NOT DISTINCT FROM c.uri AND a.path IS NOT DISTINCT FROM c.path AND a.digest = c.digest AND a.bytes IS NOT DISTINCT FROM c.bytes"""
)
def artifact_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artifacts; addresses and paths are often null."""
    part = tables.table(spark, sf_dir, "part")
    made = part.select(
        F.col("p_partkey").alias("event"), F.col("p_brand").alias("kind"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("uri"),
        F.when(F.col("p_size") % 2 > 0, F.col("p_type")).alias("path"), F.col("p_size").alias("digest"), (F.col("p_partkey") % 5).alias("bytes"),
    )
    return reading.artifact_uses(made, made.withColumn("bytes", F.when(F.col("event") % 4 > 0, F.col("bytes"))))


@register(
    """WITH e AS (SELECT l_orderkey AS session, l_linenumber AS edit, CASE WHEN l_linenumber <> 5 THEN l_suppkey % 3 END AS call_id, CASE l_returnflag WHEN 'A' THEN 'runtime' WHEN 'N' THEN 'patch' ELSE 'tool' END AS origin FROM lineitem)
  SELECT session, edit, origin FROM e WHERE origin <> 'patch' OR call_id IS NULL OR NOT EXISTS (SELECT 1 FROM e r WHERE r.origin = 'runtime' AND r.session = e.session AND r.call_id = e.call_id)"""
)
def settled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("edit"), F.when(F.col("l_linenumber") != 5, F.col("l_suppkey") % 3).alias("call_id"),
        F.when(F.col("l_returnflag") == "A", "runtime").when(F.col("l_returnflag") == "N", "patch").otherwise("tool").alias("origin"),
    )
    return reading.settled_edits(edits).select("session", "edit", "origin")


@register(
    f"""WITH {PAIRS}, e AS (SELECT harness, session, max(ordinal) AS last FROM turns GROUP BY ALL), oc AS (SELECT harness, session, ordinal, row_number() OVER (PARTITION BY session ORDER BY ordinal DESC) AS n FROM pairs WHERE direction = 'call' AND pair IS NULL),
  c AS (SELECT harness, session, count(*) AS open_calls, array_to_string(list(ordinal ORDER BY n) FILTER (WHERE n <= 8), ',') AS handles FROM oc GROUP BY ALL), k AS (SELECT session // 3 AS session, count(*) FILTER (WHERE session % 2 = 0) AS open_children FROM e GROUP BY 1)
  SELECT e.harness, e.session, last, coalesce(open_calls, 0) AS open_calls, coalesce(handles, '') AS handles, coalesce(open_children, 0) AS open_children, u.n AS requests FROM e LEFT JOIN c ON e.session = c.session LEFT JOIN k ON e.session = k.session
  LEFT JOIN (SELECT session, count(*) AS n FROM turns WHERE kind = 'assistant' GROUP BY 1) u ON u.session = e.session"""
)
def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions; a user's children are those of three times its number, the even ones still open."""
    told = tables.event_turns(spark, sf_dir)
    ended = endings.endings(told, paired(spark, sf_dir))
    children = ended.select(F.floor(F.col("session") / 3).alias("parent"), (F.col("session") % 2 == 0).alias("open"))
    used = told.filter("kind = 'assistant'").groupBy("session").agg(F.count("*").alias("requests"))
    return reading.brief(ended, paired(spark, sf_dir), used, children).drop("facts")


@register(
    f"""WITH {SESSIONS}, e AS (SELECT parent, session, CASE WHEN launch = 'headless' THEN 'subagent' ELSE 'fork' END AS relation FROM sessions WHERE parent IS NOT NULL UNION ALL SELECT session, parent, 'parent' FROM sessions WHERE parent IS NOT NULL),
  k AS (SELECT parent AS root, session, min(relation) AS relation FROM e GROUP BY ALL UNION ALL SELECT session, session, 'root' FROM sessions)
  SELECT root, session, relation, 's' || (row_number() OVER (PARTITION BY root ORDER BY relation <> 'root', session) - 1) AS source FROM k"""
)
def workset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a root: its child and its parent."""
    s = tables.order_sessions(spark, sf_dir)
    down = s.filter("parent IS NOT NULL").select("parent", "session", F.when(F.col("launch") == "headless", "subagent").otherwise("fork").alias("relation"))
    up = down.select(F.col("session").alias("parent"), F.col("parent").alias("session"), F.lit("parent").alias("relation"))
    return reading.workset(s.select("session"), down.unionByName(up))


@register(
    f"""WITH {TALK}, t AS (SELECT harness, session, ordinal, kind, (row_number() OVER (PARTITION BY harness, session ORDER BY ordinal) - 1) // 3 AS lane FROM talk),
  a AS (SELECT *, count(*) FILTER (WHERE kind = 'operator') OVER (PARTITION BY harness, session ORDER BY ordinal) AS x FROM t WHERE kind IN ('operator', 'assistant')),
  s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY harness, session, x ORDER BY ordinal) AS n FROM a WHERE x > 0) WHERE n <= 2),
  st AS (SELECT harness, session, lane, min(ordinal) AS start FROM t GROUP BY ALL HAVING lane > 0), l AS (SELECT st.*, (SELECT max(x) FROM s WHERE s.harness = st.harness AND s.session = st.session AND n = 1 AND s.ordinal < start) AS x FROM st)
  SELECT l.harness, l.session, l.lane, s.ordinal FROM l JOIN s ON l.harness = s.harness AND l.session = s.session AND s.x BETWEEN greatest(1, l.x - 1) AND l.x AND s.ordinal < l.start"""
)
def lane_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns a lane."""
    talk = tables.conversation_turns(spark, sf_dir)
    numbered = turns.numbered(talk)
    return reading.lane_margin(talk, numbered.select("harness", "session", "ordinal", F.floor(F.col("position") / 3).alias("lane")))


@register(
    f"""WITH {TALK}, p AS (SELECT *, regexp_replace(coalesce(text, ''), '(^|\\n)(\\\\|## |=== |\\[… |tool: |artifact: )', '\\1\\\\\\2', 'g') AS plain FROM talk)
  SELECT harness, session, ordinal, '## ' || ordinal || ' ' || kind || chr(10) || plain AS projected, CAST(0 AS BIGINT) AS omitted FROM p"""
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No turn of these conversations reaches the byte bound; tests cut longer ones."""
    return reading.projection(tables.conversation_turns(spark, sf_dir)).select("harness", "session", "ordinal", "projected", "omitted")


@register(
    f"""WITH {TALK}, d AS (SELECT harness, session, ordinal, sha256('## ' || ordinal || ' ' || kind || chr(10) || regexp_replace(coalesce(text, ''), '(^|\\n)(\\\\|## |=== |\\[… |tool: |artifact: )', '\\1\\\\\\2', 'g')) AS d FROM talk)
  SELECT harness, session, count(*) AS turns, sha256(array_to_string(list(d ORDER BY ordinal), '')) AS digest FROM d GROUP BY harness, session"""
)
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.content_digest(reading.projection(tables.conversation_turns(spark, sf_dir)))


@register(
    f"""WITH {TALK}, t AS (SELECT harness, session, ordinal, (row_number() OVER (PARTITION BY harness, session ORDER BY ordinal) - 1) // 3 AS lane FROM talk), c AS (SELECT harness, session, count(*) AS n FROM talk GROUP BY ALL),
  src AS (SELECT 's' || session AS source, harness, session, n - session % 2 AS turns, CASE WHEN session % 5 < 3 THEN 'd' || (session + session % 2) END AS digest FROM c), nw AS (SELECT harness, session, n AS turns, 'd' || session AS digest FROM c WHERE session % 11 > 0),
  refs AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE '' END || 's' || (p_partkey % 400) || '#' || (p_size % 8) AS reference, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 3 AS BIGINT) END AS lane FROM part),
  r AS (SELECT *, CASE WHEN starts_with(reference, 's') THEN split_part(reference, '#', 1) END AS source, CASE WHEN starts_with(reference, 's') THEN CAST(split_part(reference, '#', 2) AS BIGINT) END AS ordinal FROM refs),
  m AS (SELECT r.reference, r.lane, src.harness, src.session, r.ordinal, r.source, t.ordinal AS there, t.lane AS tl, CASE WHEN src.session IS NULL THEN NULL WHEN nw.turns IS NULL THEN 'unreadable' WHEN nw.digest = src.digest THEN 'unchanged' WHEN nw.turns > src.turns THEN 'grown' ELSE 'changed' END AS state
    FROM r LEFT JOIN src ON r.source = src.source LEFT JOIN nw ON src.harness = nw.harness AND src.session = nw.session LEFT JOIN t ON t.harness = src.harness AND t.session = src.session AND t.ordinal = r.ordinal)
  SELECT reference, lane, harness, session, ordinal, state, CASE WHEN source IS NULL THEN 'malformed' WHEN session IS NULL THEN 'unknown-source' WHEN state IN ('changed', 'unreadable') THEN 'source-changed' WHEN there IS NULL THEN 'unknown' WHEN lane IS NOT NULL AND tl IS DISTINCT FROM lane THEN 'outside-lane' ELSE 'resolved' END AS status FROM m"""
)
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' numbers make references to turns of conversations, of which some are malformed, gone or in another lane."""
    talk = tables.conversation_turns(spark, sf_dir)
    lanes = turns.numbered(talk).select("harness", "session", "ordinal", F.floor(F.col("position") / 3).alias("lane"))
    count = talk.groupBy("harness", "session").agg(F.count("*").alias("n"))
    k = F.col("session")
    then = count.select(F.concat(F.lit("s"), k.cast("string")).alias("source"), "harness", "session", (F.col("n") - k % 2).alias("turns"), F.when(k % 5 < 3, F.concat(F.lit("d"), (k + k % 2).cast("string"))).alias("digest"))
    now = count.filter(k % 11 > 0).select("harness", "session", F.col("n").alias("turns"), F.concat(F.lit("d"), k.cast("string")).alias("digest"))
    part = tables.table(spark, sf_dir, "part")
    refs = part.select(
        F.concat(F.when(F.col("p_partkey") % 13 == 0, "x").otherwise(""), F.lit("s"), (F.col("p_partkey") % 400).cast("string"), F.lit("#"), (F.col("p_size") % 8).cast("string")).alias("reference"),
        F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") % 3).cast("long")).alias("lane"),
    )
    return reading.locate(refs, then, talk, lanes, now)


@register(
    f"""WITH {TURNS}, s AS (SELECT harness, session, max(ordinal) AS shown FROM turns WHERE kind IN ('operator', 'assistant') GROUP BY ALL)
  SELECT t.harness, t.session, max(ordinal) AS last, arg_max(pool, ordinal) AS type, count(*) FILTER (WHERE ordinal > coalesce(shown, -1)) AS trailing FROM turns t LEFT JOIN s ON t.harness = s.harness AND t.session = s.session GROUP BY t.harness, t.session"""
)
def trailing_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tables.event_turns(spark, sf_dir).withColumn("line", F.col("ordinal"))
    return reading.trailing_record(records.withColumn("type", F.col("pool")), records.filter("kind IN ('operator', 'assistant')"))


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, {USED} SELECT s.parent, s.session, s.parent || '/' || s.session AS name, coalesce(u.requests, 0) AS turns, u.input, CASE WHEN launch = 'headless' THEN 'assistant-close' END AS facts FROM sessions s LEFT JOIN used u USING (session) WHERE parent IS NOT NULL"""
)
def child_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after a customer's first as children, lines as their turns."""
    s = tables.order_sessions(spark, sf_dir)
    lines = tables.line_requests(spark, sf_dir)
    ended = s.select("session", F.when(F.col("launch") == "headless", "assistant-close").alias("facts"))
    return reading.child_view(s.filter("parent IS NOT NULL").select("parent", "session"), lines, usage.session_usage(lines).select("session", "input"), ended)


@register(
    f"""WITH {TALK}, p AS (SELECT *, '## ' || ordinal || ' ' || kind || chr(10) || regexp_replace(coalesce(text, ''), '(^|\\n)(\\\\|## |=== |\\[… |tool: |artifact: )', '\\1\\\\\\2', 'g') AS projected FROM talk)
  SELECT harness, session, name, count(*) AS lines, CAST(sum(strlen(projected)) AS BIGINT) AS bytes FROM (SELECT *, unnest(CASE WHEN kind IN ('operator', 'assistant') THEN ['context.md', 'trace.md'] ELSE ['trace.md'] END) AS name FROM p) GROUP BY ALL"""
)
def bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two text views of each conversation would hold."""
    made = reading.bundles(reading.projection(tables.conversation_turns(spark, sf_dir))).filter("name <> 'json'")
    return made.groupBy("harness", "session", "name").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value").cast("long")).alias("bytes"))


@register(
    f"""WITH {REQUESTS}, {SESSIONS}, b AS (SELECT session, min(moment) AS started FROM requests GROUP BY session), s AS (SELECT s.session, last_activity, CASE WHEN s.session % 5 > 0 THEN started END AS started FROM sessions s LEFT JOIN b USING (session))
  SELECT session FROM s WHERE (last_activity IS NULL OR last_activity >= TIMESTAMP '1994-01-01') AND (started IS NULL OR started < TIMESTAMP '1995-01-01')"""
)
def window_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the sessions don't say when they began."""
    began = tables.line_requests(spark, sf_dir).groupBy("session").agg(F.min("at").alias("started"))
    given = tables.order_sessions(spark, sf_dir).join(began, "session", "left").withColumn("started", F.when(F.col("session") % 5 > 0, F.col("started")))
    return spans.may_hold(given, "1994-01-01", "1995-01-01").select("session")


@register(
    f"""WITH {REQUESTS}, r AS (SELECT session, ordinal, CASE WHEN input % 7 > 0 THEN moment END AS moment FROM requests), n AS (SELECT *, last_value(moment IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal) AS a, first_value(moment IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM r),
  u AS (SELECT * FROM n WHERE moment IS NULL), sp(span_id, f, t) AS (VALUES (1, TIMESTAMP '1993-01-01', TIMESTAMP '1994-06-01'), (2, TIMESTAMP '1994-01-01', TIMESTAMP '1995-01-01'), (3, NULL, TIMESTAMP '1992-06-01'), (4, TIMESTAMP '1998-01-01', NULL)),
  e AS (SELECT u.session, u.ordinal, span_id, (a IS NULL OR t IS NULL OR a < t) AND (b IS NULL OR f IS NULL OR b >= f) AS may, coalesce((f IS NULL OR a >= f) AND (t IS NULL OR b < t), false) AS sure FROM u, sp)
  SELECT span_id, count(*) AS unplaced FROM e WHERE may GROUP BY span_id UNION ALL SELECT -1, count(*) FROM (SELECT session, ordinal FROM e GROUP BY ALL HAVING NOT bool_or(sure)) HAVING count(*) > 0"""
)
def ambiguous_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh request by input has no time; the times of its neighbours say which spans may hold it."""
    lines = tables.line_requests(spark, sf_dir).withColumn("at", F.when(F.col("input") % 7 > 0, F.col("at")))
    return spans.ambiguous(lines, given_spans(spark), ["session"])
