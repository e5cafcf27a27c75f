"""Registered queries that divide consumption among work: layers, selections, time elsewhere and inherited time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.operators import intervals, partition, works
from lagoon.plans.registry import register
from lagoon.sources import tables

TIER = "CASE {} WHEN 0 THEN 'bound' WHEN 1 THEN 'matched' ELSE 'estimated' END"


def layered(before: str) -> str:
    """CTEs up to ``dv``, every layer's parts, from ``sp`` (k, work, f, t, tier, basis as numbers) and ``rq`` (k, moment, input, output, ew, et, gone) of ``before``."""
    return f"""{before},
  ed AS (SELECT k, f AS e FROM sp UNION SELECT k, t FROM sp WHERE t IS NOT NULL), ks AS (SELECT k FROM sp UNION SELECT k FROM rq),
  sg AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY e) AS segment, e AS a, lead(e) OVER (PARTITION BY k ORDER BY e) AS b FROM ed UNION ALL SELECT ks.k, 0, NULL, min(e) FROM ks LEFT JOIN ed USING (k) GROUP BY ks.k),
  c1 AS (SELECT sg.k, segment, work, min(tier * 10 + basis) AS ev FROM sg JOIN sp ON sg.k = sp.k AND sp.f <= sg.a AND (sp.t IS NULL OR sg.b <= sp.t) GROUP BY ALL),
  c2 AS (SELECT k, segment, list({{'work': work, 'tier': {TIER.format('ev // 10')}, 'basis': CASE ev % 10 WHEN 0 THEN 'span' ELSE 'event-window' END}} ORDER BY work) AS covers FROM c1 GROUP BY k, segment),
  c3 AS (SELECT sg.*, coalesce(covers, []) AS covers, coalesce(len(covers), 0) AS n FROM sg LEFT JOIN c2 USING (k, segment)),
  cv AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'overlap' WHEN min(segment) FILTER (WHERE n > 0) OVER (PARTITION BY k) IS NULL OR segment < min(segment) FILTER (WHERE n > 0) OVER (PARTITION BY k) THEN 'before-first-item'
    WHEN segment > max(segment) FILTER (WHERE n > 0) OVER (PARTITION BY k) THEN 'after-last-item' ELSE 'between-items' END AS reason,
    first(CASE WHEN n = 1 THEN covers[1] END IGNORE NULLS) OVER (PARTITION BY k ORDER BY segment ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM c3),
  pl AS (SELECT rq.*, cv.segment, covers, n, reason, nx FROM rq LEFT JOIN cv ON cv.k = rq.k AND rq.moment IS NOT NULL AND (a IS NULL OR moment >= a) AND (b IS NULL OR moment < b)),
  ow AS (SELECT *, CASE WHEN n = 1 THEN covers[1] END AS al, CASE WHEN n = 0 AND ew IS NOT NULL AND NOT gone THEN {{'work': ew, 'tier': et, 'basis': 'working-stretch'}} END AS su, n = 0 AND ew IS NOT NULL AND gone AS lost FROM pl),
  lo AS (SELECT k, 'conserving' AS layer, segment, [al] AS owners, CASE WHEN n = 1 THEN NULL ELSE reason END AS reason, moment, input, output FROM ow
    UNION ALL SELECT k, 'estimated', segment, [coalesce(al, su)], CASE WHEN coalesce(al, su) IS NULL THEN CASE WHEN lost THEN 'elsewhere' ELSE reason END END, moment, input, output FROM ow
    UNION ALL SELECT k, 'even', segment, CASE WHEN n > 1 THEN list_transform(covers, lambda c: {{'work': c.work, 'tier': c.tier, 'basis': 'even'}}) ELSE [al] END, CASE WHEN n > 0 THEN NULL ELSE reason END, moment, input, output FROM ow
    UNION ALL SELECT k, 'following', segment, [x], CASE WHEN x IS NULL THEN CASE WHEN lost THEN 'elsewhere' ELSE reason END END, moment, input, output
      FROM (SELECT *, coalesce(al, su, CASE WHEN reason = 'between-items' AND NOT lost AND nx IS NOT NULL THEN {{'work': nx.work, 'tier': nx.tier, 'basis': 'following'}} END) AS x FROM ow)),
  sm AS (SELECT k, layer, segment, owners, CASE WHEN moment IS NULL THEN 'request-time-unrecorded' ELSE reason END AS reason, count(*) AS requests, sum(input) AS input, sum(output) AS output FROM lo GROUP BY ALL),
  ex AS (SELECT k, layer, segment, reason, requests, input, output, len(owners) AS m, unnest(owners) AS o, unnest(range(len(owners))) AS i FROM sm),
  dv AS (SELECT k, layer, segment, o.work AS work, o.tier AS tier, o.basis AS basis, reason, requests, CAST(input // m + (i < input % m)::BIGINT AS BIGINT) AS input, CAST(output // m + (i < output % m)::BIGINT AS BIGINT) AS output FROM ex)"""


#: A customer's orders are spans of work of 200 days, its pending orders events 300 days on; lines are requests, some with an estimate, some made elsewhere.
DIVIDED = layered(
    """sp AS (SELECT o_custkey AS k, o_orderpriority AS work, o_orderdate AS f, o_orderdate + INTERVAL 200 DAY AS t, CAST(o_orderkey % 3 AS INT) AS tier, 0 AS basis FROM orders
    UNION ALL SELECT o_custkey, 'pending', min(o_orderdate) + INTERVAL 300 DAY, max(o_orderdate) + INTERVAL 300 DAY + INTERVAL 1 MICROSECOND, CAST(max(o_orderkey % 3) AS INT), 1 FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey),
  rq AS (SELECT o_custkey AS k, CASE WHEN l_linenumber < 7 THEN l_shipdate END AS moment, CAST(l_quantity AS BIGINT) AS input, l_partkey % 1000 AS output, CASE WHEN l_linenumber % 2 = 0 THEN 'w' || l_linestatus END AS ew, 'matched' AS et, l_returnflag = 'R' AS gone FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
)


def divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    tier = F.element_at(F.array(*[F.lit(t) for t in works.TIERS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    spans = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("work"), F.col("o_orderdate").alias("from"), (F.col("o_orderdate") + F.expr("INTERVAL 200 DAY")).alias("to"), tier.alias("tier"))
    events = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("pending").alias("work"), (F.col("o_orderdate") + F.expr("INTERVAL 300 DAY")).alias("at"), tier.alias("tier"))
    lines = tables.table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    guess = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("w"), "l_linestatus"))
    requests = lines.select(
        F.col("o_custkey").alias("k"), F.when(F.col("l_linenumber") < 7, F.col("l_shipdate")).alias("at"), F.col("l_quantity").cast("long").alias("input"), (F.col("l_partkey") % 1000).alias("output"),
        guess.alias("ew"), F.when(guess.isNotNull(), "matched").alias("et"), (F.col("l_returnflag") == "R").alias("gone"),
    )
    return works.divide(spans, events, requests, ["k"], ("input", "output"), ("ew", "et"), away="gone")


@register(f"WITH {DIVIDED} SELECT layer, work, tier, basis, reason, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM dv GROUP BY ALL")
def attribution_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by tier and basis and remainders by reason, in the conserving, estimated, even and following layers."""
    return works.shares(divided(spark, sf_dir).withColumn("k", F.lit(0)), [], ("input", "output"))


@register(f"WITH {DIVIDED} SELECT * FROM dv")
def attribution_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's part in each layer; every layer adds up to the whole."""
    return divided(spark, sf_dir)


@register(
    f"""WITH {DIVIDED}, s AS (SELECT k, layer, CAST(coalesce(sum(input) FILTER (WHERE work IN ('1-URGENT', 'pending')), 0) AS BIGINT) AS figure, CAST(coalesce(sum(input) FILTER (WHERE work NOT IN ('1-URGENT', 'pending')), 0) AS BIGINT) AS unselected,
    CAST(coalesce(sum(input) FILTER (WHERE work IS NULL), 0) AS BIGINT) AS unattributed, list(DISTINCT CASE WHEN work IS NULL THEN reason WHEN work NOT IN ('1-URGENT', 'pending') THEN 'unselected-item' END) FILTER (WHERE work IS NULL OR work NOT IN ('1-URGENT', 'pending')) AS r FROM dv GROUP BY k, layer)
  SELECT k, layer, figure, unselected, unattributed, array_to_string(list_sort(list_concat(coalesce(r, []), CASE WHEN k % 10 = 3 THEN ['recorded-total-not-splittable'] ELSE [] END)), ',') AS reasons FROM s"""
)
def attribution_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of two items: what they hold, what other items do, what no one does, and why; every tenth total has more than its requests."""
    parts = divided(spark, sf_dir)
    chosen = spark.createDataFrame([("1-URGENT",), ("pending",)], "work string")
    totals = parts.filter("layer = 'conserving'").groupBy("k").agg((F.sum("input") + (F.col("k") % 10 == 3).cast("int")).alias("total"))
    return works.selection(parts, chosen, totals, ["k"], "input").withColumn("reasons", F.array_join("reasons", ","))


#: A user's events: each holds until the next as an owned stretch; views are estimates, purchases leave the repository until the next signup or click.
OWNED = """ev AS (SELECT user_id AS session, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
  ow AS (SELECT session, ts AS f, nx AS t, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS work, CASE event_type WHEN 'view' THEN 'working-stretch' WHEN 'click' THEN 'span' END AS basis, CASE WHEN event_type NOT IN ('view', 'click') THEN 'between-items' END AS reason FROM ev WHERE nx IS NULL OR ts < nx)"""


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    told = tables.dealt(spark, sf_dir, "events", "user_id").withColumn("to", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    mine = kind.isin("view", "click")
    return told.select(
        F.col("user_id").alias("session"), F.col("ts").alias("from"), "to", F.when(mine, kind).alias("work"), F.when(mine, "matched").alias("tier"),
        F.when(kind == "view", "working-stretch").when(kind == "click", "span").alias("basis"), F.when(~mine, "between-items").alias("reason"),
    ).filter("to IS NULL OR from < to")


@register(
    f"""WITH {OWNED}, ds AS (SELECT session, ts, lead(ts) OVER (PARTITION BY session ORDER BY ts, d) AS nx, d FROM (SELECT user_id AS session, ts + INTERVAL 2 HOUR AS ts, CASE WHEN event_type = 'purchase' THEN '/tmp' ELSE '/repo/sub' END AS d FROM events)),
  aw AS (SELECT session, ts AS f, nx AS t FROM ds WHERE d = '/tmp' AND (nx IS NULL OR ts < nx)), es AS (SELECT * FROM ow WHERE basis = 'working-stretch'),
  ct AS (SELECT session, f AS c FROM aw UNION SELECT session, t FROM aw WHERE t IS NOT NULL), p1 AS (SELECT session, f, t, f AS c FROM es UNION SELECT e.session, e.f, e.t, ct.c FROM es e JOIN ct ON ct.session = e.session AND ct.c > e.f AND (e.t IS NULL OR ct.c < e.t)),
  p2 AS (SELECT session, f, c AS a, coalesce(lead(c) OVER (PARTITION BY session, f ORDER BY c), t) AS b FROM p1), p3 AS (SELECT p2.*, EXISTS (SELECT 1 FROM aw WHERE aw.session = p2.session AND aw.f <= p2.a AND (aw.t IS NULL OR p2.a < aw.t)) AS gone FROM p2),
  al AS (SELECT session, 'elsewhere' AS reason, NULL AS work, a, b FROM p3 WHERE gone UNION ALL SELECT session, NULL, 'view', a, b FROM p3 WHERE NOT gone UNION ALL SELECT session, reason, work, f, t FROM ow WHERE basis IS NULL OR basis <> 'working-stretch')
  SELECT session, reason, work, CAST(sum(epoch_us(b) - epoch_us(a)) AS BIGINT) AS us, count(*) FILTER (WHERE b IS NULL) AS open FROM al GROUP BY ALL"""
)
def elsewhere_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each owner held a session, estimates only while it was in the repository."""
    away = F.when(F.col("event_type") == "purchase", "/tmp").otherwise("/repo/sub")
    places = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("at"), away.alias("directory"))
    cut = intervals.cut_elsewhere(owned(spark, sf_dir), intervals.elsewhere(places, ["session"], "/repo"), ["session"])
    return held(cut)


def held(cut: DataFrame) -> DataFrame:
    lasts = intervals.micros(F.col("to")) - intervals.micros(F.col("from"))
    return cut.groupBy("session", "reason", "work").agg(F.sum(lasts).alias("us"), F.count_if(F.col("to").isNull()).alias("open"))


PARENT = "CASE WHEN {0} % 3 <> 0 THEN {0} - {0} % 3 WHEN {0} % 9 <> 0 THEN {0} - {0} % 9 END"
HOLDS = "{0}.session = {1} AND {0}.f <= el.a AND ({0}.t IS NULL OR el.a < {0}.t)"


@register(
    f"""WITH {OWNED}, un AS (SELECT session, p1, {PARENT.format('p1')} AS p2 FROM (SELECT session, {PARENT.format('session')} AS p1 FROM (SELECT DISTINCT session FROM ow))),
  cu AS (SELECT session, f AS c FROM ow UNION SELECT session, t FROM ow WHERE t IS NOT NULL), ct AS (SELECT un.session, p1, p2, c FROM un JOIN cu ON cu.session = un.session UNION SELECT un.session, p1, p2, c FROM un JOIN cu ON cu.session = p1 UNION SELECT un.session, p1, p2, c FROM un JOIN cu ON cu.session = p2),
  el AS (SELECT session, p1, p2, c AS a, lead(c) OVER (PARTITION BY session ORDER BY c) AS b FROM ct),
  j AS (SELECT el.session, el.a, el.b, x.work AS w0, x.reason, y.work AS w1, y.session IS NOT NULL AS there, z.work AS w2 FROM el JOIN ow x ON {HOLDS.format('x', 'el.session')} LEFT JOIN ow y ON {HOLDS.format('y', 'el.p1')} LEFT JOIN ow z ON {HOLDS.format('z', 'el.p2')}),
  o AS (SELECT session, a, b, coalesce(w0, w1, CASE WHEN there THEN w2 END) AS work, w0 IS NULL AND coalesce(w1, CASE WHEN there THEN w2 END) IS NOT NULL AS inherited, reason FROM j)
  SELECT session, CASE WHEN work IS NULL THEN reason END AS reason, work, inherited, CAST(sum(epoch_us(coalesce(b, TIMESTAMP '2030-01-01')) - epoch_us(a)) AS BIGINT) AS us FROM o GROUP BY ALL"""
)
def inherited_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a child leaves unattributed goes to the owner of the same time of its parent or grandparent; open ends count until 2030."""
    mine = owned(spark, sf_dir)
    s = F.col("session")
    lineage = mine.select("session").distinct().withColumn("parent", F.when(s % 3 != 0, s - s % 3).when(s % 9 != 0, s - s % 9))
    known = lineage.select(s.alias("k"))
    lineage = lineage.join(known, F.col("parent") == F.col("k"), "left").select("session", F.col("k").alias("parent"))
    got = intervals.inherit(mine, lineage).withColumn("inherited", F.coalesce(F.col("basis") == "inherited", F.lit(False)))
    until = F.coalesce("to", F.lit("2030-01-01").cast("timestamp_ntz"))
    return got.groupBy("session", "reason", "work", "inherited").agg(F.sum(intervals.micros(until) - intervals.micros(F.col("from"))).alias("us"))


#: A user's views are requests, in stretches of eight hours; signups begin stays, every fifth purchase is a commit it makes, clicks are edits of four lines that commits may hold.
PARTED = layered(
    """e AS (SELECT user_id AS k, ts, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events), cm AS (SELECT 'p' || event_id AS sha, k, ts, n FROM e WHERE event_type = 'purchase' AND n % 5 = 0),
  st AS (SELECT k, ts AS f, lead(ts) OVER (PARTITION BY k ORDER BY ts, event_id) AS t, CASE WHEN event_id % 4 > 0 THEN '/w' || event_id % 3 END AS place FROM e WHERE event_type = 'signup'),
  mt AS (SELECT x.k, x.ts, cm.sha FROM e x JOIN cm ON abs(x.n - cm.n) <= 2 AND cm.ts >= x.ts - INTERVAL 1 HOUR AND cm.ts <= x.ts + INTERVAL 1 DAY WHERE event_type = 'click' AND x.n % 3 = 0
    QUALIFY row_number() OVER (PARTITION BY x.event_id ORDER BY abs(x.n - cm.n), abs(epoch_us(cm.ts) - epoch_us(x.ts)), sha) = 1),
  md AS (SELECT cm.k, sha, cm.ts, f, t, place FROM cm JOIN st ON st.k = cm.k AND st.f <= cm.ts AND (st.t IS NULL OR cm.ts < st.t) AND place IS NOT NULL),
  ss AS (SELECT k, sha AS work, coalesce(max(ts) OVER (PARTITION BY k, f ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 MICROSECOND, f) AS f, ts + INTERVAL 1 MICROSECOND AS t FROM md
    UNION ALL SELECT k, 'uncommitted:' || place, max(ts) + INTERVAL 1 MICROSECOND, t FROM md GROUP BY k, f, t, place HAVING t IS NULL OR max(ts) + INTERVAL 1 MICROSECOND < t),
  ev AS (SELECT k, ts, sha AS work, 0 AS tier FROM cm UNION ALL SELECT k, ts, sha, 1 FROM mt),
  sp AS (SELECT k, work, f, t, 1 AS tier, 0 AS basis FROM ss UNION ALL SELECT k, work, min(ts), max(ts) + INTERVAL 1 MICROSECOND, max(tier), 1 FROM ev GROUP BY k, work),
  r0 AS (SELECT k, epoch_us(ts) // 28800000000 AS stretch, CASE WHEN n % 17 > 0 THEN ts END AS moment, n AS input, n + 1 AS output, event_id % 7 = 0 AS gone FROM e WHERE event_type = 'view'),
  cu AS (SELECT DISTINCT r0.k, cm.ts, sha FROM r0 JOIN cm ON r0.moment >= cm.ts - INTERVAL 30 MINUTE AND r0.moment <= cm.ts + INTERVAL 30 MINUTE WHERE NOT gone),
  b0 AS (SELECT k, stretch, min(moment) AS t FROM r0 WHERE moment IS NOT NULL GROUP BY ALL), mk AS (SELECT k, ts, work, min(tier) AS tier FROM (SELECT * FROM ev UNION ALL SELECT k, ts, sha, 2 FROM cu) GROUP BY ALL),
  ms AS (SELECT mk.*, coalesce((SELECT max(stretch) FROM b0 WHERE b0.k = mk.k AND b0.t <= mk.ts), (SELECT min(stretch) FROM b0 WHERE b0.k = mk.k)) AS stretch FROM mk),
  rg AS (SELECT r0.*, coalesce((SELECT arg_min({'work': work, 'tier': tier}, (ms.ts, work)) FROM ms WHERE ms.k = r0.k AND ms.stretch = r0.stretch AND ms.ts >= r0.moment), (SELECT arg_max({'work': work, 'tier': tier}, (ms.ts, work)) FROM ms WHERE ms.k = r0.k AND ms.stretch = r0.stretch AND ms.ts < r0.moment)) AS g FROM r0),
  rq AS (SELECT k, moment, input, output, g.work AS ew, CASE g.tier WHEN 0 THEN 'bound' WHEN 1 THEN 'matched' ELSE 'estimated' END AS et, gone FROM rg)"""
)
KEPT = "(layer = 'estimated' AND NOT (work IS NULL AND reason = 'overlap')) OR (layer = 'even' AND basis = 'even')"


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    told = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", "event_type", n.alias("n"))
    four = F.sequence(F.col("n"), F.col("n") + 3).alias("digests")
    made = told.filter((kind == "purchase") & (F.col("n") % 5 == 0)).withColumn("sha", F.concat(F.lit("p"), F.col("event_id").cast("string")))
    signups = told.filter(kind == "signup").withColumn("to", F.lead("ts").over(Window.partitionBy("session").orderBy("ts", "event_id")))
    stays = signups.select("session", F.col("ts").alias("from"), "to", F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("/w"), (F.col("event_id") % 3).cast("string"))).alias("place"))
    requests = told.filter(kind == "view").select(
        "session", F.expr("unix_micros(cast(ts AS timestamp)) div 28800000000").alias("stretch"), F.when(F.col("n") % 17 > 0, F.col("ts")).alias("at"), F.col("n").alias("input"), (F.col("n") + 1).alias("output"), (F.col("event_id") % 7 == 0).alias("away")
    )
    edits = told.filter((kind == "click") & (F.col("n") % 3 == 0)).select(F.col("event_id").alias("edit"), "session", F.col("ts").alias("at"), four)
    commits = made.select("sha", F.col("ts").alias("author"), four)
    return partition.session_partition(requests, stays, made.select("session", F.col("ts").alias("at"), "sha"), edits, commits, ("input", "output"), after_s=86_400)


@register(f"WITH {PARTED} SELECT k AS session, segment, work, tier, basis, reason, requests, input, output FROM dv WHERE {KEPT}")
def session_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions divided over commits from their own commits, edits, stays and what was committed close by."""
    return parted(spark, sf_dir)


@register(
    f"""WITH {PARTED}, v AS (SELECT *, CASE WHEN work IS NULL THEN 'unattributed' WHEN starts_with(work, 'uncommitted:') THEN 'uncommitted' WHEN CAST(substr(work, 2) AS BIGINT) % 2 = 0 THEN 'commit' ELSE 'unselected' END AS share FROM dv WHERE {KEPT})
  SELECT share, CASE share WHEN 'unattributed' THEN reason WHEN 'unselected' THEN NULL ELSE work END AS work, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM v GROUP BY ALL"""
)
def usage_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every second commit cost, and where the rest of the whole went."""
    chosen = tables.table(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("sha"))
    return partition.usage_by_change(parted(spark, sf_dir), chosen, ("input", "output"))
