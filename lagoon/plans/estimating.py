"""Registered price and change queries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.operators import changes, estimates, turns
from lagoon.plans.registry import GAPS, IDLE_MS, REQUESTS, SESSIONS, TURNS, register
from lagoon.sources import tables

#: Parts as price rows: some of a person's, some fetched, with aliases and validities.
ROWS = """rows_ AS (SELECT 'm' || (p_partkey % 700) AS model, CASE WHEN p_size % 3 = 0 THEN ['a' || p_size] END AS aliases, make_timestamp(2020 + p_size % 4, 1, 1, 0, 0, 0) AS f, CASE WHEN p_size % 2 = 0 THEN make_timestamp(2021 + p_size % 5, 1, 1, 0, 0, 0) END AS u,
  CAST(p_size AS BIGINT) - 3 AS price, p_partkey FROM part)"""


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return tables.table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), (F.col("p_partkey") % 700).cast("string")).alias("model"),
        F.when(size % 3 == 0, F.array(F.concat(F.lit("a"), size.cast("string")))).alias("aliases"),
        F.make_timestamp_ntz(2020 + size % 4, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("from"),
        F.when(size % 2 == 0, F.make_timestamp_ntz(2021 + size % 5, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("until"),
        (size.cast("long") - 3).alias("price"),
        "p_partkey",
    )


@register(
    f"""WITH {ROWS}, c AS (SELECT * FROM rows_ WHERE p_partkey < 100), g AS (SELECT * FROM rows_ WHERE p_partkey >= 100), n AS (SELECT unnest([model] || coalesce(aliases, [])) AS name FROM c),
  t AS (SELECT DISTINCT model, f FROM (SELECT model, f, unnest([model] || coalesce(aliases, [])) AS name FROM g) WHERE name IN (SELECT name FROM n))
  SELECT model, f AS "from", u AS until, price FROM c UNION ALL SELECT model, f, u, price FROM g WHERE (model, f) NOT IN (SELECT (model, f) FROM t)"""
)
def price_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred parts as a person's rows, the others as fetched."""
    rows = price_rows(spark, sf_dir)
    return estimates.over(rows.filter("p_partkey < 100").drop("p_partkey"), rows.filter("p_partkey >= 100").drop("p_partkey")).drop("aliases")


@register(
    f"""WITH {ROWS}, o AS (SELECT model, f, CASE WHEN price < 0 THEN 'negative-price' WHEN u <= f THEN 'empty-validity' END AS reason FROM rows_), e AS (SELECT model, f, u, unnest([model] || coalesce(aliases, [])) AS name FROM rows_),
  w AS (SELECT *, max(coalesce(u, TIMESTAMP '9999-12-31')) OVER (PARTITION BY name ORDER BY f NULLS FIRST, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM e)
  SELECT reason, count(*) AS rows FROM (SELECT model, f, reason FROM o WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT model, f, 'overlapping-validity' FROM w WHERE e IS NOT NULL AND (f IS NULL OR f < e) AND model NOT IN (SELECT model FROM e GROUP BY name, model, f HAVING count(*) > 1)) GROUP BY reason"""
)
def price_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are refused for each reason; models with two rows of one date are left to a test, as their order isn't defined."""
    rows = price_rows(spark, sf_dir)
    each = rows.select("model", "from", F.explode(estimates.names_of(rows)).alias("name"))
    twice = each.groupBy("name", "model", "from").count().filter("count > 1").select("model").distinct()
    found = estimates.refusals(rows, ["price"])
    kept = found.filter("reason <> 'overlapping-validity'").unionByName(found.filter("reason = 'overlapping-validity'").join(twice, "model", "left_anti"))
    return kept.groupBy("reason").agg(F.count("*").alias("rows"))


@register(
    f"""WITH {SESSIONS}, r AS (SELECT session, directory AS plan, CASE launch WHEN 'headless' THEN 'api' WHEN 'interactive' THEN 'subscription' END AS terms, session % 9 = 0 AS partial FROM sessions), p(plan, rule) AS (VALUES ('1-URGENT', 'subscription'), ('5-LOW', 'api'))
  SELECT session, plan, CASE WHEN partial THEN 'unestablished' ELSE coalesce(rule, terms, 'unestablished') END AS terms FROM r LEFT JOIN p USING (plan)"""
)
def resolved_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as plans, two of them with a rule; every ninth recording was read in part."""
    records = tables.order_sessions(spark, sf_dir).select(
        "session", F.col("directory").alias("plan"), F.when(F.col("launch") == "headless", "api").when(F.col("launch") == "interactive", "subscription").alias("terms"), (F.col("session") % 9 == 0).alias("partial")
    )
    rules = spark.createDataFrame([("1-URGENT", "subscription"), ("5-LOW", "api")], "plan string, terms string")
    return estimates.resolved_billing(records, rules).select("session", "plan", "terms")


@register(
    f"""WITH {REQUESTS}, p AS (SELECT session, CASE WHEN model <> 'RF' THEN input * 3 + coalesce(cache_write, 0) END AS low, CASE WHEN model <> 'RF' THEN input * 3 + coalesce(cache_write, 0) * CASE WHEN reasoning > 3 THEN 2 ELSE 1 END END AS high, CASE WHEN model = 'RF' THEN 'unlisted-model' WHEN cache_write IS NULL THEN 'missing-counter' END AS reason FROM requests),
  s AS (SELECT session, count(low) AS priced, coalesce(sum(low), 0) AS lo, coalesce(sum(high), 0) AS hi, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), ','), '') AS reasons FROM p GROUP BY session)
  SELECT session, priced, CASE WHEN priced > 0 AND lo = hi THEN CAST(lo AS BIGINT) END AS amount, CASE WHEN priced > 0 AND lo <> hi THEN CAST(lo AS BIGINT) END AS at_least, CASE WHEN priced > 0 AND lo <> hi THEN CAST(hi AS BIGINT) END AS at_most, reasons FROM s"""
)
def estimate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines priced at three a token, writes between one and two; one model isn't listed."""
    listed, written = F.col("model") != "RF", F.coalesce("cache_write", F.lit(0))
    parts = tables.line_requests(spark, sf_dir).select(
        "session", F.when(listed, F.col("input") * 3 + written).alias("low"), F.when(listed, F.col("input") * 3 + written * F.when(F.col("reasoning") > 3, 2).otherwise(1)).alias("high"),
        F.when(~listed, "unlisted-model").when(F.col("cache_write").isNull(), "missing-counter").alias("reason"),
    )
    return estimates.estimate_sum(parts, ["session"])


@register(
    f"""WITH {REQUESTS}, f AS (SELECT session, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_write) AS BIGINT) AS cache_write FROM requests GROUP BY session), s AS (SELECT session, CAST(sum(input) AS BIGINT) AS i, CAST(sum(cache_write) AS BIGINT) AS w FROM requests WHERE model <> 'NO' GROUP BY session),
  x AS (SELECT session, unnest(['input', 'cache_write']) AS counter, unnest([input, cache_write]) AS whole, unnest([coalesce(i, 0), coalesce(w, 0)]) AS shared FROM f LEFT JOIN s USING (session))
  SELECT session, counter, whole, shared, whole - shared AS "left", CASE WHEN shared < whole THEN 'incomplete-attribution' END AS reason FROM x WHERE whole IS NOT NULL"""
)
def covered_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's figure against the shares of its models but one."""
    lines = tables.line_requests(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("input", "cache_write")]
    return estimates.covered_figure(lines.groupBy("session").agg(*sums), lines.filter("model <> 'NO'").groupBy("session", "model").agg(*sums), ["session"], ["input", "cache_write"])


@register(
    """WITH r AS (SELECT l_returnflag || l_linestatus AS model, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY 1 UNION ALL SELECT 'zero', 0), t(model, rate) AS (VALUES ('AF', 3), ('AF', 5), ('NO', 4), ('NO', 4), ('RF', 2), ('RF', NULL)),
  s AS (SELECT model, min(rate) AS lo, max(rate) AS hi, count(*) FILTER (WHERE rate IS NULL) AS none FROM t GROUP BY model)
  SELECT model, tokens, CASE WHEN tokens = 0 THEN 0 WHEN lo IS NOT NULL AND none = 0 THEN tokens * lo END AS low, CASE WHEN tokens = 0 THEN 0 WHEN lo IS NOT NULL AND none = 0 THEN tokens * hi END AS high,
  CASE WHEN tokens = 0 THEN NULL WHEN lo IS NULL THEN 'unlisted-model' WHEN none > 0 THEN 'missing-price' WHEN lo <> hi THEN 'rate-not-established' END AS reason FROM r LEFT JOIN s USING (model)"""
)
def rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = tables.line_requests(spark, sf_dir).groupBy("model").agg(F.sum("input").alias("tokens")).unionByName(spark.createDataFrame([("zero", 0)], "model string, tokens long"))
    rates = spark.createDataFrame([("AF", 3), ("AF", 5), ("NO", 4), ("NO", 4), ("RF", 2), ("RF", None)], "model string, rate long")
    return estimates.rate_bounds(spent, rates, ["model"])


@register(
    """WITH p AS (SELECT p_partkey AS page, '| Model | Price |' || chr(10) || '|---|:---:|' || chr(10) || '| ' || p_brand || ' | $' || p_size || '.5 / MTok |' || chr(10) || 'note' AS text FROM part), l AS (SELECT page, unnest(string_split(text, chr(10))) AS value, unnest(range(4)) AS line FROM p)
  SELECT page, CAST(line AS INT) AS line, trim(split_part(value, '|', 2)) AS first, try_cast(regexp_extract(trim(split_part(value, '|', 3)), '^\\$([0-9.]+) / MTok$', 1) AS DOUBLE) AS price FROM l WHERE line IN (0, 2)"""
)
def fetched_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of prices in markdown for each part."""
    body = F.concat(F.lit("| Model | Price |\n|---|:---:|\n| "), F.col("p_brand"), F.lit(" | $"), F.col("p_size").cast("string"), F.lit(".5 / MTok |\nnote"))
    rows = estimates.markdown_rows(tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), body.alias("text")))
    return rows.select("page", "line", F.get("cells", F.lit(0)).alias("first"), estimates.price_per_million(F.get("cells", F.lit(1))).alias("price"))


#: Calls of shells with a command made of the event's numbers.
CALLS = f"""{TURNS}, calls AS (SELECT session, ordinal, CASE ordinal % 3 WHEN 0 THEN '{{"command":"cd /w && Cargo test --p' || call_id || ' | tail"}}' WHEN 1 THEN '{{"cmd":["git","commit","-m","p' || call_id || '"]}}' ELSE 'make p' || call_id END AS arguments FROM turns WHERE direction = 'call')"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, id = F.col("ordinal") % 3, F.col("call_id").cast("string")
    shell = F.when(n == 0, F.concat(F.lit('{"command":"cd /w && Cargo test --p'), id, F.lit(' | tail"}'))).when(n == 1, F.concat(F.lit('{"cmd":["git","commit","-m","p'), id, F.lit('"]}'))).otherwise(F.concat(F.lit("make p"), id))
    return tables.event_turns(spark, sf_dir).filter("direction = 'call'").select("session", "ordinal", shell.alias("arguments"))


@register(
    f"""WITH {CALLS} SELECT session, ordinal FROM calls WHERE contains(lower(CASE WHEN starts_with(arguments, '{{"cmd"') THEN array_to_string(CAST(json_extract(arguments, '$.cmd') AS VARCHAR[]), ' ') WHEN starts_with(arguments, '{{') THEN json_extract_string(arguments, '$.command') ELSE arguments END), 'commit -m p2')
  OR contains(lower(arguments), 'cargo test --p1')"""
)
def calls_that_ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calls(spark, sf_dir)
    return made.filter(changes.ran(F.col("arguments"), "commit -m P2") | changes.ran(F.col("arguments"), "cargo TEST --p1")).select("session", "ordinal")


@register(
    f"""WITH {CALLS}, i AS (SELECT session, ordinal, unnest(CASE ordinal % 3 WHEN 0 THEN ['cd', 'Cargo', 'tail'] WHEN 1 THEN ['git'] ELSE ['make'] END) AS program, unnest(CASE ordinal % 3 WHEN 0 THEN ['', '&&', '|'] ELSE [''] END) AS separator FROM calls)
  SELECT program, separator, count(*) AS calls, count(DISTINCT session) AS sessions FROM i GROUP BY ALL"""
)
def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each program was run; tests split quotes, scripts and here-documents."""
    each = changes.invocations(calls(spark, sf_dir), ["session", "ordinal"]).select("session", F.explode("invocations").alias("i"))
    return each.groupBy("i.program", "i.separator").agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"))


@register(
    """WITH o AS (SELECT o_orderkey AS k, substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS sha FROM orders)
  SELECT k, CAST(CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END AS INT) AS line, CASE WHEN k % 3 > 0 THEN substring(sha, 1, 9) ELSE sha END AS sha, CASE WHEN k % 3 > 0 THEN 'created' ELSE 'inspected' END AS kind, CASE WHEN k % 3 > 0 THEN 'work ' || k END AS subject FROM o"""
)
def commit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tool would print after a commit or a log."""
    sha = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 40)
    made = F.concat(F.lit("hook: ok\n[main "), F.substring(sha, 1, 9), F.lit("] work "), F.col("o_orderkey").cast("string"), F.lit("\n 1 file changed"))
    text = F.when(F.col("o_orderkey") % 3 > 0, made).otherwise(F.concat(F.lit("commit "), sha, F.lit("\nAuthor: a")))
    return changes.commit_observations(tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text")), ["k"])


@register(
    """WITH o AS (SELECT o_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS sign, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT k, 'src/' || k || '.py' AS path, CASE WHEN k % 2 = 0 THEN 'update' ELSE 'add' END AS op, CAST(count(DISTINCT p) FILTER (WHERE sign = '+') AS INT) AS added, CAST(count(DISTINCT p) FILTER (WHERE sign = '-') AS INT) AS removed FROM o GROUP BY k"""
)
def edit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as lines of a patch."""
    lines = tables.dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l")
    )
    body = F.array_join(F.transform("l", lambda x: F.concat(F.when(x["l_linenumber"] % 2 == 0, "-").otherwise("+"), F.lit("value = "), x["l_partkey"].cast("string"))), "\n")
    head = F.concat(F.lit("*** Begin Patch\n*** "), F.when(F.col("k") % 2 == 0, "Update").otherwise("Add"), F.lit(" File: src/"), F.col("k").cast("string"), F.lit(".py\n@@\n"))
    found = changes.edited_digests(changes.patched_lines(lines.select("k", F.concat(head, body, F.lit("\n*** End Patch")).alias("text")), ["k"]), ["k"])
    return found.select("k", "path", "op", F.size("added").alias("added"), F.size("removed").alias("removed"))


@register(
    """SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['reviewed-by', 'signed-off-by'] WHEN o_orderkey % 3 = 1 THEN ['closes'] ELSE [] END) AS key, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['A ' || o_custkey, 'B'] WHEN o_orderkey % 3 = 1 THEN ['#' || o_custkey] ELSE [] END) AS value FROM orders"""
)
def trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, who = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    message = F.when(n == 0, F.concat(F.lit("fix\n\nbody: not one\n\nReviewed-by: A "), who, F.lit("\nSigned-off-by: B\n"))).when(n == 1, F.concat(F.lit("fix\n\nCloses: #"), who)).otherwise(F.lit("Key: only a subject"))
    return tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(changes.trailers(message)).alias("t")).select("k", "t.*")


@register("SELECT s_suppkey AS k, 'git.host' || (s_nationkey % 3) || '.org/Team/repo' || s_suppkey AS repository FROM supplier")
def remote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five forms of one repository's address."""
    n, host, path = F.col("s_suppkey") % 5, F.concat(F.lit("git.HOST"), (F.col("s_nationkey") % 3).cast("string"), F.lit(".org")), F.concat(F.lit("Team/repo"), F.col("s_suppkey").cast("string"))
    url = (
        F.when(n == 0, F.concat(F.lit("https://"), host, F.lit("/"), path, F.lit(".git"))).when(n == 1, F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit(".git")))
        .when(n == 2, F.concat(F.lit("ssh://git@"), host, F.lit(":2222/"), path, F.lit("/"))).when(n == 3, F.concat(F.lit("https://me:pw@"), host, F.lit("/"), path)).otherwise(F.concat(host, F.lit(":/"), path))
    )
    return tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), changes.remote_key(url).alias("repository"))


@register(
    f"""WITH {TURNS}, {GAPS}, s AS (SELECT *, sum(CASE WHEN gap > {IDLE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY harness, session ORDER BY ordinal) AS stretch FROM gaps), q AS (SELECT session, stretch, ordinal, ts FROM s WHERE kind = 'assistant'),
  e AS (SELECT session, stretch, ts, 'w' || ordinal AS work FROM s WHERE kind = 'operator') SELECT q.session, q.ordinal, coalesce((SELECT arg_min(work, (e.ts, work)) FROM e WHERE e.session = q.session AND e.stretch = q.stretch AND e.ts >= q.ts), (SELECT arg_max(work, (e.ts, work)) FROM e WHERE e.session = q.session AND e.stretch = q.stretch AND e.ts < q.ts)) AS work FROM q"""
)
def estimate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as requests, operator turns as events of work, within working stretches."""
    told = turns.with_stretch(tables.event_turns(spark, sf_dir), IDLE_MS)
    asked = told.filter("kind = 'assistant'").select("session", "stretch", "ordinal", F.col("ts").alias("at"))
    marks = told.filter("kind = 'operator'").select("session", "stretch", F.col("ts").alias("at"), F.concat(F.lit("w"), F.col("ordinal").cast("string")).alias("work"))
    return changes.estimate_windows(asked, marks, ["session", "stretch"]).select("session", "ordinal", "work")


@register(
    """WITH e AS (SELECT l_orderkey AS session, l_suppkey % 5 AS "commit", CASE l_returnflag WHEN 'A' THEN 'bound' WHEN 'R' THEN 'matched' ELSE 'estimated' END AS tier, 'b' || l_linenumber AS basis FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY session, "commit" ORDER BY CASE tier WHEN 'bound' THEN 0 WHEN 'matched' THEN 1 ELSE 2 END, basis) AS n FROM e) SELECT session, "commit", tier, basis FROM r WHERE n = 1"""
)
def commit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), (F.col("l_suppkey") % 5).alias("commit"), F.when(F.col("l_returnflag") == "A", "bound").when(F.col("l_returnflag") == "R", "matched").otherwise("estimated").alias("tier"),
        F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("basis"),
    )
    return changes.commit_claims(evidence)


@register(
    """WITH e AS (SELECT o_custkey AS label, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS c FROM orders) SELECT label, count(DISTINCT c) AS commits, CASE WHEN count(DISTINCT c) > 1 THEN 'conflict' WHEN count(DISTINCT c) = 1 THEN 'placed' ELSE 'unplaced' END AS status FROM e GROUP BY label"""
)
def evidence_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.evidence_conflicts(tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("label"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 3).alias("commit")))


@register(
    f"""WITH {REQUESTS}, p AS (SELECT CASE WHEN ordinal <= 2 THEN session % 7 END AS c, session % 7 < 4 AS selected, CASE WHEN ordinal = 3 THEN 'x' END AS label, ordinal = 4 AS uncommitted, model, input, output FROM requests),
  s AS (SELECT *, CASE WHEN c IS NOT NULL AND selected THEN 'commit' WHEN c IS NOT NULL THEN 'unselected' WHEN label IS NOT NULL THEN 'labelled' WHEN uncommitted THEN 'uncommitted' ELSE 'unattributed' END AS share FROM p),
  d AS (SELECT share, CASE WHEN share = 'commit' THEN c END AS "commit", CASE WHEN share = 'commit' THEN model END AS model, input, output FROM s)
  SELECT share, "commit", model, GROUPING(share, "commit", model) AS level, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM d GROUP BY GROUPING SETS ((share, "commit", model), (share), ())"""
)
def change_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first two lines are a commit's, the third is labelled, the fourth isn't committed yet."""
    n = F.col("ordinal")
    placed = tables.line_requests(spark, sf_dir).select(
        F.when(n <= 2, F.col("session") % 7).alias("commit"), (F.col("session") % 7 < 4).alias("selected"), F.when(n == 3, "x").alias("label"), (n == 4).alias("uncommitted"), "model", "input", "output"
    )
    return changes.change_usage(placed, ["commit", "model"])


@register(
    """WITH p AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'closed' ELSE 'merged' END AS state, o_orderkey % 3 AS parents, o_custkey % 2 = 0 AS same_tree, o_custkey % 4 AS commits, o_custkey % 3 AS picked FROM orders)
  SELECT k, CASE WHEN state <> 'merged' THEN state WHEN parents >= 2 THEN 'merge-commit' WHEN parents = 1 AND commits > 1 AND picked = commits THEN 'rebase' WHEN parents = 1 AND same_tree THEN 'squash' ELSE 'unrecognized' END AS rule FROM p"""
)
def pull_request_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "closed").otherwise("merged").alias("state"), (F.col("o_orderkey") % 3).alias("parents"),
        (F.col("o_custkey") % 2 == 0).alias("same_tree"), (F.col("o_custkey") % 4).alias("commits"), (F.col("o_custkey") % 3).alias("picked"),
    )
    return changes.pull_request_rule(asked).select("k", "rule")
