"""Native recordings (JSON Lines) and supplied exports read as turns and requests.

A file is a recording; the order of its lines is the order of its records. Lines are split over
tasks as the text source likes, and get their number from where their block starts and the order
inside it, so no file has to be one row. Lines that aren't JSON are gaps: kept apart, never fatal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.storage import materialize

#: Elements and headings that a harness puts around a person's words, and those it raises itself.
ENVELOPE_TAGS = ("environment_context", "collaboration_mode", "permissions_instructions", "apps_instructions", "plugins_instructions", "skills_instructions", "skill", "INSTRUCTIONS", "recommended_plugins", "in-app-browser-context")
NOTICE_TAGS = ("turn_aborted", "subagent_notification", "codex_internal_context")
INTERRUPTIONS = ("[Request interrupted by user]", "[Request interrupted by user for tool use]")

TURN = ["harness", "session", "ordinal", "ts", "role", "kind", "model", "text", "direction", "call_id", "name", "arguments", "is_error"]


def lines(spark: SparkSession, path: str | list[str], most: int = 64 << 20, **options: str) -> tuple[DataFrame, DataFrame]:
    """``(records, gaps)``: file, line (from 0) and value; gaps are malformed or longer than ``most`` bytes.

    A line's number is its place in its block of the file and the lines of the blocks before, which are counted first: a
    file's lines never meet in one task. ``options`` are the text source's, such as ``modifiedAfter`` and ``pathGlobFilter``.
    """
    raw = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), "value"
    )
    blocks = raw.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("__before", before).drop("__n")
    numbered = raw.join(placed, ["file", "__block"]).withColumn("line", F.col("__before") + F.col("__at") - F.col("__first")).filter(F.length(F.trim("value")) > 0).select("file", "value", "line")
    return _judged(numbered, most)


def _judged(numbered: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    reason = F.when(F.octet_length("value") > most, "oversize").when(F.try_parse_json("value").isNull(), "malformed")
    judged = numbered.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").select("file", "line", "reason", F.octet_length("value").alias("bytes"))


def bundle(records: DataFrame, path: str, *order: str) -> None:
    """Write many small recordings as one bundle: text files whose lines are a recording's name, the line's number in it (from 0, by ``order``) and the line, with tabs between.

    ``records``: name (without tabs), value (one line each), and the columns of ``order``. The bundle has as many files as tasks, however many
    recordings there are: to make, list and open a file for each costs more than to read what it holds.
    """
    line = F.row_number().over(Window.partitionBy("name").orderBy(*order)) - 1
    records.withColumn("line", line).select(F.concat_ws("\t", "name", F.col("line").cast("string"), "value").alias("value")).write.text(path)


def bundled_lines(spark: SparkSession, path: str | list[str], most: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """What ``lines`` gives, of bundles: ``file`` is a recording's name. Lines bring their numbers, so nothing is counted or shuffled."""
    cut = F.split("value", "\t", 3)
    told = spark.read.text(path).select(cut[0].alias("file"), cut[2].alias("value"), cut[1].cast("long").alias("line"))
    return _judged(told.filter(F.length(F.trim("value")) > 0), most)


def catalog(spark: SparkSession, root: str, pattern: str = "*.jsonl", limit: int = 5000, modified_after: str | None = None) -> DataFrame:
    """``file, modified, bytes, rank, scan_truncated``: the ``limit`` newest recordings below a folder, newest first, ties by name.

    Only the listing is read, no content; ``modified_after`` prunes files before they are listed.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"} | ({"modifiedAfter": modified_after} if modified_after else {})
    found = spark.read.format("binaryFile").options(**options).load(root).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    newest = found.orderBy(F.desc("modified"), "file").limit(limit + 1)
    # at most limit + 1 rows
    one = Window.partitionBy(F.lit(0))
    ranked = newest.withColumns({"rank": F.row_number().over(one.orderBy(F.desc("modified"), "file")), "scan_truncated": F.count("*").over(one) > limit})
    return ranked.filter(F.col("rank") <= limit)


def stamp(text: Column) -> Column:
    """RFC 3339 or a date, in UTC; null for anything else."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def name_of(file: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _element(text: Column, tag: str) -> Column:
    """Whether a text is one element of the tag and nothing else."""
    t = F.trim(text)
    return t.startswith(f"<{tag}>") & t.endswith(f"</{tag}>") & ~F.substring(t, len(tag) + 3, 1 << 30).contains(f"<{tag}>")


def _parts(content: Column, schema: str) -> Column:
    """A content's parts; a plain text, also one that only begins like a list, is one text part."""
    alone = F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), schema)
    return F.coalesce(F.when(F.trim(content).startswith("["), F.from_json(content, schema)), alone)


def _turns(rows: DataFrame) -> DataFrame:
    """Numbered turns: by record and part, from 0 in each session."""
    by = Window.partitionBy("harness", "session").orderBy("line", "part")
    numbered = rows.withColumn("ordinal", (F.row_number().over(by) - 1).cast("long"))
    return numbered.select(*TURN, "file", "line")


USAGE = "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, output_tokens_details struct<thinking_tokens long>"
CLAUDE = f"""type string, sessionId string, uuid string, parentUuid string, requestId string, timestamp string, cwd string, origin struct<kind string>, promptSource string, isMeta boolean, isSidechain boolean,
  agentId string, isCompactSummary boolean, interruptedMessageId string, logicalParentUuid string, message struct<role string, model string, content string, usage struct<{USAGE}>>, aiTitle string"""
PART = "array<struct<type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean>>"


def claude_records(records: DataFrame) -> DataFrame:
    parsed = records.withColumn("r", F.from_json("value", CLAUDE)).drop("value")
    return parsed.select("file", "line", F.coalesce("r.sessionId", name_of(F.col("file"))).alias("session"), "r.*").drop("sessionId")


def claude_kind(content: Column) -> Column:
    """Who a user record speaks for: its origin, then its marks, then the envelope it is written in."""
    origin, source = F.col("origin.kind"), F.col("promptSource")
    c = F.coalesce(content, F.lit(""))
    trimmed = F.trim(c)
    command = trimmed.startswith("<command-name>") & (F.length(F.regexp_replace(trimmed, r"(?s)<(command-name|command-message|command-args|command-contents)>.*?</\1>\s*", "")) == 0)
    shell = _element(c, "bash-input") | trimmed.rlike(r"(?s)^<bash-stdout>.*?</bash-stdout>\s*(<bash-stderr>((?!<bash-stderr>).)*</bash-stderr>)?$")
    return (
        F.when((origin == "human") | source.isin("typed", "sdk"), "operator")
        .when(origin.isin("task-notification", "auto-continuation") | (source == "system"), "notice")
        .when(F.col("isMeta"), F.when(c.contains("<local-command-caveat>"), "control").otherwise("ambient"))
        .when(origin.isNotNull() | source.isNotNull(), "unknown")
        .when(F.col("interruptedMessageId").isNotNull(), "notice")
        .when(F.col("isCompactSummary"), "ambient")
        .when(F.col("isSidechain") & F.col("agentId").isNotNull() & F.col("parentUuid").isNull(), "operator")
        .when(command | _element(c, "local-command-stdout") | shell, "control")
        .when(trimmed.isin(*INTERRUPTIONS), "notice")
        .otherwise("unknown")
    )


def claude_turns(records: DataFrame) -> DataFrame:
    """Turns of user, assistant and system records: one for each part of their content."""
    given = claude_records(records).filter(F.col("type").isin("user", "assistant", "system"))
    content = F.col("message.content")
    parts = _parts(content, PART)
    each = given.withColumn("parts", parts).select("*", F.posexplode("parts").alias("part", "p"))
    kind_of = F.col("p.type")
    text = F.coalesce("p.text", "p.thinking", "p.content")
    kind = (
        F.when(kind_of.isin("tool_use", "tool_result"), "tool")
        .when(kind_of.isin("thinking", "redacted_thinking"), "reasoning")
        .when(F.col("type") == "assistant", "assistant")
        .when(F.col("type") == "user", claude_kind(text))
        .otherwise("unknown")
    )
    return _turns(
        each.select(
            "file", "line", "part", F.lit("claude").alias("harness"), "session", stamp(F.col("timestamp")).alias("ts"),
            F.when(kind_of == "tool_result", "tool").otherwise(F.coalesce("message.role", "type")).alias("role"), kind.alias("kind"), F.col("message.model").alias("model"), text.alias("text"),
            F.when(kind_of == "tool_use", "call").when(kind_of == "tool_result", "result").alias("direction"), F.coalesce("p.id", "p.tool_use_id").alias("call_id"),
            F.col("p.name").alias("name"), F.col("p.input").alias("arguments"), F.col("p.is_error").alias("is_error"),
        )
    )


def claude_requests(records: DataFrame) -> DataFrame:
    """Counters of assistant records by request; unkeyed records are requests of their own. Fold them with ``usage.fold_requests``."""
    given = claude_records(records).filter((F.col("type") == "assistant") & ~F.coalesce(F.col("message.model") == "<synthetic>", F.lit(False)))
    u = "message.usage."
    return given.select(
        F.lit("claude").alias("harness"), "session", F.coalesce("requestId", F.concat(F.lit("line-"), F.col("line").cast("string"))).alias("request"), F.col("line").alias("ordinal"),
        stamp(F.col("timestamp")).alias("at"), F.col("message.model").alias("model"), F.col(u + "input_tokens").alias("input"), F.col(u + "output_tokens").alias("output"),
        F.col(u + "output_tokens_details.thinking_tokens").alias("reasoning"), F.col(u + "cache_read_input_tokens").alias("cache_read"), F.col(u + "cache_creation_input_tokens").alias("cache_write"),
    )


TOTALS = "struct<input_tokens long, cached_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long>"
RATE = "struct<used_percent string, window_minutes long, resets_at long>"
CODEX = f"""timestamp string, type string, payload struct<type string, id string, session_id string, cwd string, model string, effort string, role string, name string, arguments string, call_id string, output string,
  content string, summary string, info struct<total_token_usage {TOTALS}, last_token_usage {TOTALS}>, rate_limits struct<limit_id string, primary {RATE}, secondary {RATE}>, item struct<id string, type string>>"""


def without_envelopes(text: Column) -> Column:
    """A text without the blocks that a harness attached around a person's words."""
    return F.regexp_replace(text, r"(?s)<(" + "|".join(ENVELOPE_TAGS) + r")(?:\s[^>]*)?>.*?</\1>", "")


def codex_records(records: DataFrame) -> DataFrame:
    parsed = records.withColumn("r", F.from_json("value", CODEX)).select("file", "line", "r.*")
    head = parsed.filter("type = 'session_meta'").groupBy("file").agg(F.min_by(F.coalesce("payload.id", "payload.session_id"), "line").alias("__id"))
    return parsed.join(head, "file", "left").withColumn("session", F.coalesce("__id", name_of(F.col("file")))).drop("__id")


def codex_turns(records: DataFrame) -> DataFrame:
    """Turns of response items; runtime items that mirror a response item are left out by its id."""
    rows = codex_records(records)
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__model", F.last(F.when(F.col("type") == "turn_context", F.col("payload.model")), ignorenulls=True).over(by))
    p = "payload."
    blocks = F.from_json(F.col(p + "content"), "array<struct<type string, text string>>")
    said = F.filter(blocks, lambda b: (b["type"] == "input_text") & b["text"].isNotNull())
    bare = F.transform(said, lambda b: F.trim(without_envelopes(b["text"])))
    told = F.transform(bare, lambda t: (t == "") | (F.trim(F.regexp_replace(t, r"(?s)<(" + "|".join(NOTICE_TAGS) + r")(?:\s[^>]*)?>.*?</\1>", "")) == ""))
    user = F.when(F.coalesce(F.size(said), F.lit(0)) <= 0, "operator").when(F.forall(bare, lambda t: t == ""), "ambient").when(F.forall(told, lambda t: t), "notice").otherwise("operator")
    kind = F.col(p + "type")
    items = rows.filter("type = 'response_item'").select(
        "file", "line", F.lit(0).alias("part"), F.lit("codex").alias("harness"), "session", stamp(F.col("timestamp")).alias("ts"),
        F.when(kind == "reasoning", "reasoning").when(kind.isin("function_call", "custom_tool_call"), "assistant").when(kind.isin("function_call_output", "custom_tool_call_output"), "tool").otherwise(F.col(p + "role")).alias("role"),
        F.when(kind == "reasoning", "reasoning").when(kind.endswith("call") | kind.endswith("call_output"), "tool").when(F.col(p + "role") == "assistant", "assistant").when(F.col(p + "role") == "user", user).when(F.col(p + "role").isin("system", "developer"), "ambient").otherwise("unknown").alias("kind"),
        F.col("__model").alias("model"),
        F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.col(p + "output"), F.col(p + "summary")).alias("text"),
        F.when(kind.endswith("call"), "call").when(kind.endswith("call_output"), "result").alias("direction"),
        F.col(p + "call_id").alias("call_id"), F.col(p + "name").alias("name"), F.col(p + "arguments").alias("arguments"), F.lit(None).cast("boolean").alias("is_error"),
    )
    known = rows.filter("type = 'response_item'").select("file", F.explode(F.array_compact(F.array(p + "id", p + "call_id"))).alias("__known")).distinct()
    runtime = rows.filter((F.col("type") == "event_msg") & (F.col(p + "type") == "item_completed") & F.col(p + "item.id").isNotNull())
    alone = runtime.join(known, (runtime["file"] == known["file"]) & (F.col(p + "item.id") == F.col("__known")), "left_anti").select(
        "file", "line", F.lit(0).alias("part"), F.lit("codex").alias("harness"), "session", stamp(F.col("timestamp")).alias("ts"), F.lit("tool").alias("role"), F.lit("tool").alias("kind"), F.col("__model").alias("model"),
        F.lit(None).cast("string").alias("text"), F.lit("call").alias("direction"), F.col(p + "item.id").alias("call_id"), F.col(p + "item.type").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("boolean").alias("is_error"),
    )
    return _turns(items.unionByName(alone))


def codex_totals(records: DataFrame) -> DataFrame:
    """Token counts in record order: running totals, the last request's counters and the model as of then; see ``usage.classify_totals``."""
    rows = codex_records(records)
    by = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.when(F.col("type") == "turn_context", F.col("payload.model"))
    told = rows.withColumn("model", F.last(chosen, ignorenulls=True).over(by)).filter("type = 'event_msg' AND payload.type = 'token_count'")
    fields = {"input": "input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens", "cache_read": "cached_input_tokens", "cache_write": "cache_write_input_tokens"}
    return told.select(
        F.lit("codex").alias("harness"), "session", F.col("line").alias("ordinal"), stamp(F.col("timestamp")).alias("at"), "model",
        *[F.col(f"payload.info.total_token_usage.{v}").alias(f"total_{k}") for k, v in fields.items()],
        *[F.col(f"payload.info.last_token_usage.{v}").alias(f"last_{k}") for k, v in fields.items()],
    )


def codex_quota(records: DataFrame) -> DataFrame:
    """Quota observations: pool, window and percent used."""
    rows = codex_records(records).filter("payload.rate_limits IS NOT NULL")
    pools = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"payload.rate_limits.{w}").alias("r")) for w in ("primary", "secondary")])
    each = rows.select("session", "line", "timestamp", F.col("payload.rate_limits.limit_id").alias("limit_id"), F.explode(pools).alias("x")).filter("x.r IS NOT NULL")
    return each.select(
        F.concat_ws("/", "limit_id", "x.window").alias("pool"), "session", F.col("line").alias("ordinal"), stamp(F.col("timestamp")).alias("observed_at"),
        F.timestamp_seconds("x.r.resets_at").cast("timestamp_ntz").alias("resets_at"), F.col("x.r.window_minutes").alias("window_minutes"), F.col("x.r.used_percent").cast("double").alias("percent"),
    )


COST = "struct<input double, output double, cacheRead double, cacheWrite double, total double>"
PI = f"""type string, id string, parentId string, timestamp string, cwd string, parentSession string, modelId string, message struct<role string, timestamp long, provider string, model string, content string,
  usage struct<input long, output long, reasoning long, cacheRead long, cacheWrite long, totalTokens long, cost {COST}>, toolCallId string, toolName string, isError boolean>"""
PI_PART = "array<struct<type string, text string, thinking string, id string, name string, arguments string>>"


def pi_records(records: DataFrame, levels: int = 4096) -> DataFrame:
    """Entries with ``active``: whether they are on the branch of the file's last entry.

    Each round doubles the distance that parent pointers reach, so a branch is followed in a
    logarithm of its length; all files are walked at once.
    """
    rows = materialize(records.withColumn("r", F.from_json("value", PI)).select("file", "line", "r.*"))
    head = rows.filter("type = 'session'").groupBy("file").agg(F.min_by("id", "line").alias("__id"))
    entry = rows.filter("type <> 'session' AND id IS NOT NULL")
    # what the last entry reaches grows by a jump of 1, 2, 4 ... steps up from all that it reached before
    jump = entry.groupBy("file", "id").agg(F.max_by("parentId", "line").alias("up"))
    known = entry.groupBy("file").agg(F.max_by("id", "line").alias("id"))
    step = 1
    while step < levels:
        jump, known = materialize(jump), materialize(known)
        further = known.join(jump, ["file", "id"]).filter("up IS NOT NULL").select("file", F.col("up").alias("id"))
        grown = known.unionByName(further).distinct()
        above = jump.select("file", F.col("id").alias("up"), F.col("up").alias("__next"))
        jump = jump.join(above, ["file", "up"], "left").select("file", "id", F.col("__next").alias("up"))
        if step > 1 and further.join(known, ["file", "id"], "left_anti").isEmpty() and jump.filter("up IS NOT NULL").isEmpty():
            known = grown
            break
        known, step = grown, step * 2
    named = rows.join(head, "file", "left").withColumn("session", F.coalesce("__id", name_of(F.col("file")))).drop("__id")
    active = known.select(F.col("file").alias("__f"), F.col("id").alias("__i"))
    return named.join(active, (F.col("file") == F.col("__f")) & (F.col("id") == F.col("__i")), "left").withColumn("active", F.col("__i").isNotNull()).drop("__f", "__i")


def pi_turns(records: DataFrame) -> DataFrame:
    """Turns of the active branch."""
    given = pi_records(records).filter("active AND type = 'message'")
    m = "message."
    content = F.col(m + "content")
    parts = _parts(content, PI_PART)
    each = given.withColumn("parts", parts).select("*", F.posexplode("parts").alias("part", "p"))
    role, kind_of = F.col(m + "role"), F.col("p.type")
    kind = F.when((role == "toolResult") | (kind_of == "toolCall"), "tool").when(kind_of == "thinking", "reasoning").when(role == "assistant", "assistant").when(role == "user", "operator").otherwise("unknown")
    return _turns(
        each.select(
            "file", "line", "part", F.lit("pi").alias("harness"), "session", F.coalesce(F.timestamp_millis(m + "timestamp").cast("timestamp_ntz"), stamp(F.col("timestamp"))).alias("ts"),
            F.when(role == "toolResult", "tool").otherwise(role).alias("role"), kind.alias("kind"), F.col(m + "model").alias("model"), F.coalesce("p.text", "p.thinking").alias("text"),
            F.when(kind_of == "toolCall", "call").when(role == "toolResult", "result").alias("direction"), F.coalesce("p.id", m + "toolCallId").alias("call_id"),
            F.coalesce("p.name", m + "toolName").alias("name"), F.col("p.arguments").alias("arguments"), F.col(m + "isError").alias("is_error"),
        )
    )


def pi_requests(records: DataFrame) -> DataFrame:
    """Requests of all branches, each entry once; a written cost of 0 beside usage is ``unpriced``."""
    given = pi_records(records).filter("type = 'message' AND message.usage IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("session", "id").orderBy("line"))
    u = "message.usage."
    cost = F.col(u + "cost.total")
    return given.withColumn("__n", first).filter("__n = 1").select(
        F.lit("pi").alias("harness"), "session", F.col("id").alias("request"), F.col("line").alias("ordinal"), "active", F.timestamp_millis("message.timestamp").cast("timestamp_ntz").alias("at"), F.col("message.model").alias("model"),
        F.col(u + "input").alias("input"), F.col(u + "output").alias("output"), F.col(u + "reasoning").alias("reasoning"), F.col(u + "cacheRead").alias("cache_read"), F.col(u + "cacheWrite").alias("cache_write"),
        F.when(cost > 0, cost).alias("cost"), F.coalesce((cost == 0) & (F.col(u + "totalTokens") > 0), F.lit(False)).alias("unpriced"),
    )


def opencode_turns(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns from exported message and part rows, in order of their times and ids."""
    m = messages.withColumn("d", F.from_json("data", "role string, modelID string")).select(F.col("id").alias("message_id"), F.col("session_id").alias("session"), F.col("time_created").alias("__t"), "d")
    p = parts.withColumn("p", F.from_json("data", "type string, text string, tool string, callID string, state struct<status string, input string, output string>")).select("message_id", F.col("id").alias("__pid"), F.col("time_created").alias("__pt"), "p")
    by = Window.partitionBy("session").orderBy("__t", "message_id", "__pt", "__pid")
    kind = F.when(F.col("p.type") == "tool", "tool").when(F.col("p.type") == "reasoning", "reasoning").when(F.col("d.role") == "assistant", "assistant").when(F.col("d.role") == "user", "operator").otherwise("unknown")
    return m.join(p, "message_id").select(
        F.lit("opencode").alias("harness"), "session", (F.row_number().over(by) - 1).cast("long").alias("ordinal"), F.timestamp_millis("__pt").cast("timestamp_ntz").alias("ts"), F.col("d.role").alias("role"), kind.alias("kind"),
        F.col("d.modelID").alias("model"), F.coalesce("p.text", "p.state.output").alias("text"), F.when(F.col("p.type") == "tool", "call").alias("direction"), F.col("p.callID").alias("call_id"), F.col("p.tool").alias("name"),
        F.col("p.state.input").alias("arguments"), (F.col("p.state.status") == "error").alias("is_error"),
    )


def opencode_requests(messages: DataFrame) -> DataFrame:
    """Counters of assistant messages."""
    d = F.from_json("data", "role string, modelID string, cost double, tokens struct<input long, output long, reasoning long, cache struct<read long, write long>>")
    rows = messages.withColumn("d", d).filter("d.role = 'assistant'")
    t = "d.tokens."
    return rows.select(
        F.lit("opencode").alias("harness"), F.col("session_id").alias("session"), F.col("id").alias("request"), F.timestamp_millis("time_created").cast("timestamp_ntz").alias("at"), F.col("d.modelID").alias("model"),
        F.col(t + "input").alias("input"), F.col(t + "output").alias("output"), F.col(t + "reasoning").alias("reasoning"), F.col(t + "cache.read").alias("cache_read"), F.col(t + "cache.write").alias("cache_write"), F.col("d.cost").alias("cost"),
    )


def export_format(value: Column) -> Column:
    """The shape of a supplied export record; null for none, ``ambiguous`` where two shapes fit."""
    def has(path: str, kind: str) -> Column:
        first = F.substring(F.ltrim(F.get_json_object(value, path)), 1, 1)
        return F.coalesce(first == kind, F.lit(False))

    text = {k: F.get_json_object(value, f"$.{k}").isNotNull() for k in ("context_uuid", "conversation_id", "id", "current_node", "prompt", "response", "answer")}
    perplexity = has("$.conversations", "[") | (text["context_uuid"] & has("$.entries", "["))
    mapping = has("$.mapping", "{")
    loose = has("$.messages", "[") | has("$.entries", "[") | text["prompt"] | text["response"] | text["answer"] | F.ltrim(value).startswith("[")
    return (
        F.when(perplexity & mapping, "ambiguous")
        .when(mapping & ~text["conversation_id"] & (text["id"] | text["current_node"]), "chatgpt-exporter")
        .when(mapping, "openai")
        .when(perplexity, "perplexity")
        .when(loose, "chatgpt-exporter")
    )


def mapping_turns(conversations: DataFrame) -> DataFrame:
    """Turns of exported message graphs: the messages on the path from the current node up, from the root down; nodes without a message are left out."""
    node = "struct<id string, parent string, message struct<id string, author struct<role string>, create_time double, content struct<content_type string, parts array<string>>>>"
    c = F.from_json("value", f"struct<id string, conversation_id string, current_node string, mapping map<string, {node}>>")
    nodes = conversations.select(c.alias("c")).filter("c.mapping IS NOT NULL").select(F.coalesce("c.conversation_id", "c.id").alias("session"), F.col("c.current_node").alias("current"), F.explode("c.mapping").alias("id", "n"))
    nodes = materialize(nodes.select("session", "id", "current", F.col("n.parent").alias("parent"), "n.message"))
    path = mapping_path(nodes.select("session", "id", "parent", "current"), ["session"])
    told = path.join(nodes, ["session", "id"]).filter("message IS NOT NULL")
    ordinal = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("depth"))) - 1
    return told.select(
        "session", ordinal.cast("long").alias("ordinal"), F.col("message.author.role").alias("role"), F.array_join("message.content.parts", "\n").alias("text"), F.timestamp_micros((F.col("message.create_time") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts")
    )


def export_turns(conversations: DataFrame) -> DataFrame:
    """Turns of exported conversations (``value``: one conversation's JSON): message lists, question-answer entries, single pairs and message graphs."""
    shaped = conversations.withColumn("format", export_format(F.col("value")))
    c = "struct<id string, title string, prompt string, response string, answer string, messages array<struct<id string, role string, content string>>, context_uuid string, context_title string, entries array<struct<entry_uuid string, query string, answer string, created_at string>>>"
    read = shaped.withColumn("c", F.from_json("value", c))
    listed = read.filter("c.messages IS NOT NULL").select(F.col("c.id").alias("session"), F.posexplode("c.messages").alias("ordinal", "m")).select(
        "session", F.col("ordinal").cast("long").alias("ordinal"), F.col("m.role").alias("role"), F.col("m.content").alias("text"), F.lit(None).cast("timestamp_ntz").alias("ts")
    )

    def both(question: Column, answer: Column) -> Column:
        return F.array(F.struct(F.lit("user").alias("role"), question.alias("text")), F.struct(F.lit("assistant").alias("role"), answer.alias("text")))

    asked = read.filter("c.entries IS NOT NULL AND format = 'perplexity'").select(F.col("c.context_uuid").alias("session"), F.posexplode("c.entries").alias("i", "e"))
    pairs = asked.select("session", "i", "e", F.posexplode(both(F.col("e.query"), F.col("e.answer"))).alias("j", "t"))
    answered = pairs.select("session", (F.col("i") * 2 + F.col("j")).cast("long").alias("ordinal"), "t.role", "t.text", stamp(F.col("e.created_at")).alias("ts"))
    alone = read.filter("format = 'chatgpt-exporter' AND c.messages IS NULL AND (c.prompt IS NOT NULL OR c.response IS NOT NULL OR c.answer IS NOT NULL)")
    single = alone.select(F.col("c.id").alias("session"), F.posexplode(both(F.col("c.prompt"), F.coalesce("c.response", "c.answer"))).alias("ordinal", "t")).filter("t.text IS NOT NULL").select(
        "session", F.col("ordinal").cast("long").alias("ordinal"), "t.role", "t.text", F.lit(None).cast("timestamp_ntz").alias("ts")
    )
    graphs = mapping_turns(shaped.filter("format IN ('openai', 'chatgpt-exporter')").select("value"))
    every = listed.unionByName(answered).unionByName(single).unionByName(graphs)
    return every.withColumn("kind", F.when(F.col("role") == "user", "operator").when(F.col("role") == "assistant", "assistant").otherwise("unknown"))


#: What reads each harness's recordings: lines of JSON to turns.
READERS = {"claude": lambda records: claude_turns(records), "codex": lambda records: codex_turns(records), "pi": lambda records: pi_turns(records)}


def read_turns(spark: SparkSession, stores: dict[str, str | list[str]]) -> DataFrame:
    """Turns of several stores, one reader for each harness (``READERS`` can be extended)."""
    made = [READERS[harness](lines(spark, path)[0]) for harness, path in stores.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def mapping_path(nodes: DataFrame, keys: list[str], rounds: int = 13) -> DataFrame:
    """``keys, id, depth``: the canonical path of conversation graphs, from the current node up.

    ``nodes``: keys, id, parent, current. Pointers double each round, so 13 rounds follow 4096 levels;
    a parent that isn't there ends the path, and a cycle ends where it closes.
    """
    at = materialize(nodes.filter("id = current").select(*keys, "id", F.lit(0).cast("long").alias("depth")))
    jump = nodes.select(*keys, F.col("id").alias("__from"), F.col("parent").alias("__to"))
    step = 1
    for _ in range(rounds):
        jump = materialize(jump)
        further = at.join(jump, [*[at[k] == jump[k] for k in keys], at["id"] == jump["__from"]]).filter("__to IS NOT NULL").select(*[at[k] for k in keys], F.col("__to").alias("id"), (F.col("depth") + step).alias("depth"))
        known = nodes.select(*keys, "id")
        before = at.count()
        at = materialize(at.unionByName(further.join(known, [*keys, "id"], "left_semi")).groupBy(*keys, "id").agg(F.min("depth").alias("depth")))
        if at.count() == before:
            break
        up = jump.select(*keys, F.col("__from").alias("__to"), F.col("__to").alias("__next"))
        jump = jump.join(up, [*keys, "__to"], "left").select(*keys, "__from", F.col("__next").alias("__to"))
        step *= 2
    return at
