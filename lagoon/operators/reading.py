"""What is read of a store and how it is shown: scopes, pages of history, titles, continuations, copies, briefs, projections, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.scalars import byte_capped, escaped, single_line

SESSION = ["harness", "session"]


def union_of_stores(stores: list[DataFrame]) -> DataFrame:
    """All stores' sessions in the order given, with ``store_rank``; a column that a store lacks is null in its rows."""
    ranked = [s.withColumn("store_rank", F.lit(i)) for i, s in enumerate(stores)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def without_failed(sessions: DataFrame, failed: DataFrame) -> DataFrame:
    """Listings of stores ranked before the first failed one of their harness: a session in a later store may be an older copy of one unread.

    ``failed``: harness, store_rank.
    """
    first = failed.groupBy("harness").agg(F.min("store_rank").alias("__failed"))
    return sessions.join(first, "harness", "left").filter(F.col("__failed").isNull() | (F.col("store_rank") < F.col("__failed"))).drop("__failed")


def in_scope(sessions: DataFrame, directories: DataFrame, repository: str, root: str) -> DataFrame:
    """``sessions`` with ``scope``: in, out or unresolved.

    A directory is in scope if it is of the repository, or is ``root`` or below it where it is of no repository; ``directories`` (directory, repository, resolved) says what
    is known of each. Sessions without a directory are out; those whose directory can't be resolved are counted apart unless below ``root``.
    """
    known = directories.select("directory", F.col("repository").alias("__r"), F.col("resolved").alias("__k"))
    below = (F.col("directory") == root) | F.col("directory").startswith(root.rstrip("/") + "/")
    scope = (
        F.when(F.col("directory").isNull(), "out")
        .when(F.col("__r") == repository, "in")
        .when(F.col("__r").isNull() & below, "in")
        .when(~F.coalesce("__k", F.lit(False)), "unresolved")
        .otherwise("out")
    )
    return sessions.join(known, "directory", "left").withColumn("scope", scope).drop("__r", "__k")


def preview(text: Column, chars: int = 200) -> Column:
    """``chars, text``: how long a text is and how it begins."""
    return F.struct(F.length(text).cast("long").alias("chars"), F.substring(text, 1, chars).alias("text"))


def history_page(turns: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest turns of each session before its cursor, with ``next`` (the cursor of the page before) and ``more``.

    ``cursors``: harness, session, before (null for the newest page). A cursor is an ordinal, so what is appended later doesn't move a page.
    """
    given = turns.join(cursors, SESSION).filter(F.col("before").isNull() | (F.col("ordinal") < F.col("before")))
    by = Window.partitionBy(*SESSION)
    ranked = given.withColumns({"__n": F.row_number().over(by.orderBy(F.desc("ordinal"))), "__all": F.count("*").over(by)}).filter(F.col("__n") <= limit)
    return ranked.withColumns({"next": F.min("ordinal").over(by), "more": F.col("__all") > limit}).drop("__n", "__all", "before")


def history_search(turns: DataFrame, needle: str, page: int, pages: int = 32) -> DataFrame:
    """``harness, session, hits, page, searched, partial``: matches in the newest ``pages`` pages, and the newest page that holds one."""
    back = F.row_number().over(Window.partitionBy(*SESSION).orderBy(F.desc("ordinal"))) - 1
    paged = turns.select(*SESSION, "text", F.floor(back / page).alias("__page"))
    inside = F.col("__page") < pages
    hit = inside & F.coalesce(F.lower("text").contains(needle.lower()), F.lit(False))
    return paged.groupBy(*SESSION).agg(
        F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("__page"))).alias("page"), F.count_if(inside).alias("searched"), F.bool_or(~inside).alias("partial")
    )


def metadata_history(records: DataFrame, keys: list[str], value: str, newest: int = 1024) -> DataFrame:
    """The newest observations of a value that differ from the one before: ``keys, ordinal, value``; ``omitted`` counts older ones."""
    by = Window.partitionBy(*keys).orderBy("ordinal")
    known = records.filter(F.col(value).isNotNull())
    changes = known.withColumn("__b", F.lag(value).over(by)).filter(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ordinal")))
    counted = changes.withColumns({"__n": back, "__all": F.count("*").over(Window.partitionBy(*keys))})
    return counted.filter(F.col("__n") <= newest).select(*keys, "ordinal", value, F.greatest(F.lit(0).cast("long"), F.col("__all") - newest).alias("omitted"))


def first_lanes(lanes: DataFrame, keys: list[str], limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows of each group, and how many more there are (``rest``)."""
    by = Window.partitionBy(*keys)
    ranked = lanes.withColumns({"__n": F.row_number().over(by.orderBy(*order)), "__all": F.count("*").over(by)}).filter(F.col("__n") <= limit)
    return ranked.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.col("__all") - limit)).drop("__n", "__all")


def by_title(sessions: DataFrame, titles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``title, matches, harness, session``: the one session of each wanted title; null where none or several have it."""
    met = wanted.select("title").distinct().join(titles.join(sessions.select(*SESSION), SESSION), "title", "left")
    return met.groupBy("title").agg(F.count("session").alias("matches"), F.when(F.count("session") == 1, F.max("harness")).alias("harness"), F.when(F.count("session") == 1, F.max("session")).alias("session"))


def continuations(boundaries: DataFrame, records: DataFrame) -> DataFrame:
    """``session, uuid, predecessor, candidates``: the one other recording that holds the record a compact boundary goes on from.

    ``boundaries``: session, place, uuid (the logical parent). ``records``: session, place, uuid. Only recordings of the same place are
    looked at; several candidates settle nothing.
    """
    held = records.select(F.col("place"), F.col("uuid"), F.col("session").alias("__s")).distinct()
    met = boundaries.join(held, ["place", "uuid"], "left").withColumn("__s", F.when(F.col("__s") != F.col("session"), F.col("__s")))
    return met.groupBy("session", "uuid").agg(F.when(F.count_distinct("__s") == 1, F.max("__s")).alias("predecessor"), F.count_distinct("__s").alias("candidates"))


def verified_copies(fork: DataFrame, parent: DataFrame) -> DataFrame:
    """Events of forks that their parent holds with the same entry and digest: ``session, entry, verified``.

    ``fork``: session, parent, entry, content. ``parent``: session, entry, content.
    """
    digest = F.unhex(F.sha2(F.col("content").cast("string"), 256))  # half the bytes in sorts and shuffles
    theirs = parent.select(F.col("session").alias("parent"), "entry", digest.alias("__d")).distinct()
    met = fork.withColumn("__own", digest).join(theirs, ["parent", "entry"], "left")
    return met.groupBy("session", "entry").agg(F.coalesce(F.bool_or(F.col("__d") == F.col("__own")), F.lit(False)).alias("verified"))


ARTIFACT = ["kind", "uri", "path", "digest", "bytes"]


def artifact_uses(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """``event, use``: consumptions of artifacts equal in kind, address, path, digest and size, a null equal to a null."""
    right = consumed.select(*[F.col(c).alias(f"__{c}") for c in ARTIFACT], F.col("event").alias("use"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ARTIFACT])
    return produced.join(right, same).select("event", "use")


def settled_edits(edits: DataFrame) -> DataFrame:
    """Edits without those of a patch whose call a runtime record describes too."""
    runtime = edits.filter("origin = 'runtime' AND call_id IS NOT NULL").select("session", "call_id").distinct()
    patches = edits.filter("origin = 'patch'").join(runtime, ["session", "call_id"], "left_anti")
    return patches.unionByName(edits.filter("origin <> 'patch'"))


def brief(endings: DataFrame, paired: DataFrame, usage: DataFrame, children: DataFrame, most: int = 8) -> DataFrame:
    """Where each session stopped: its ending's facts, its newest open calls (at most ``most`` named, all counted), children still open, and usage."""
    by = Window.partitionBy(*SESSION).orderBy(F.desc("ordinal"))
    open_calls = paired.filter("direction = 'call' AND pair IS NULL").withColumn("__n", F.row_number().over(by))
    named = open_calls.groupBy(*SESSION).agg(
        F.count("*").alias("open_calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", "ordinal")))), lambda x: x["ordinal"].cast("string")), ",").alias("handles")
    )
    pending = children.groupBy("parent").agg(F.count_if("open").alias("open_children")).withColumnRenamed("parent", "session")
    return (
        endings.select(*SESSION, "last", "facts")
        .join(named, SESSION, "left")
        .join(pending, "session", "left")
        .join(usage, "session", "left")
        .withColumns({"open_calls": F.coalesce("open_calls", F.lit(0)), "handles": F.coalesce("handles", F.lit("")), "open_children": F.coalesce("open_children", F.lit(0))})
    )


def workset(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, session, relation, source``: a root and its relatives one level away, each once, numbered as sources s0, s1, … in order.

    ``edges``: parent, session, relation.
    """
    kin = edges.join(roots.select(F.col("session").alias("parent")).distinct(), "parent").select(F.col("parent").alias("root"), "session", "relation").filter("session != root")
    once = kin.groupBy("root", "session").agg(F.min("relation").alias("relation"))
    own = roots.select(F.col("session").alias("root"), "session", F.lit("root").alias("relation")).distinct()
    order = Window.partitionBy("root").orderBy(F.col("relation") != "root", "session")
    return own.unionByName(once).withColumn("source", F.concat(F.lit("s"), (F.row_number().over(order) - 1).cast("string")))


def lane_margin(turns: DataFrame, lanes: DataFrame, exchanges: int = 2) -> DataFrame:
    """``harness, session, lane, ordinal``: what a lane is read with from before its start: the last ``exchanges`` operator turns and each one's first reply.

    ``lanes``: harness, session, ordinal, lane. Each operator turn and the first assistant turn after it (before the next operator's) are one exchange.
    """
    by = Window.partitionBy(*SESSION).orderBy("ordinal")
    asked = turns.filter("kind IN ('operator', 'assistant')").withColumn("exchange", F.sum((F.col("kind") == "operator").cast("long")).over(by)).filter("exchange > 0")
    inside = Window.partitionBy(*SESSION, "exchange").orderBy("ordinal")
    spoken = asked.withColumn("__n", F.row_number().over(inside)).filter("__n <= 2").select(*SESSION, "ordinal", "exchange", (F.col("__n") == 1).alias("__asks"))
    starts = lanes.groupBy(*SESSION, "lane").agg(F.min("ordinal").alias("start")).filter("lane > 0")
    # the number of the last exchange asked before each lane's start, as of its place in the session
    points = spoken.filter("__asks").select(*SESSION, F.col("ordinal").alias("at"), "exchange", F.lit(None).cast("long").alias("lane"), F.lit(0).alias("k"))
    both = points.unionByName(starts.select(*SESSION, F.col("start").alias("at"), F.lit(None).cast("long").alias("exchange"), "lane", F.lit(-1).alias("k")))
    last = F.last("exchange", ignorenulls=True).over(Window.partitionBy(*SESSION).orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0))
    upto = both.withColumn("__last", last).filter("lane IS NOT NULL AND __last IS NOT NULL").select(*SESSION, "lane", F.col("at").alias("start"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("__last") - (exchanges - 1)), F.col("__last"))).alias("exchange"))
    return upto.join(spoken, [*SESSION, "exchange"]).filter("ordinal < start").select(*SESSION, "lane", "ordinal")


def projection(turns: DataFrame, most: int = 16 * 1024, tool: int = 2 * 1024) -> DataFrame:
    """Turns with ``projected`` (a header line and the text, structural lines escaped, cut to whole characters within a byte bound that is lower for tools) and ``omitted`` bytes."""
    plain = escaped(F.coalesce("text", F.lit("")))
    cut = F.when(F.col("kind") == "tool", byte_capped(plain, tool)).otherwise(byte_capped(plain, most))
    header = F.concat(F.lit("## "), F.col("ordinal").cast("string"), F.lit(" "), single_line(F.col("kind")))
    return turns.withColumns({"omitted": (F.octet_length(plain) - F.octet_length(cut)).cast("long"), "projected": F.concat(header, F.lit("\n"), cut)})


def content_digest(projected: DataFrame) -> DataFrame:
    """``harness, session, turns, digest``: SHA-256 over the digests of a session's projections in order: 64 bytes a turn meet, never the texts."""
    each = projected.select(*SESSION, F.struct("ordinal", F.sha2("projected", 256).alias("d")).alias("x"))
    return each.groupBy(*SESSION).agg(F.count("*").alias("turns"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"])), 256).alias("digest"))


def locate(references: DataFrame, sources: DataFrame, turns: DataFrame, lanes: DataFrame, now: DataFrame) -> DataFrame:
    """References ``sN#ordinal`` with their ``status`` and the state of their source.

    ``sources``: source, harness, session, turns, digest (when the workset was made); ``now``: harness, session, turns, digest; ``lanes``: harness, session, ordinal, lane. A source is unchanged, grown (more turns
    than then), changed or unreadable. A reference is malformed, of an unknown source, source-changed, unknown (no such turn), outside-lane, or resolved.
    """
    pattern = r"^(s[0-9]+)#([0-9]+)$"
    parsed = references.withColumns({"source": F.when(F.col("reference").rlike(pattern), F.regexp_extract("reference", pattern, 1)), "ordinal": F.when(F.col("reference").rlike(pattern), F.regexp_extract("reference", pattern, 2).try_cast("long"))})
    then = sources.select("source", *SESSION, F.col("turns").alias("__t"), F.col("digest").alias("__d"))
    today = now.select(*SESSION, F.col("turns").alias("__now"), F.col("digest").alias("__nd"))
    state = F.when(F.col("session").isNull(), None).when(F.col("__now").isNull(), "unreadable").when(F.col("__nd") == F.col("__d"), "unchanged").when(F.col("__now") > F.col("__t"), "grown").otherwise("changed")
    there = turns.select(*SESSION, "ordinal", F.lit(True).alias("__there"))
    placed = lanes.select(*SESSION, "ordinal", F.col("lane").alias("__lane"))
    met = parsed.join(then, "source", "left").join(today, SESSION, "left").join(there, [*SESSION, "ordinal"], "left").join(placed, [*SESSION, "ordinal"], "left").withColumn("state", state)
    status = (
        F.when(F.col("source").isNull() | F.col("ordinal").isNull(), "malformed")
        .when(F.col("session").isNull(), "unknown-source")
        .when(F.col("state").isin("changed", "unreadable"), "source-changed")
        .when(F.col("__there").isNull(), "unknown")
        .when(F.col("lane").isNotNull() & ~F.col("__lane").eqNullSafe(F.col("lane")), "outside-lane")
        .otherwise("resolved")
    )
    return met.withColumn("status", status).select("reference", "lane", "harness", "session", "ordinal", "state", "status")


def trailing_record(records: DataFrame, rendered: DataFrame) -> DataFrame:
    """``harness, session, last, type, trailing``: each recording's last record, and how many records follow its last rendered turn."""
    shown = rendered.groupBy(*SESSION).agg(F.max("line").alias("__shown"))
    met = records.join(shown, SESSION, "left")
    return met.groupBy(*SESSION).agg(F.max("line").alias("last"), F.max_by("type", "line").alias("type"), F.count_if(F.col("line") > F.coalesce("__shown", F.lit(-1))).alias("trailing"))


def child_view(children: DataFrame, turns: DataFrame, usage: DataFrame, endings: DataFrame) -> DataFrame:
    """``name, turns, facts`` and usage of each child, named ``parent/child``."""
    counted = turns.groupBy("session").agg(F.count("*").alias("turns"))
    return (
        children.select("parent", "session", F.concat(F.col("parent").cast("string"), F.lit("/"), F.col("session").cast("string")).alias("name"))
        .join(counted, "session", "left").join(usage, "session", "left").join(endings.select("session", "facts"), "session", "left")
        .withColumn("turns", F.coalesce("turns", F.lit(0)))
    )


def bundles(projected: DataFrame) -> DataFrame:
    """``harness, session, name, ordinal, value``: three views of each session, line by line in order, for a writer of text files.

    ``context.md`` has operator and assistant turns, ``trace.md`` all, ``json`` one object a turn.
    """
    views = F.array(
        F.when(F.col("kind").isin("operator", "assistant"), F.struct(F.lit("context.md").alias("name"), F.col("projected").alias("value"))),
        F.struct(F.lit("trace.md").alias("name"), F.col("projected").alias("value")),
        F.struct(F.lit("json").alias("name"), F.to_json(F.struct("ordinal", "kind", "text")).alias("value")),
    )
    return projected.select(*SESSION, "ordinal", F.explode(F.array_compact(views)).alias("v")).select(*SESSION, "v.name", "ordinal", "v.value")


def export(made: DataFrame, folder: str) -> DataFrame:
    """Write bundles below ``folder``, one directory for each session and view, and return their manifest: harness, session, name, lines, bytes, digest."""
    keyed = made.withColumns({"h": F.col("harness"), "s": F.col("session"), "v": F.col("name")})
    keyed.repartition("h", "s", "v").sortWithinPartitions("h", "s", "v", "ordinal").select("h", "s", "v", "value").write.partitionBy("h", "s", "v").mode("errorifexists").text(folder)
    each = F.struct("ordinal", F.sha2("value", 256).alias("d"))
    manifest = made.groupBy(*SESSION, "name").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("bytes"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(each)), lambda x: x["d"])), 256).alias("digest"))
    return manifest
