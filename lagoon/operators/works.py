"""Consumption divided among work: one sweep over a session's edges and requests, and the layers that come of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.intervals import micros
from lagoon.storage import materialize

#: Tiers and bases from the strongest on.
TIERS = ("bound", "matched", "estimated")
BASES = ("span", "event-window", "working-stretch", "inherited", "even", "following")
COVERS = pa.list_(pa.struct([("work", pa.string()), ("tier", pa.string()), ("basis", pa.string())]))
SWEPT = "is_request boolean, segment bigint, from_us bigint, to_us bigint, covers array<struct<work: string, tier: string, basis: string>>, runs array<string>, request bigint"


def place_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value) - 1


def evidence_edges(spans: DataFrame, events: DataFrame | None, keys: list[str]) -> DataFrame:
    """``keys, work, run, from_us, to_us, tier, basis`` (ranks): spans, and of each item's events the window from the first to the last, of their weakest tier."""
    span = spans.select(
        *keys, "work", F.col("run") if "run" in spans.columns else F.lit(None).cast("string").alias("run"), micros(F.col("from")).alias("from_us"), micros(F.col("to")).alias("to_us"),
        place_of(F.col("tier"), TIERS).cast("int").alias("tier"), F.lit(0).alias("basis"),
    )
    if events is None:
        return span
    stamp = micros(F.col("at"))
    window = events.groupBy(*keys, "work").agg(F.min(stamp).alias("from_us"), (F.max(stamp) + 1).alias("to_us"), F.max(place_of(F.col("tier"), TIERS)).cast("int").alias("tier"))
    return span.unionByName(window.select(*keys, "work", F.lit(None).cast("string").alias("run"), "from_us", "to_us", "tier", F.lit(1).alias("basis")))


def _sweep(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, instant and turn (ends and starts before requests): keys, at, turn, work, run, tier, basis, request.

    Holds the open works of one session: each with how often each of its evidences is open.
    """
    key: tuple | None = None
    schema: list[pa.DataType] = []
    out: list[list] = []
    works: dict[str, dict[tuple[int, int], int]] = {}
    runs: dict[str, int] = {}
    segment, since, dirty = 0, None, None

    def emit(is_request: bool, until: int | None, request: int | None = None) -> None:
        covers = None if is_request else [{"work": w, "tier": TIERS[min(e)[0]], "basis": BASES[min(e)[1]]} for w, e in sorted(works.items())]
        out.append([*key, is_request, segment, None if is_request else since, until, covers, None if is_request else sorted(runs), request])

    def batch_of() -> pa.RecordBatch:
        types = [*schema, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), COVERS, pa.list_(pa.string()), pa.int64()]
        columns = list(zip(*out)) or [()] * len(types)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f"c{i}" for i in range(len(types))])
        out.clear()
        return made

    def change(held: dict, name: object, by: int) -> None:
        held[name] = held.get(name, 0) + by
        if held[name] == 0:
            del held[name]

    for batch in batches:
        schema = [batch.schema.field(i).type for i in range(keys)]
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            mine, (at, turn, work, run, tier, basis, request) = row[:keys], row[keys:]
            if len(out) >= 8192:
                yield batch_of()
            if mine != key:
                if key is not None:
                    emit(False, None)
                key, segment, since, dirty = mine, 0, None, None
                works.clear()
                runs.clear()
            if turn == 2:
                if at is not None:
                    emit(True, None, request)
                continue
            if at != dirty:  # the first edge of an instant ends a segment
                emit(False, at)
                segment, since, dirty = segment + 1, at, at
            by = 1 if turn else -1
            if work is not None:
                held = works.setdefault(work, {})
                change(held, (tier, basis), by)
                if not held:
                    del works[work]
            if run is not None:
                change(runs, run, by)
    if key is not None:
        emit(False, None)
    if out:
        yield batch_of()


def sweep(edges: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(segments, placed)``: each session cut at every edge, with what covers each segment, and the segment of each request.

    ``edges`` as of ``evidence_edges``; ``requests``: keys, at, request (a number). ``segments``: keys, segment (from 0), from_us, to_us (null: open), covers (work, tier and basis of its strongest evidence, by work), runs.
    ``placed``: keys, request, segment; requests without time are in none. Edges and requests of a session pass once, in order; a task remembers the open works. Empty and reversed spans cover nothing but cut.
    """
    none = {"work": "string", "run": "string", "tier": "int", "basis": "int", "request": "bigint"}
    columns = [*keys, "at", "turn", *none]

    def row(frame: DataFrame, at: Column, turn: Column, *held: str) -> DataFrame:
        return frame.withColumns({"at": at, "turn": turn}).select(*keys, "at", "turn", *[F.col(c).cast(t).alias(c) if c in held else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    sound = F.col("to_us").isNull() | (F.col("from_us") < F.col("to_us"))
    known = edges.filter("from_us IS NOT NULL")
    rows = (
        row(known.filter(sound), F.col("from_us"), F.lit(1), "work", "run", "tier", "basis")
        .unionByName(row(known.filter(sound & F.col("to_us").isNotNull()), F.col("to_us"), F.lit(0), "work", "run", "tier", "basis"))
        .unionByName(row(known.filter(~sound).select(*keys, F.explode(F.array("from_us", "to_us")).alias("x")), F.col("x"), F.lit(1)))
        .unionByName(row(requests.select(*keys, micros(F.col("at")).alias("x"), "request"), F.col("x"), F.lit(2), "request"))
    )
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("at").asc_nulls_last(), "turn").select(*columns)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    n = len(keys)
    swept = materialize(ordered.mapInArrow(lambda b: _named(_sweep(b, n), [*keys]), ", ".join([*[f"`{k}` {types[k]}" for k in keys], SWEPT])))
    segments = swept.filter("NOT is_request").select(*keys, "segment", "from_us", "to_us", "covers", "runs")
    return segments, swept.filter("is_request").select(*keys, "request", "segment")


def _named(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    names = [*keys, *[x.strip().split()[0] for x in ("is_request", "segment", "from_us", "to_us", "covers", "runs", "request")]]
    for batch in batches:
        yield batch.rename_columns(names)


def with_reasons(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with ``n`` (works), ``reason`` (null where one work alone covers it) and ``next`` (the cover of the first later segment that has one alone)."""
    by = Window.partitionBy(*keys)
    ahead = by.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that grows: one that shrinks is read anew for each row
    n = F.size("covers")
    covered = F.when(n > 0, F.col("segment"))
    first, last = F.min(covered).over(by), F.max(covered).over(by)
    reason = (
        F.when(n == 1, None).when(n > 1, "overlap").when(first.isNull() | (F.col("segment") < first), "before-first-item").when(F.col("segment") > last, "after-last-item").otherwise("between-items")
    )
    return segments.withColumns({"n": n, "reason": reason, "next": F.last(F.when(n == 1, F.element_at("covers", 1)), ignorenulls=True).over(ahead)})


def divide(
    spans: DataFrame, events: DataFrame | None, requests: DataFrame, keys: list[str], counters: tuple[str, ...], estimated: tuple[str, str] | None = None, tiers: tuple[str, ...] = TIERS, away: str | None = None
) -> DataFrame:
    """``keys, layer, segment, work, tier, basis, reason, requests`` and ``counters``: every request of every session, in each of four layers, given to an item or to no one.

    ``spans``: keys, work, from, to, tier (and run); ``events``: keys, work, at, tier; ``requests``: keys, at, counters, and, if ``estimated`` names the two, the work and tier that its working stretch suggests, and, if
    ``away`` names it, whether the session was elsewhere. Layers: ``conserving`` gives a segment to the one work that covers it. ``estimated`` gives the requests of segments that
    nothing covers to their estimates too (basis working-stretch). ``even`` shares out overlapped segments, each counter in whole numbers, the first works by name getting
    what is left over; ``requests`` of such a share counts those it has a part of. ``following`` is the estimate, and what is left between items goes to the next segment's item. The rest has a reason: before-first-item, between-items, after-last-item,
    overlap, elsewhere (an estimate whose request was made outside of the repository), request-time-unrecorded, or tiers-not-asked where only evidence of tiers not in ``tiers`` would give it to an item.
    Each layer's rows add up to the whole, for every counter.
    """
    numbered = materialize(requests.withColumn("request", F.monotonically_increasing_id()))
    full = _layers(spans, events, numbered, keys, counters, estimated, away)
    if len(tiers) == len(TIERS):
        return _summed(full, keys, counters)
    asked = F.col("tier").isin(*tiers)
    part = _layers(spans.filter(asked), None if events is None else events.filter(asked), _without(numbered, estimated, tiers), keys, counters, estimated, away)
    unowned = F.element_at("owners", 1)["work"].isNull()
    owned = full.filter(~unowned).select(F.col("layer").alias("l"), F.col("request").alias("r")).distinct()
    joined = part.join(owned, (F.col("layer") == F.col("l")) & (F.col("request") == F.col("r")), "left")
    only = F.col("r").isNotNull() & unowned & ~F.col("reason").isin("elsewhere", "request-time-unrecorded")
    return _summed(joined.withColumn("reason", F.when(only, "tiers-not-asked").otherwise(F.col("reason"))).drop("l", "r"), keys, counters)


def _without(requests: DataFrame, estimated: tuple[str, str] | None, tiers: tuple[str, ...]) -> DataFrame:
    """Requests without estimates of tiers that aren't asked for."""
    if estimated is None:
        return requests
    kept = F.col(estimated[1]).isin(*tiers)
    return requests.withColumns({c: F.when(kept, F.col(c)) for c in estimated})


def _layers(spans: DataFrame, events: DataFrame | None, requests: DataFrame, keys: list[str], counters: tuple[str, ...], estimated: tuple[str, str] | None, away: str | None) -> DataFrame:
    """One row for each layer, request and owner, before they are added up."""
    cut, placed = sweep(evidence_edges(spans, events, keys), requests.select(*keys, "at", "request"), keys)
    judged = with_reasons(cut, keys).select(*keys, "segment", "covers", "n", "reason", "next")
    guess = F.struct(F.col(estimated[0]).alias("work"), F.col(estimated[1]).alias("tier"), F.lit("working-stretch").alias("basis")) if estimated else None
    gone = F.coalesce(F.col(away), F.lit(False)) if away else F.lit(False)
    held = requests.select("request", *counters, *([guess.alias("guess")] if estimated else [F.lit(None).cast("struct<work: string, tier: string, basis: string>").alias("guess")]), gone.alias("gone"))
    there = placed.join(held, "request").join(judged, [*keys, "segment"])
    alone = F.when(F.col("n") == 1, F.element_at("covers", 1))
    suggested = F.when((F.col("n") == 0) & F.col("guess.work").isNotNull() & ~F.col("gone"), F.col("guess"))
    lost = (F.col("n") == 0) & F.col("guess.work").isNotNull() & F.col("gone")
    onward = F.when(F.col("reason") == "between-items", F.struct(F.col("next.work").alias("work"), F.col("next.tier").alias("tier"), F.lit("following").alias("basis")))
    onward = F.when(onward["work"].isNotNull() & ~lost, onward)
    even = F.transform("covers", lambda c: F.struct(c["work"].alias("work"), c["tier"].alias("tier"), F.lit("even").alias("basis")))
    owners = {
        "conserving": F.array(alone),
        "estimated": F.array(F.coalesce(alone, suggested)),
        "even": F.when(F.col("n") > 1, even).otherwise(F.array(alone)),
        "following": F.array(F.coalesce(alone, suggested, onward)),
    }
    layers = F.array(*[F.struct(F.lit(name).alias("layer"), value.alias("owners")) for name, value in owners.items()])
    each = there.withColumn("x", F.explode(layers)).select("*", F.col("x.layer").alias("layer"), F.col("x.owners").alias("owners"))
    why = F.when(F.element_at("owners", 1)["work"].isNull(), F.when(lost & F.col("layer").isin("estimated", "following"), "elsewhere").otherwise(F.col("reason")))
    timed = each.select(*keys, "request", "layer", "segment", "owners", why.alias("reason"), *counters)
    untimed = requests.filter("at IS NULL").select(
        *keys, "request", F.explode(F.array(*[F.lit(n) for n in owners])).alias("layer"), F.lit(None).cast("bigint").alias("segment"),
        F.array(F.lit(None).cast("struct<work: string, tier: string, basis: string>")).alias("owners"), F.lit("request-time-unrecorded").alias("reason"), *counters,
    )
    return timed.unionByName(untimed)


def _summed(rows: DataFrame, keys: list[str], counters: tuple[str, ...]) -> DataFrame:
    """Counters by segment and owners, and then of each owner: of several, whole-numbered shares of the segment's sum."""
    by = rows.groupBy(*keys, "layer", "segment", "owners", "reason").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in counters])
    each = by.withColumn("of", F.size("owners")).select("*", F.posexplode("owners").alias("i", "owner"))
    share = [(F.expr(f"{c} div of") + (F.col("i") < F.pmod(F.col(c), F.col("of"))).cast("bigint")).alias(c) for c in counters]
    return each.select(*keys, "layer", "segment", "owner.work", "owner.tier", "owner.basis", "reason", "requests", *share)


def shares(divided: DataFrame, keys: list[str], counters: tuple[str, ...]) -> DataFrame:
    """Each layer's shares: what an item holds by tier and basis, and what no item holds by reason."""
    return divided.groupBy(*keys, "layer", "work", "tier", "basis", "reason").agg(F.sum("requests").alias("requests"), *[F.sum(c).alias(c) for c in counters])


def selection(divided: DataFrame, chosen: DataFrame, totals: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """``keys, layer, figure, unselected, unattributed, reasons``: a view that selects the works ``chosen``.

    ``figure`` is what they hold, ``unselected`` what other items do, ``unattributed`` the rest. ``reasons`` says why the figure isn't the whole: those of unattributed requests, ``unselected-item``, and
    ``recorded-total-not-splittable`` where the session's own recorded total (``totals``: keys, total) isn't what its requests add up to.
    """
    picked = chosen.select(F.col("work").alias("w")).distinct()
    held = divided.join(picked, F.col("work") == F.col("w"), "left")
    mine, other, free = F.col("w").isNotNull(), F.col("w").isNull() & F.col("work").isNotNull(), F.col("work").isNull()
    why = F.when(free & (F.col("requests") > 0), F.col("reason")).when(other & (F.col("requests") > 0), "unselected-item")
    by = held.groupBy(*keys, "layer").agg(
        *[F.coalesce(F.sum(F.when(c, F.col(counter))), F.lit(0)).alias(n) for n, c in (("figure", mine), ("unselected", other), ("unattributed", free))], F.collect_set(why).alias("r")
    )  # nine reasons at most
    joined = by.join(totals.select(*keys, "total"), keys, "left")
    whole = F.col("figure") + F.col("unselected") + F.col("unattributed")
    odd = F.when(F.col("total").isNotNull() & (F.col("total") != whole), F.array(F.lit("recorded-total-not-splittable"))).otherwise(F.array().cast("array<string>"))
    return joined.select(*keys, "layer", "figure", "unselected", "unattributed", F.array_sort(F.concat("r", odd)).alias("reasons"))
