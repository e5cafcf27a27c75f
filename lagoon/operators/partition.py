"""Sessions divided over commits by what they did: commits they made, edits that commits hold, stays at a branch, and commits close by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.changes import estimate_windows
from lagoon.operators.evidence import edit_overlap
from lagoon.operators.works import TIERS, divide

UNCOMMITTED = "uncommitted:"


def matched_edits(edits: DataFrame, commits: DataFrame, share: float = 0.5, least: int = 2, before_s: int = 3600, after_s: int = 7 * 86_400) -> DataFrame:
    """``session, at, work``: edits with the commit that adds most of their lines among those written from ``before_s`` seconds before the edit to ``after_s`` after it.

    ``edits``: edit, session, at, digests. ``commits``: sha, author, digests. Of commits that hold as much of an edit the nearest in time counts, then the first by name.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = edits.select("edit", "session", "at", micros("at").alias("us"), _set_of("digests").alias("lines"))
    # commits of the same lines written at one instant differ by name alone
    wrote = commits.select(_set_of("digests").alias("adds"), micros("author").alias("us"), "sha").filter("us IS NOT NULL").groupBy("adds", "us").agg(F.min("sha").alias("sha"))
    of_edits, of_commits = asked.select(F.col("lines").alias("edit"), F.col("lines").alias("digests")).distinct(), wrote.select(F.col("adds").alias("sha"), F.col("adds").alias("digests")).distinct()
    met = edit_overlap(of_edits, of_commits, share, least).select(F.col("edit").alias("lines"), F.col("sha").alias("adds"), "overlap")
    # the nearest commit of each set is the last before an edit or the first from it on: an ordered pass by set finds both, spans of time of the wider bound share it out
    width = max(before_s, after_s, 1) * 1_000_000
    cell = F.expr(f"us div {width}L")
    points = asked.join(met, "lines").select("adds", cell.alias("cell"), "us", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("sha"), F.struct("edit", "session", "at", "overlap").alias("x"))
    own = wrote.join(met.select("adds").distinct(), "adds", "left_semi").withColumn("cell", cell)
    ends = own.groupBy("adds", "cell").agg(F.min(F.struct("us", "sha")).alias("low"), F.max(F.struct("us", "sha")).alias("high"))
    lent = ends.select("adds", (F.col("cell") - 1).alias("cell"), "low.*").unionByName(ends.select("adds", (F.col("cell") + 1).alias("cell"), "high.*"))
    marks = own.select("adds", "cell", "us", "sha").unionByName(lent).select("adds", "cell", "us", F.lit(0).alias("turn"), "sha", F.lit(None).cast(points.schema["x"].dataType).alias("x"))
    of = Window.partitionBy("adds", "cell")
    up, down = (of.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("us", "turn"), (F.desc("us"), F.desc("turn"))))  # frames that grow: one that shrinks is read anew for each row
    mark = F.when(F.col("turn") == 0, F.struct("us", "sha"))
    found = points.unionByName(marks).withColumns({"behind": F.last(mark, ignorenulls=True).over(up), "ahead": F.last(mark, ignorenulls=True).over(down)}).filter("turn = 1")
    each = found.select("x.*", F.col("us").alias("mine"), F.explode(F.array("behind", "ahead")).alias("c")).withColumn("late", F.col("c.us") - F.col("mine"))
    near = each.filter(F.col("late").between(-before_s * 1_000_000, after_s * 1_000_000))
    best = near.groupBy("edit").agg(F.min_by(F.struct("session", "at", F.col("c.sha").alias("work")), F.struct(-F.col("overlap"), F.abs("late"), F.col("c.sha"))).alias("b"))
    return best.select("b.*")


def _set_of(digests: str) -> Column:
    return F.array_sort(F.array_distinct(digests))


def stay_spans(stays: DataFrame, created: DataFrame) -> DataFrame:
    """``session, work, from, to``: a stay's time up to each commit that the session made there is that commit's, from the one before on; what follows its last is uncommitted work at the place.

    ``stays``: session, from, to, place (null outside of the repository); those of a session don't overlap. ``created``: session, at, sha. A stay without a commit of its own gives no span.
    """
    begin = stays.select("session", F.col("from").alias("at"), F.lit(0).alias("turn"), F.struct("from", "to", "place").alias("stay"), F.lit(None).cast("string").alias("sha"))
    made = created.select("session", "at", F.lit(1).alias("turn"), F.lit(None).cast(begin.schema["stay"].dataType).alias("stay"), "sha")
    by = Window.partitionBy("session").orderBy(F.col("at").asc_nulls_first(), "turn", "sha").rowsBetween(Window.unboundedPreceding, 0)
    inside = begin.unionByName(made).withColumn("stay", F.last("stay", ignorenulls=True).over(by)).filter("turn = 1 AND stay.place IS NOT NULL AND (stay.to IS NULL OR at < stay.to)")
    one = F.expr("INTERVAL 1 MICROSECOND")
    # commits made at one instant share the time before it
    of = Window.partitionBy("session", "stay")
    points = inside.withColumn("end", F.col("at") + one)
    before = F.max("end").over(of.orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1))
    spans = points.select("session", F.col("sha").alias("work"), F.coalesce(before, F.col("stay.from")).alias("from"), F.col("end").alias("to"))
    last = points.groupBy("session", "stay").agg(F.max("end").alias("from"))
    rest = last.select("session", F.concat(F.lit(UNCOMMITTED), "stay.place").alias("work"), "from", F.col("stay.to").alias("to"))
    return spans.unionByName(rest.filter("to IS NULL OR from < to"))


def near_commits(requests: DataFrame, commits: DataFrame, proximity_s: int = 1800) -> DataFrame:
    """``session, at, work``: commits written within ``proximity_s`` seconds of a session's request, at the commit's time: they only estimate.

    Both sides meet by spans of time of that length, each commit in its own and the two beside it.
    """
    width = proximity_s * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = requests.filter("at IS NOT NULL").select("session", micros("at").alias("us")).withColumn("cell", F.expr(f"us div {width}L")).distinct()
    wrote = commits.select("sha", "author", micros("author").alias("c")).withColumn("cell", F.explode(F.expr(f"sequence(c div {width}L - 1, c div {width}L + 1)")))
    met = asked.join(wrote, "cell").filter(F.abs(F.col("us") - F.col("c")) <= width)
    return met.select("session", F.col("author").alias("at"), F.col("sha").alias("work")).distinct()


def guiding_commits(requests: DataFrame, commits: DataFrame, proximity_s: int = 1800) -> DataFrame:
    """Of ``near_commits`` those that can be next to a request: at most four instants for each, and of an instant the first and the last name.

    ``requests`` with ``away``; requests made elsewhere bring no commits near, but may be followed by those of others. A session's commits close by are those within ``proximity_s`` of its requests at hand. The first of them from any
    instant on is the first commit of all, unless that isn't close; then none lies between it and the span of a request at hand, and it is the first commit of that span. So the first from and the last before each request,
    and the first and the last of each request's span, hold every answer, and a row is made for each request, not for each pair.
    """
    width = proximity_s * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = requests.filter("at IS NOT NULL").groupBy("session", micros("at").alias("m")).agg(F.bool_or(~F.coalesce("away", F.lit(False))).alias("here"))
    wrote = commits.select(micros("author").alias("us"), "sha").filter("us IS NOT NULL").groupBy("us").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).withColumn("cell", F.expr(f"us div {2 * width}L"))
    # at one instant: questions for the last before it, commits, questions for the first from it on are asked before the commits, for the last up to it after them
    ask = lambda us, turn, on: F.struct((F.col("m") + us).alias("us"), F.lit(turn).alias("turn"), F.lit(on).alias("onward"))
    always, close = [ask(0, 0, True), ask(0, 0, False)], [ask(-width, 0, True), ask(width, 2, False)]
    questions = asked.withColumn("q", F.explode(F.when(F.col("here"), F.array(*always, *close)).otherwise(F.array(*always)))).select("session", "m", "here", "q.*").withColumn("cell", F.expr(f"us div {2 * width}L"))
    ends = wrote.groupBy("cell").agg(F.min(F.struct("us", "low", "high")).alias("a"), F.max(F.struct("us", "low", "high")).alias("z"))
    lent = ends.select((F.col("cell") - 1).alias("cell"), "a.*").unionByName(ends.select((F.col("cell") + 1).alias("cell"), "z.*"))
    marks = wrote.select("cell", "us", "low", "high").unionByName(lent)
    rows = questions.select("cell", "us", "turn", F.struct("session", "onward").alias("x")).distinct()
    both = rows.withColumns({"low": F.lit(None).cast("string"), "high": F.lit(None).cast("string")}).unionByName(marks.select("cell", "us", F.lit(1).alias("turn"), F.lit(None).cast(rows.schema["x"].dataType).alias("x"), "low", "high"))
    of = Window.partitionBy("cell")
    up, down = (of.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("us", "turn"), (F.desc("us"), F.desc("turn"))))
    mark = F.when(F.col("turn") == 1, F.struct("us", "low", "high"))
    found = both.withColumns({"behind": F.last(mark, ignorenulls=True).over(up), "ahead": F.last(mark, ignorenulls=True).over(down)}).filter("turn <> 1").select("x.session", F.when(F.col("x.onward"), F.col("ahead")).otherwise(F.col("behind")).alias("c"))
    met = found.filter("c IS NOT NULL").select("session", "c.*").distinct()
    # close: a request at hand lies within the bound
    there = asked.filter("here").select("session", F.col("m").alias("us"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"), F.col("m").alias("r"))
    of = Window.partitionBy("session")
    sided = met.withColumn("r", F.lit(None).cast("long")).unionByName(there).withColumns({"b": F.last("r", ignorenulls=True).over(of.orderBy("us")), "f": F.last("r", ignorenulls=True).over(of.orderBy(F.desc("us")))})
    kept = sided.filter(f"low IS NOT NULL AND (us - b <= {width} OR f - us <= {width})")
    kind = commits.schema["author"].dataType
    return kept.select("session", F.timestamp_micros("us").cast(kind).alias("at"), F.explode(F.array_distinct(F.array("low", "high"))).alias("work"))


def session_partition(
    requests: DataFrame, stays: DataFrame, created: DataFrame, edits: DataFrame, commits: DataFrame, counters: tuple[str, ...], tiers: tuple[str, ...] = TIERS, proximity_s: int = 1800, **matching: object
) -> DataFrame:
    """``session, segment, work, tier, basis, reason, requests`` and ``counters``: each session's whole consumption divided over commits, uncommitted work and reasons.

    ``requests``: session, stretch, at, counters, away (whether made outside of the repository). ``created``: session, at, sha (resolved): bound events. Edits that commits hold are matched events, stays up to own commits matched
    spans, commits close to a request cues: they estimate like events and cover nothing. Working stretches give the time that nothing covers to their next event or cue, else to their last; time that several
    items cover is split evenly. The rows add up to the session's whole.
    """
    bound = created.select("session", "at", F.col("sha").alias("work"), F.lit("bound").alias("tier"))
    matched = matched_edits(edits, commits, **matching).withColumn("tier", F.lit("matched"))
    events = bound.unionByName(matched)
    spans = stay_spans(stays, created).withColumn("tier", F.lit("matched"))
    cues = guiding_commits(requests, commits, proximity_s).withColumn("tier", F.lit("estimated"))
    # an event speaks in the stretch that its time falls into: the last begun at or before it
    starts = requests.filter("at IS NOT NULL").groupBy("session", "stretch").agg(F.min("at").alias("t")).select("session", "t", F.lit(0).alias("turn"), F.col("stretch"), F.lit(None).cast("string").alias("work"), F.lit(None).cast("string").alias("tier"))
    marks = events.unionByName(cues).select("session", F.col("at").alias("t"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("stretch"), "work", "tier")
    by = Window.partitionBy("session").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min_by("stretch", F.when(F.col("turn") == 0, F.col("t"))).over(Window.partitionBy("session"))
    placed = starts.unionByName(marks).withColumn("stretch", F.coalesce(F.last("stretch", ignorenulls=True).over(by), first)).filter("turn = 1")
    joint = F.concat_ws(" ", F.format_string("%d", F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))), "work")
    strongest = placed.withColumn("x", joint).filter(F.col("tier").isin(*tiers)).groupBy("session", "stretch", F.col("t").alias("at"), "work").agg(F.min("x").alias("x"))
    guessed = estimate_windows(requests, strongest.select("session", "stretch", "at", F.concat("work", F.lit("\n"), F.substring("x", 1, 1)).alias("work")), ["session", "stretch"])
    parts = F.split("work", "\n")
    told = guessed.withColumns({"guess": F.element_at(parts, 1), "guess_tier": F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.element_at(parts, 2).cast("int"))}).drop("work")
    divided = divide(spans, events, told.select("session", "at", *counters, "guess", "guess_tier", "away"), ["session"], counters, ("guess", "guess_tier"), tiers, "away")
    kept = divided.filter("(layer = 'estimated' AND NOT (work IS NULL AND reason = 'overlap')) OR (layer = 'even' AND basis = 'even')")
    return kept.drop("layer")


def usage_by_change(partition: DataFrame, chosen: DataFrame | None, counters: tuple[str, ...]) -> DataFrame:
    """``share, work, requests`` and counters: of the commits chosen (sha; all if None), what other commits hold, uncommitted work by place, and what is unattributed by reason.

    The rows add up to the whole that was divided.
    """
    picked = partition if chosen is None else partition.join(chosen.select(F.col("sha").alias("c")).distinct(), F.col("work") == F.col("c"), "left")
    mine = F.lit(True) if chosen is None else F.col("c").isNotNull()
    loose = F.startswith("work", F.lit(UNCOMMITTED))
    share = F.when(F.col("work").isNull(), "unattributed").when(loose, "uncommitted").when(mine, "commit").otherwise("unselected")
    name = F.when(F.col("work").isNull(), F.col("reason")).when(loose | mine, F.col("work"))
    return picked.groupBy(share.alias("share"), name.alias("work")).agg(F.sum("requests").alias("requests"), *[F.sum(c).alias(c) for c in counters])
