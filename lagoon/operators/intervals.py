"""Stretches of time laid over each other: one ordered pass for each session, no join by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.lineage import roots
from lagoon.storage import materialize, spread

#: Stand for the beginning and the end of time.
FIRST, LAST = -(1 << 62), 1 << 62


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def overlay(pieces: DataFrame, covers: DataFrame, keys: list[str], carried: list[str], given: list[str], rows: int = 0) -> DataFrame:
    """``keys, from, to``, the columns ``carried`` of ``pieces`` and ``given`` of ``covers``, and ``covered``: pieces cut where covers begin and end.

    Both have ``from`` and ``to`` (null: open); [from, to) of the pieces of one key don't overlap each other, nor do those of the covers. The parts of a piece make up the piece; touching parts
    with the same cover, or both without, are one. Empty stretches are left out. Some ``rows`` of both together are dealt over as many tasks as they need.
    """
    kind = pieces.schema["from"].dataType
    begin, end = F.coalesce(micros(F.col("from")), F.lit(FIRST)), F.coalesce(micros(F.col("to")), F.lit(LAST))

    def edges(rows: DataFrame, side: str, held: list[str]) -> DataFrame:
        timed = rows.select(*keys, begin.alias("b"), end.alias("e"), F.struct(F.lit(True).alias("there"), *held).alias("x")).filter("b < e")
        nothing = F.lit(None).cast(timed.schema["x"].dataType)
        open_ = timed.select(*keys, F.col("b").alias("at"), F.lit(1).alias("turn"), F.col("x"), F.col("b").alias("mark"))
        close = timed.select(*keys, F.col("e").alias("at"), F.lit(0).alias("turn"), nothing.alias("x"), F.lit(None).cast("long").alias("mark"))
        both = open_.unionByName(close)
        return both.select(*keys, "at", "turn", F.struct("x", "mark").alias(side))

    a, b = edges(pieces, "piece", carried), edges(covers, "cover", given)
    union = spread(a.unionByName(b, allowMissingColumns=True), rows, *keys)
    # at one instant closings come before openings: the last edge of the instant holds what is open after it
    by = Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    state = union.select(*keys, "at", "turn", *[F.last(s, ignorenulls=True).over(by).alias(s) for s in ("piece", "cover")])
    last = Window.partitionBy(*keys).orderBy("at", "turn")
    parts = state.withColumn("till", F.lead("at").over(last)).filter("at < till AND piece.x IS NOT NULL")
    # parts of one piece under one cover belong together
    joined = parts.groupBy(*keys, F.col("piece.mark").alias("p"), F.col("cover.mark").alias("c"), F.when(F.col("cover.x").isNull(), F.col("at")).alias("free")).agg(
        F.min("at").alias("at"), F.max("till").alias("till"), F.any_value("piece.x").alias("px"), F.any_value("cover.x").alias("cx")
    )
    span = [F.when(F.col(c) != edge, F.timestamp_micros(c)).cast(kind).alias(n) for c, edge, n in (("at", FIRST, "from"), ("till", LAST, "to"))]
    return joined.select(*keys, *span, *[F.col(f"px.{c}").alias(c) for c in carried], *[F.col(f"cx.{c}").alias(c) for c in given], F.col("cx").isNotNull().alias("covered"))


def subtract(pieces: DataFrame, covers: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """What is left of the pieces outside of the covers."""
    return overlay(pieces, merged(covers, keys), keys, carried, []).filter("NOT covered").drop("covered")


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, from, to``: the time that any of the spans covers, in stretches that neither overlap nor touch."""
    kind = spans.schema["from"].dataType
    timed = spans.select(*keys, F.coalesce(micros(F.col("from")), F.lit(FIRST)).alias("b"), F.coalesce(micros(F.col("to")), F.lit(LAST)).alias("e")).filter("b < e")
    by = Window.partitionBy(*keys).orderBy("b", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = timed.withColumn("new", F.coalesce(F.col("b") > reach, F.lit(True)).cast("int"))
    numbered = begun.withColumn("island", F.sum("new").over(by))
    found = numbered.groupBy(*keys, "island").agg(F.min("b").alias("b"), F.max("e").alias("e"))
    return found.select(*keys, F.when(F.col("b") != FIRST, F.timestamp_micros("b")).cast(kind).alias("from"), F.when(F.col("e") != LAST, F.timestamp_micros("e")).cast(kind).alias("to"))


OWNED = ["work", "tier", "basis", "reason"]


def elsewhere(locations: DataFrame, keys: list[str], path: str) -> DataFrame:
    """``keys, from, to``: when a session worked outside of ``path``, from its recorded ``directory`` at each ``at``; each place holds until the next."""
    by = Window.partitionBy(*keys).orderBy("at", "directory")
    held = locations.filter("at IS NOT NULL").withColumn("to", F.lead("at").over(by))
    inside = (F.col("directory") == path) | F.startswith("directory", F.lit(f"{path.rstrip('/')}/"))
    return merged(held.filter(~F.coalesce(inside, F.lit(False))).select(*keys, F.col("at").alias("from"), "to"), keys)


def cut_elsewhere(owned: DataFrame, away: DataFrame, keys: list[str]) -> DataFrame:
    """``owned`` (keys, from, to, work, tier, basis, reason) with the parts of working-stretch estimates that lie in ``away`` given to no one: reason ``elsewhere``.

    A stretch's evidence speaks for a repository only while the session was in it; spans and event windows stay whole.
    """
    estimated = F.coalesce(F.col("basis") == "working-stretch", F.lit(False))
    cut = overlay(owned.filter(estimated), merged(away, keys), keys, OWNED, [])
    gone = F.col("covered")
    freed = cut.select(*keys, "from", "to", *[F.when(~gone, F.col(c)).alias(c) for c in ("work", "tier", "basis")], F.when(gone, "elsewhere").otherwise(F.col("reason")).alias("reason"))
    return owned.filter(~estimated).select(*keys, "from", "to", *OWNED).unionByName(freed)


def inherit(owned: DataFrame, lineage: DataFrame, levels: int = 32) -> DataFrame:
    """``owned`` (session, from, to, work, tier, basis, reason) with what a child leaves unattributed given to the owner of the same time of its parent, basis ``inherited``.

    ``lineage``: session, parent. Parents are settled before their children, a generation a round, so owners come down from
    any ancestor within ``levels``. Time that is ``elsewhere``, and what the parent leaves unattributed too, stays as it was. The parts of a piece make up the piece.
    """
    owned = materialize(owned.select("session", "from", "to", *OWNED))
    rows = owned.count()
    depth = materialize(roots(lineage, levels).select("session", "depth").join(lineage.select("session", "parent"), "session"))
    settled = owned.join(depth.filter("depth > 0").select("session"), "session", "left_anti").select("session", "from", "to", *OWNED)
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    before = settled = materialize(settled)
    for n in range(1, min(deepest, levels) + 1):
        here = owned.join(depth.filter(F.col("depth") == n).select("session", "parent"), "session")
        heir = F.col("work").isNull() & (F.coalesce("reason", F.lit("")) != "elsewhere")
        held = before.filter("work IS NOT NULL").select(F.col("session").alias("parent"), "from", "to", F.col("work").alias("w"), F.col("tier").alias("t"))
        asks = here.filter(heir)
        gives = asks.select("session", "parent").distinct().join(held, "parent").select("session", "from", "to", "w", "t")
        parts = overlay(asks.select("session", "from", "to", *OWNED), gives, ["session"], OWNED, ["w", "t"], 4 * rows)
        taken = parts.select(
            "session", "from", "to", F.col("w").alias("work"), F.col("t").alias("tier"), F.when(F.col("covered"), "inherited").otherwise(F.col("basis")).alias("basis"), F.when(~F.col("covered"), F.col("reason")).alias("reason")
        )
        before = materialize(here.filter(~heir).select("session", "from", "to", *OWNED).unionByName(taken))
        settled = settled.unionByName(before)
    return settled
