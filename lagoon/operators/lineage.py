"""Relatives: roots of chains, families, overlapping recordings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon import storage
from lagoon.operators.components import connected_components, least_reached
from lagoon.storage import discard, materialize, sent, spread


def _linked(sessions: DataFrame) -> DataFrame:
    """``session, up``: the parent where it is recorded. Sessions without one aren't joined: their keys are null, and one task would get them all."""
    given = materialize(sessions.select("session", "parent"))
    known = given.select(F.col("session").alias("__s"))
    held = given.filter("parent IS NOT NULL").join(known, F.col("parent") == F.col("__s"), "left").select("session", F.col("__s").alias("up"))
    return held.unionByName(given.filter("parent IS NULL").select("session", F.col("parent").alias("up")))


def roots(sessions: DataFrame, levels: int = 32) -> DataFrame:
    """``session, root, depth``: the end of each session's chain of parents, at most ``levels`` up.

    Pointers double in each round, so five joins follow 32 levels. A chain that meets itself or is
    longer stops at ``levels``; a parent that isn't there ends the chain before it.
    """
    link = _linked(sessions).select("session", F.coalesce("up", "session").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"))
    step = 1
    while step < levels:
        link = materialize(link)
        up = link.select(F.col("session").alias("__u"), F.col("root").alias("__r"), F.col("depth").alias("__d"))
        link = link.join(up, F.col("root") == F.col("__u")).select("session", F.col("__r").alias("root"), (F.col("depth") + F.col("__d")).alias("depth"))
        step *= 2
    return link


def root_of(sessions: DataFrame) -> DataFrame:
    """``session, root``: the end of each session's chain of parents, however long: pointers double until none moves.

    Only sessions whose pointer still moves take part in a round. Sessions of a circle keep the session their last pointer met.
    """
    link = materialize(_linked(sessions))
    done = link.filter("up IS NULL").select("session", F.col("session").alias("root"))
    left, finished = link.filter("up IS NOT NULL"), materialize(done)
    while not left.isEmpty():
        found = materialize(left.join(finished.withColumnRenamed("session", "__e"), F.col("up") == F.col("__e")).select("session", "root"))
        if found.isEmpty():
            break  # every chain has one next to its end: those left are circles
        further = left.select(F.col("session").alias("__e"), F.col("up").alias("__up"))
        left = materialize(left.join(further, F.col("up") == F.col("__e")).select("session", F.col("__up").alias("up")))
        finished = finished.unionByName(found)
    return finished.unionByName(left.select("session", F.col("up").alias("root")))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``session, depth``: all that descend from the ``start`` sessions, at their least depth, however deep; one parent for each session.

    As in ``roots`` pointers double. An ancestor between a session and its start is found in an earlier round or
    the same, so a round that finds nothing is the last, in circles too. Only sessions whose pointer still moves take
    part in a round: those found, and those whose chain has ended, have no key to be joined by.
    """
    begun = start.select(F.col("session").alias("__b")).distinct()
    known = edges.select("session", F.col("parent").alias("up")).join(begun, F.col("session") == F.col("__b"), "full")
    link = materialize(known.select(F.coalesce("session", "__b").alias("session"), "up", F.when(F.col("__b").isNotNull(), F.lit(0).cast("long")).alias("depth")))
    finished, left = link.filter("depth IS NOT NULL").drop("up"), link.filter("depth IS NULL AND up IS NOT NULL").drop("depth")
    step = 1
    while True:
        above = _above(finished, left, "depth")
        met = materialize(left.join(above, F.col("up") == F.col("__u")).select("session", (F.col("__x") + step).alias("depth"), F.col("__p").alias("up")))
        found = met.filter("depth IS NOT NULL").drop("up")
        if found.isEmpty():
            break
        finished, left = finished.unionByName(found), met.filter("depth IS NULL AND up IS NOT NULL").drop("depth")
        step *= 2
    return finished.select("session", F.col("depth").cast("int").alias("depth"))


def _above(finished: DataFrame, left: DataFrame, given: str) -> DataFrame:
    """What a pointer may meet: ``__u``, and what it has found (``__x``) or where its own pointer is (``__p``)."""
    done = finished.select(F.col("session").alias("__u"), F.col(given).alias("__x"), F.lit(None).cast(left.schema["up"].dataType).alias("__p"))
    return done.unionByName(left.select(F.col("session").alias("__u"), F.lit(None).cast(finished.schema[given].dataType).alias("__x"), F.col("up").alias("__p")))


def lineage_counts(sessions: DataFrame) -> DataFrame:
    """Children of each parent, and how many of its parents are recorded themselves."""
    known = sessions.select(F.col("session").alias("__s"))
    child = sessions.filter("parent IS NOT NULL").join(known, F.col("parent") == F.col("__s"), "left")
    return child.groupBy("parent").agg(F.count("*").alias("children"), F.bool_or(F.col("__s").isNotNull()).alias("resolved"))


def _tied(sessions: DataFrame) -> DataFrame:
    """``session, harness, root, up``: the least session tied by parents of the same harness among some ``ROWS`` rows of one task.

    ``up`` is the parent where those rows don't hold it; null where they do, where none is declared or the harness is unknown.
    """
    kind = sessions.schema["session"].dataType
    schema = sessions.select("session", "harness", F.col("session").alias("root"), F.col("session").alias("up")).schema
    rows = storage.ROWS

    def tie(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        session, harness, parent = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        names, at = np.unique(session.to_numpy(zero_copy_only=False), return_inverse=True)
        code = pc.fill_null(harness.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.flatnonzero(pc.is_valid(parent).to_numpy(zero_copy_only=False) & (code >= 0))
        above = parent.take(pa.array(row)).to_numpy(zero_copy_only=False)
        place, width = np.minimum(np.searchsorted(names, above), len(names) - 1), code.max() + 1
        here = (names[place] == above) & np.isin(place * width + code[row], (at * width + code)[code >= 0])
        root = names[least_reached(len(names), at[row[here]], place[here])][at]
        away = np.zeros(len(at), dtype=bool)
        away[row[~here]] = True
        up = pc.if_else(pa.array(away), parent, pa.scalar(None, parent.type))
        return pa.RecordBatch.from_arrays([session, harness, pa.array(root, session.type), up], names=["session", "harness", "root", "up"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield tie(held)
                held = []
        if sum(b.num_rows for b in held):
            yield tie(held)

    return sessions.filter("session IS NOT NULL").select("session", "harness", F.col("parent").cast(kind).alias("parent")).mapInArrow(run, schema)


def _sharing(ids: DataFrame) -> DataFrame:
    """``session, id``: those whose id may be of several sessions, told by its hash alone: ids of one session only, most of all, move as hashes, once."""
    keyed = ids.filter("session IS NOT NULL AND id IS NOT NULL").select("session", "id", F.xxhash64("id").alias("__h"))
    ends = spread(keyed.select("__h", "session"), ids.count(), "__h").groupBy("__h").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    several = materialize(ends.filter("a != b").select("__h"))
    found = materialize(keyed.join(sent(several, several.count()), "__h").select("session", "id"))
    discard(several)
    return found


def overlap_groups(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """``session, harness, component``: sessions of one harness that share an id of a request, or whose parent is declared; one row for each session and harness.

    Families are tied first inside the tasks that hold them, and only what ties those groups to each other is an edge. Groups
    of one id are tied to the least of them, not to each other, so an id that many share costs one edge for each.
    """
    tied = materialize(_tied(sessions))
    rows = tied.count()
    shared = _sharing(ids)
    met = materialize(tied.join(sent(shared, shared.count()), "session").select("harness", "id", "root").distinct())
    first = met.groupBy("harness", "id").agg(F.min("root").alias("dst"))
    same = met.join(first, ["harness", "id"]).filter("root != dst").select(F.col("root").alias("src"), "dst")
    away = tied.filter("up IS NOT NULL").select(F.col("root").alias("src"), "up", F.col("harness").alias("__h"))
    declared = tied.drop("up").join(sent(away, away.count()), (F.col("session") == F.col("up")) & (F.col("harness") == F.col("__h"))).select("src", F.col("root").alias("dst"))
    again = materialize(spread(tied.select("session"), rows, "session").groupBy("session").agg(F.count("*").alias("n")).filter("n > 1").select("session"))
    repeats = again.count()
    places = tied.join(sent(again, repeats), "session").select(F.col("session").alias("src"), F.col("root").alias("dst"))
    groups = connected_components(same.unionByName(declared).unionByName(places))
    for done in (shared, met):
        discard(done)
    found = tied.drop("up").join(sent(groups, groups.count()), F.col("root") == F.col("node"), "left").select("session", "harness", F.coalesce("component", "root").alias("component"))
    if not repeats:
        return found
    return found.join(again, "session", "left_anti").unionByName(found.join(again, "session", "left_semi").distinct())


def bottom_k(ids: DataFrame, keys: list[str], k: int = 2048) -> DataFrame:
    """The k least hashes of each session's ids, and whether there are more: a sketch of its set."""
    hashed = ids.select(*keys, F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("digest")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("digest"))
    size = F.count("*").over(Window.partitionBy(*keys))
    return hashed.withColumns({"__n": rank, "sampled": size > k}).filter(F.col("__n") <= k).drop("__n")


def children_in_order(sessions: DataFrame, spawned: str) -> DataFrame:
    """``parent, session, position``: children by when they were spawned, unknown last, then by name."""
    by = Window.partitionBy("parent").orderBy(F.col(spawned).asc_nulls_last(), "session")
    return sessions.filter("parent IS NOT NULL").select("parent", "session", F.row_number().over(by).cast("long").alias("position"))


def shared_ids(ids: DataFrame, least: int = 2) -> DataFrame:
    """Ids that at least ``least`` sessions hold, with how many do."""
    return ids.groupBy("id").agg(F.count_distinct("session").alias("sessions")).filter(F.col("sessions") >= least)


def inherited_owner(sessions: DataFrame, owner: str = "owner", levels: int | None = None) -> DataFrame:
    """``session, owner``: its own, or that of the nearest ancestor that has one, however far or at most ``levels`` up; null if none has.

    As in ``roots`` pointers double: a session without an owner takes what its pointer has found, or its pointer's pointer,
    until a round finds no owner. Only sessions whose pointer still moves take part in a round.
    """
    link = materialize(sessions.select("session", F.col(owner).alias("owner"), F.col("parent").alias("up")))
    settled, moves = "owner IS NOT NULL OR up IS NULL", "owner IS NULL AND up IS NOT NULL"
    finished, left = link.filter(settled).drop("up"), link.filter(moves).drop("owner")
    step = 1
    while levels is None or step <= levels:
        above = _above(finished, left, "owner")
        met = materialize(left.join(above, F.col("up") == F.col("__u"), "left").select("session", F.col("__x").alias("owner"), F.col("__p").alias("up")))
        if met.filter("owner IS NOT NULL").isEmpty():
            break
        finished, left = finished.unionByName(met.filter(settled).drop("up")), met.filter(moves).drop("owner")
        step *= 2
    return finished.unionByName(left.select("session", F.lit(None).cast(link.schema["owner"].dataType).alias("owner")))
