"""Operator 13: hard negatives by a k-nearest-neighbour join over Voronoi cells, in exact integers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.vectors import finite, integers, safe_component, usual_length
from lagoon.storage import materialize

#: Labels fall into so many buckets, each with its own bound in every cell.
BUCKETS = 64

#: Beyond any score.
FAR = np.int64(2**62)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Inner products as int64: in doubles where none can leave 2^53, else in integers."""
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Cells:
    """Pivots of the Voronoi cells, in the space where the nearest candidate is the one of the largest inner product.

    A candidate x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0), M being the longest vector: their squared
    distance is |a|^2 + M^2 - 2 a.x.
    """

    def __init__(self, pivots: np.ndarray, longest: float):
        self.longest = longest
        self.pivots = self.lift(pivots)
        self.apart = np.sqrt(self._squares(self.pivots))

    def lift(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def _squares(self, lifted: np.ndarray) -> np.ndarray:
        off = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.maximum(off, 0)

    def distances(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        """Distance of each row to each pivot."""
        return np.sqrt(self._squares(self.lift(x, anchor)))

    def serves(self, x: np.ndarray, spread: np.ndarray, within: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Which cells' anchors each candidate might serve, its own cell left out.

        Anchors of cell i lie within ``spread[i]`` of its pivot; they ask for distances up to ``within`` (by row and cell) and from ``beyond[i]`` on.
        A candidate is at least |x, p_i| - spread and, as anchors of cell i are nearer to p_i than to the candidate's own pivot,
        at least its distance to the plane between both from any of them, and at most |x, p_i| + spread.
        """
        off = self.distances(x)
        own = off.argmin(axis=1)
        near = off[np.arange(len(off)), own]
        gap = self.apart[own]
        plane = np.divide(off**2 - near[:, None] ** 2, 2 * gap, out=np.zeros_like(off), where=gap > 0)
        slack = 1e-6 * (1 + self.longest**0.5)
        found = (np.maximum(off - spread, plane) <= within + slack) & (off + spread + slack >= beyond)
        found[np.arange(len(off)), own] = False
        return found


def _best(batches: Iterator[pa.RecordBatch], dim: int, most: int, k: int, same: bool, chunk: int = 1024) -> Iterator[pa.RecordBatch]:
    """For each unit's anchors and bands the ``k`` best of its candidates: ``uid, band, id, rid, score``.

    Rows come sorted by unit, anchors before candidates, candidates by id: a later one wins by a higher score only. A task holds one unit's anchors and one batch.
    """
    unit = None
    anchors: list[tuple] = []
    state: dict = {}

    def begin() -> None:
        x = np.concatenate([a[0] for a in anchors])
        low, high = (np.concatenate([a[i] for a in anchors]) for i in (1, 2))
        codes: dict = {}
        label = np.array([codes.setdefault(v, len(codes)) for a in anchors for v in a[3]], np.int64)
        shape = (*low.shape, k)
        state.update(x=x, low=low, high=high, codes=codes, label=label, uid=[u for a in anchors for u in a[4]])
        state.update(score=np.full(shape, -FAR), id=np.zeros(shape, np.int64), no_id=np.zeros(shape, bool), rid=np.full(shape, -1, np.int64))

    def meet(x: np.ndarray, label: np.ndarray, ids: np.ndarray, no_id: np.ndarray, rids: np.ndarray) -> None:
        s = products(state["x"], x, most)
        fits = (state["label"][:, None] == label) == same
        for band in range(state["low"].shape[1]):
            worst = np.maximum(state["score"][:, band, -1], state["low"][:, band] - 1)
            asked = fits & (s > worst[:, None]) & (s <= state["high"][:, band, None])
            for a in np.flatnonzero(asked.any(axis=1)):
                at = np.flatnonzero(asked[a])
                at = at[np.argsort(-s[a, at], kind="stable")[:k]]
                score = np.concatenate((state["score"][a, band], s[a, at]))
                order = np.argsort(-score, kind="stable")[:k]
                for name, new in (("id", ids), ("no_id", no_id), ("rid", rids)):
                    state[name][a, band] = np.concatenate((state[name][a, band], new[at]))[order]
                state["score"][a, band] = score[order]

    def done() -> Iterator[pa.RecordBatch]:
        if state:
            a, band, at = np.nonzero(state["rid"] >= 0)
            ids = pa.array(state["id"][a, band, at], mask=state["no_id"][a, band, at])
            uid = pa.array([state["uid"][i] for i in a], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [uid, pa.array(band.astype(np.int32)), ids, pa.array(state["rid"][a, band, at]), pa.array(state["score"][a, band, at])], names=["uid", "band", "id", "rid", "score"]
            )
        anchors.clear()
        state.clear()

    for batch in batches:
        units, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((units[1:] != units[:-1]) | (side[1:] != side[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)]):
            if start == end:
                continue
            if units[start] != unit:
                yield from done()
                unit = units[start]
            part = batch.slice(start, end - start)
            labels = part.column(6).to_pylist()
            x = _matrix(part.column(5), dim)
            if side[start] == 0:
                bands = [part.column(i).flatten().to_numpy().reshape(len(x), -1) for i in (7, 8)]
                anchors.append((x, *bands, labels, part.column(2).to_pylist()))
                continue
            if not anchors:
                continue
            if not state:
                begin()
            label = np.array([state["codes"].get(v, -1) for v in labels], np.int64)
            ids, no_id = part.column(3).fill_null(0).to_numpy(), part.column(3).is_null().to_numpy(zero_copy_only=False)
            rids = part.column(4).to_numpy()
            for c in range(0, len(x), chunk):
                cut = slice(c, c + chunk)
                meet(x[cut], label[cut], ids[cut], no_id[cut], rids[cut])
    yield from done()


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    most_pivots: int = 256,
    per_pivot: int = 4_096,
    block: int = 32_768,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` selects.

    Scores are inner products of vectors times ``scale``, floored; of equal scores the smaller id comes first, null ids last. An anchor's positives are
    its ``positives`` best other rows of the same label; for each, the ``negatives`` best rows of other labels whose score lies between ``low`` and ``high`` percent of the
    positive's are returned (none if the positive's score is below 0). Null labels, null vectors and those with null or non-finite components take no part, nor do vectors of another length than
    the commonest, or with components so large that a product may leave int64. Equal ids are rows of their own.

    Rows of one label and vector can only serve by their smallest ids, so that each such group enters with ``positives + 1`` rows, and its anchors as one. Both joins (positives, then negatives)
    begin inside the anchors' own Voronoi cell, which bounds what a better candidate must be like; other cells' candidates are then
    sent only to those cells whose bounds they meet. A cell's anchors are dealt in parts of ``2 * per_pivot``, its candidates in blocks, so that no task grows with a cell. Pivots are a seeded
    sample, one for each ``per_pivot`` anchors, 4 to ``most_pivots``; what they are decides the cost only.
    """
    spark = rows.sparkSession
    parts_of_shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    given = given.filter(F.col("label").isNotNull() & finite(F.col("v")))
    dim = usual_length(given, "v")
    bound = safe_component(dim)
    sound = given.filter((F.size("v") == dim) & F.lit(dim > 0) & F.forall("v", lambda x: F.abs(x) * scale < bound - 1))
    base = sound.select("id", "label", "anchor", integers(F.col("v"), scale).cast("array<int>").alias("q"))
    base = base.withColumn("uid", F.unhex(F.sha2(F.to_json(F.struct("label", "q")), 256)))
    base = materialize(base.withColumn("rid", F.monotonically_increasing_id()).withColumn("square", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))))

    first = Window.partitionBy("uid").orderBy(F.col("id").asc_nulls_last(), "rid")
    cand = materialize(base.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max(positives + 1, negatives)).select("rid", "id", "label", "uid", "q"))
    asked = materialize(base.filter("anchor").groupBy("uid").agg(F.any_value("label").alias("label"), F.any_value("q").alias("q"), F.count("*").alias("copies")))
    label_type = base.schema["label"].dataType.simpleString()
    wanted, total = asked.count(), cand.count()
    if not wanted:
        return base.limit(0).select(
            F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score")
        )
    longest = int(base.agg(F.max("square")).first()[0])
    count = min(max(-(-wanted // per_pivot), 4), most_pivots)
    drawn = cand.orderBy(F.xxhash64("uid", F.lit(seed)), "rid").limit(count).select("q").collect()
    cells = spark.sparkContext.broadcast(Cells(np.array([r["q"] for r in drawn], np.float64), float(longest)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            off = cells.value.distances(x, anchor=True)
            cell = off.argmin(axis=1)
            length = (x * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(off[np.arange(len(x)), cell]), pa.array(length)], names=["uid", "label", "q", "cell", "off", "length"])

    placed_anchors = materialize(asked.select("uid", "label", "q").mapInArrow(placed, f"uid binary, label {label_type}, q array<int>, cell int, off double, length double"))
    spread, held = np.full(len(drawn), -np.inf), np.zeros(len(drawn), np.int64)
    for r in placed_anchors.groupBy("cell").agg(F.max("off").alias("off"), F.count("*").alias("n")).collect():
        spread[r["cell"]], held[r["cell"]] = r["off"], r["n"]
    parts = -(-held // (2 * per_pivot))
    blocks = -(-total // block)
    per_cell = F.array(*[F.lit(int(n)) for n in parts])
    placed_anchors = placed_anchors.withColumn("part", F.pmod(F.xxhash64("uid"), F.greatest(F.element_at(per_cell, F.col("cell") + 1), F.lit(1))).cast("int"))

    def deal(queries: DataFrame, choose: Callable, k: int, same: bool) -> DataFrame:
        """The ``k`` best of the candidates that ``choose(vectors, label buckets)`` sends to each cell (a matrix), for the bands of ``queries``."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, cell = np.nonzero(choose(_matrix(batch.column(2), dim), batch.column(3).to_numpy()))
                n = parts[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                to = np.split(cell * 2**20 + part, np.searchsorted(row, np.arange(1, len(batch))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(to, pa.list_(pa.int64()))], names=["rid", "id", "q", "label", "to"])

        bucketed = cand.select("rid", "id", "q", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket"), "label")
        sent = bucketed.mapInArrow(send, f"rid long, id long, q array<int>, label {label_type}, to array<long>")
        none = F.lit(None).cast("array<long>")
        there = sent.select("rid", "id", "q", "label", F.explode("to").alias("part"))
        there = there.select((F.col("part") * F.lit(2**20) + F.pmod(F.xxhash64("rid"), F.lit(blocks))).alias("unit"), F.lit(1).alias("side"), F.lit(None).cast("binary").alias("uid"), "id", "rid", "q", "label", none.alias("low"), none.alias("high"))
        here = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
            ((F.col("cell").cast("long") * F.lit(2**20) + F.col("part")) * F.lit(2**20) + F.col("block")).alias("unit"),
            F.lit(0).alias("side"), "uid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("rid"), "q", "label", "low", "high",
        )
        met = here.unionByName(there).repartition(parts_of_shuffle, "unit").sortWithinPartitions("unit", "side", F.col("id").asc_nulls_last(), "rid")
        best = met.mapInArrow(lambda batches: _best(batches, dim, longest, k, same), "uid binary, band int, id long, rid long, score long")
        return best

    def ranked(found: DataFrame, k: int) -> DataFrame:
        """The ``k`` best over all units, numbered from 1."""
        order = Window.partitionBy("uid", "band").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "rid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def both_passes(queries: DataFrame, k: int, same: bool) -> DataFrame:
        """Best of the own cell, then of those candidates elsewhere that may still do better."""

        def at_home(x: np.ndarray, bucket: np.ndarray) -> np.ndarray:
            return np.arange(len(drawn)) == cells.value.distances(x).argmin(axis=1)[:, None]

        home = materialize(deal(queries, at_home, k, same))
        worst = ranked(home, k).filter(F.col("rank") == k).select("uid", F.col("band").alias("b"), F.col("score").alias("least"))
        each = queries.select("uid", "cell", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket"), "length", "high", F.posexplode("low").alias("b", "l"))
        each = each.filter(F.element_at("high", F.col("b") + 1) >= F.col("l")).join(worst, ["uid", "b"], "left")
        reach = F.col("length") + float(longest) - 2 * F.greatest(F.coalesce("least", "l"), F.lit(-longest))
        limit = F.col("length") + float(longest) - 2 * F.least(F.element_at("high", F.col("b") + 1), F.lit(longest))
        within, beyond = np.full((BUCKETS, len(drawn)), -np.inf), np.full(len(drawn), np.inf)
        for r in each.groupBy("cell", "bucket").agg(F.max(reach).alias("w"), F.min(limit).alias("b")).collect():
            within[r["bucket"], r["cell"]] = max(r["w"], 0.0) ** 0.5
            beyond[r["cell"]] = min(beyond[r["cell"]], max(r["b"], 0.0) ** 0.5)
        if not same:
            within[:] = within.max(axis=0)
        bounds = spark.sparkContext.broadcast((within, beyond))

        def elsewhere(x: np.ndarray, bucket: np.ndarray) -> np.ndarray:
            return cells.value.serves(x, spread, bounds.value[0][bucket], bounds.value[1])

        return ranked(home.unionByName(deal(queries, elsewhere, k, same)), k)

    open_band = placed_anchors.withColumn("low", F.array(F.lit(int(-FAR) + 1))).withColumn("high", F.array(F.lit(int(FAR))))
    best = materialize(both_passes(open_band, positives + 1, True).select("uid", "id", "rid", "score", "rank"))
    bands = best.groupBy("uid").agg(F.array_sort(F.collect_set("score")).alias("scores"))  # positives + 1 at most
    bands = placed_anchors.join(bands, "uid").select(
        "uid", "label", "q", "cell", "part", "length", "scores",
        *[F.concat(F.transform("scores", to), F.array_repeat(F.lit(fill), positives + 1 - F.size("scores"))).alias(name)
          for name, to, fill in (("low", lambda s: -F.floor(-s * low / F.lit(100)), 1), ("high", lambda s: F.floor(s * high / F.lit(100)), 0))],
    )
    bands = materialize(bands)
    far = both_passes(bands, negatives, False).join(bands.select("uid", "scores"), "uid")
    mined = far.select("uid", F.element_at("scores", F.col("band") + 1).alias("score"), F.col("rank").alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = best.join(mined, ["uid", "score"], "left").select("uid", F.struct("rank", "id", "rid", "score", "place", "negative_id", "negative_score").alias("pair"))
    salted = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("copies") / 10_000)))
    answers = pairs.groupBy("uid").agg(F.collect_list("pair").alias("pairs"))  # (positives + 1) * negatives at most
    answers = answers.join(asked.select("uid", "copies"), "uid").select("uid", "pairs", "copies", salted.alias("salt"))
    own = base.filter("anchor").select("uid", F.col("id").alias("anchor_id"), F.col("rid").alias("me"))
    own = own.join(asked.filter("copies >= 10000").select("uid", "copies"), "uid", "left").select("uid", "anchor_id", "me", F.pmod(F.xxhash64("me"), F.floor(F.coalesce("copies", F.lit(0)) / 10_000) + 1).alias("salt"))
    held_place = F.coalesce(F.array_max(F.transform(F.filter("pairs", lambda p: p["rid"] == F.col("me")), lambda p: p["rank"])), F.lit(2**30))
    out = own.join(answers, ["uid", "salt"]).select("anchor_id", "me", held_place.alias("mine"), F.explode("pairs").alias("p"))
    out = out.filter((F.col("p.rid") != F.col("me")) & (F.col("p.rank") - (F.col("mine") < F.col("p.rank")).cast("int") <= positives) & F.col("p.place").isNotNull())
    return out.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.place").alias("rank"), F.col("p.negative_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("p.negative_score").alias("negative_score")
    )
