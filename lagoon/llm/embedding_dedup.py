"""Operator 4: near-duplicate embeddings by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.operators.components import connected_components
from lagoon.storage import materialize


def bucket_ids(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket for each row and table: ``projections`` Gaussian projections, shifted, cut at ``width``."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    axes = rng.standard_normal((vectors.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cells = np.floor((vectors @ axes + shift) / width).astype(np.int64).reshape(len(vectors), tables, projections)
    mix = np.random.default_rng([seed, 1]).integers(-(2**62), 2**62, size=projections) | 1
    return (cells * mix).sum(axis=2)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return values / np.abs(values).max(axis=1, keepdims=True)


def close_pairs(
    embeddings: DataFrame,
    threshold: float = 0.93,
    tables: int = 12,
    projections: int = 6,
    width: float = 1.5,
    block: int = 2_000,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``id_col, n_links, component_id, kept``: one row for each row of ``embeddings``.

    Rows with equal labels and dimensions are linked when the cosine of their vectors, in double
    precision, is at least ``threshold``. Equal vectors are joined first and count as links of each
    other. Distinct ones meet in any of ``tables`` hash tables; a pair is counted in the first table
    that it shares. A bucket of more than ``block`` vectors is dealt in pairs of blocks, each its own
    task group. Tasks return, for each vector, how many partners it has and one link, never pairs.

    A null label, a null, empty or zero vector, and one with null or non-finite components link with
    nothing: 0 links, a component of their own, kept. Null ids share their component's smallest id.
    """
    value = F.col(vector_col)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col(id_col), F.col(label_col).alias("__label"), value.alias("__vector"), usable.alias("__usable"))
    units = materialize(
        rows.filter("__usable")
        .groupBy("__label", "__vector")
        .agg(F.count("*").alias("copies"), F.min(id_col).alias("least"))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("dim", F.size("__vector"))
    )

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                x = _matrix(part.column(2), dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ids = bucket_ids(x, tables, projections, width, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, tables, dtype=np.int32)), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["uid", "buckets"])

    hashed = materialize(units.select("uid", "dim", "__vector").mapInArrow(hash_rows, "uid long, buckets array<long>"))
    cell = ["__label", "dim", "t", "bucket"]
    placed = hashed.join(units.select("uid", "__label", "dim"), "uid").select("uid", "__label", "dim", F.posexplode("buckets").alias("t", "bucket"))
    shared = placed.groupBy(*cell).agg(F.count("*").alias("members")).filter("members > 1").withColumn("parts", F.ceil(F.col("members") / block).cast("int"))
    met = placed.join(shared, cell).select("uid", *cell, "parts", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"))
    dealt = met.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "uid", F.xxhash64(*cell, F.least("part", "other"), F.greatest("part", "other")).alias("key"), "t",
        F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int")).alias("side"),
    )
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = (
        dealt.join(hashed, "uid")
        .join(units.select("uid", "copies", "dim", "__vector"), "uid")
        .select("key", "uid", "t", "side", "copies", "dim", "buckets", "__vector")
        .repartition(parts, "key")
        .sortWithinPartitions("key", "side")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            if held and key[0] != held[-1].column(0)[len(held[-1]) - 1].as_py():
                yield from _compare(held, threshold)
                held = []
            changed = np.flatnonzero(key[1:] != key[:-1])
            cut = int(changed[-1]) + 1 if len(changed) else 0
            if cut:
                yield from _compare([*held, batch.slice(0, cut)], threshold)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _compare(held, threshold)

    links = materialize(grouped.mapInArrow(compare, "uid long, other long, weight long"))
    groups = connected_components(links.filter("uid != other"), "uid", "other")
    counted = (
        units.select("uid", "__label", "__vector", "copies", "least")
        .join(links.groupBy("uid").agg(F.sum("weight").alias("weight")), "uid", "left")
        .join(groups, F.col("uid") == F.col("node"), "left")
        .select("uid", "__label", "__vector", "least", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n"), F.coalesce("component", "uid").alias("class"))
    )
    smallest = counted.groupBy("class").agg(F.min("least").alias("component_id"))
    named = counted.join(smallest, "class").select(F.col("__label").alias("l"), F.col("__vector").alias("v"), "n", "component_id")
    linked = rows.filter("__usable").join(named, (F.col("__label") == F.col("l")) & (F.col("__vector") == F.col("v"))).select(
        id_col, F.col("n").alias("n_links"), "component_id"
    )
    apart = rows.filter("NOT __usable").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _compare(batches: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact cosines inside each run of equal keys."""
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    key, uid, t, side, copies, dim = (rows.column(i).to_numpy().astype(np.int64) for i in range(6))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.append(start[1:], len(key))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(start.tolist(), end.tolist()):
        if b - a < 2:
            continue
        x = _matrix(rows.column(7).slice(a, b - a), int(dim[a]))
        norm = np.sqrt((x * x).sum(axis=1))
        ids = rows.column(6).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)[:, : t[a]]
        if side[a] == 2:
            i, j = slice(0, b - a), slice(0, b - a)
        else:
            split = int(np.searchsorted(side[a:b], 1))
            i, j = slice(0, split), slice(split, b - a)
        near = (x[i] @ x[j].T) / np.outer(norm[i], norm[j]) >= threshold
        if side[a] == 2:
            np.fill_diagonal(near, False)
        u, v = np.nonzero(near)
        fresh = ~(ids[i][u] == ids[j][v]).any(axis=1)  # else an earlier table counts the pair
        u, v = u[fresh] + a + (i.start or 0), v[fresh] + a + j.start
        if side[a] != 2:
            u, v = np.concatenate((u, v)), np.concatenate((v, u))
        if not len(u):
            continue
        weight = np.bincount(u - a, weights=copies[v], minlength=b - a).astype(np.int64)
        label = np.arange(b - a)
        while True:
            p, q = label[u - a], label[v - a]
            if (p == q).all():
                break
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
        has = np.flatnonzero(weight)
        out.append((uid[a + has], uid[a + label[has]], weight[has]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["uid", "other", "weight"])
