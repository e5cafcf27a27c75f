"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node reachable.

    ``edges`` holds two columns of one orderable type; direction, repeats and self loops do not
    matter, edges with a null end are ignored. A node that has only self loops is not returned.
    Each round shuffles the edge list and keeps at most as many edges as there were; rounds grow
    with the logarithm of the longest path. Hubs are reduced by partial aggregation, and the joins
    are plain equi-joins that adaptive execution can split when a hub is large.
    """
    edge = materialize(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    seen = None
    while (now := _signature(edge)) != seen and now[0]:
        seen = now
        both = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edge.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        large = materialize(large)
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a")
            .filter("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b")))
            .distinct()
        )
        old, edge = edge, materialize(small)
        discard(old)
        discard(large)
    return edge.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edge.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _signature(edge: DataFrame) -> tuple:
    row = edge.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")
    ).first()
    return (row["n"], row["x"], row["s"])


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes ``0`` to ``n - 1`` that each reaches by the edges ``a``-``b`` of one task: trees hang on lesser neighbours until none moves."""
    least = np.arange(n)
    while not np.array_equal(x := least[a], y := least[b]):
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := least[least], least):
            least = up
    return least
