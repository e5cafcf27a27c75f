"""Operator 10: SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.rows import pieces
from lagoon.operators.components import connected_components
from lagoon.storage import materialize

#: byte value -> its eight bits, one to a byte
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1)[:, ::-1].copy().view(np.uint64).ravel()


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64 bits: the majority, over the hashes of all word shingles (repeats included), of each bit.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; fewer words than a
    shingle holds make one shingle; no words give 0.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    hashed = np.empty(n, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(tokens)
    if n == 1:
        hashed[0] = digest(line, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashed[:] = [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())]
    octets = hashed.view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255):
        total += _SPREAD[octets[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id_col, fp``: one row for each row, ``fp`` the 64 bits as a signed long."""
    kept = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.fromiter((fingerprint(x, words, seed) for x in batch.column(1).to_pylist()), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return kept.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def trie_links(
    group: np.ndarray, side: np.ndarray, bits: np.ndarray, budget: int, width: int = 64, chunk: int = 400_000
) -> np.ndarray:
    """Labels that join rows of one group whose ``bits`` differ in at most ``budget`` places.

    Rows are sorted by (group, side, bits). Side 2 groups are joined with themselves; in others
    side 0 meets side 1. Each group's sorted rows are a binary trie whose nodes are ranges; node pairs go down together, one bit at a time, and a
    pair is dropped once its bits differ too often. A pair is also done when all leaves below it are
    known to be joined, or when the bits left can't exceed the budget. Returns, for each row, the
    first row it is joined to.
    """
    n = len(bits)
    label = np.arange(n)
    edge = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]))))
    ends = np.append(edge[1:], n)
    own = side[edge] == 2
    cross = np.flatnonzero((side[edge[:-1]] == 0) & (side[edge[1:]] == 1) & (group[edge[:-1]] == group[edge[1:]])) if len(edge) > 1 else np.empty(0, int)
    first = [np.concatenate((a[own], a[cross])) for a in (edge, ends)]
    second = [np.concatenate((a[own], a[cross + 1])) for a in (edge, ends)] if len(cross) else [edge[own], ends[own]]
    start = np.stack([*first, *second, np.zeros(len(first[0]), dtype=np.int64)])
    ones: dict[int, np.ndarray] = {}
    stack = [(width, start)]
    while stack:
        left, pairs = stack.pop()
        if pairs.shape[1] > chunk:
            stack += [(left, pairs[:, i : i + chunk]) for i in range(0, pairs.shape[1], chunk)][::-1]
            continue
        same_node = pairs[0] == pairs[2]
        pairs = pairs[:, ~(same_node & (pairs[1] - pairs[0] == 1))]
        if left < width - 8 and pairs.shape[1] > 64:
            runs = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            a, b, c, d, _ = pairs
            joined = (runs[b - 1] == runs[a]) & (runs[d - 1] == runs[c]) & (label[a] == label[c])
            pairs = pairs[:, ~joined]
        done = pairs[4] + left <= budget
        if done.any():
            a, b, c, d, _ = pairs[:, done]
            reach, origin = np.concatenate((b - a, d - c)), np.concatenate((a, c))
            members = np.repeat(origin - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
            label = _join(label, members, np.repeat(np.concatenate((a, a)), reach))
            pairs = pairs[:, ~done]
        if left == 0 or not pairs.shape[1]:
            continue
        left -= 1
        if left not in ones:
            ones[left] = np.concatenate(([0], np.cumsum((bits >> np.uint64(left)) & np.uint64(1)))).astype(np.int64)
        a, b, c, d, e = pairs
        p, q = b - (ones[left][b] - ones[left][a]), d - (ones[left][d] - ones[left][c])
        other = a != c
        below = np.concatenate(
            (np.stack((a, p, c, q, e)), np.stack((p, b, q, d, e)), np.stack((a, p, q, d, e + 1)), np.stack((p, b, c, q, e + 1))[:, other]), axis=1
        )
        stack.append((left, below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]))
    return label


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def trie_self_join(points: DataFrame, budget: int = 3, hot: int = 20_000) -> DataFrame:
    """``src, dst``: links that connect just what lies within ``budget`` bits.

    ``points`` has distinct longs ``fp``. Of budget + 1 equal blocks of bits, two fingerprints within
    the budget agree in one: each block's value keys a trie over the bits turned to follow it. A
    block value with more than ``hot`` fingerprints is taken apart by its next bits first: one key for
    each pair of trie nodes that the budget still allows, so no task holds an unbounded group. A
    task returns one link for each fingerprint at most, never all pairs.
    """
    blocks = budget + 1
    width = 64 // blocks
    keyed = points.select("fp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn(
        "turned",
        F.when(F.col("block") == 0, F.col("fp")).otherwise(
            F.expr(f"shiftleft(fp, block * {width}) | shiftrightunsigned(fp, 64 - block * {width})")
        ),
    )
    keyed = keyed.withColumn("value", F.expr(f"shiftrightunsigned(turned, {64 - width})"))
    sizes = (
        keyed.groupBy("block", "value").count().filter(F.col("count") > hot)
        .select("block", "value", F.when(F.col("count") <= 16 * hot, 4).when(F.col("count") <= 256 * hot, 8).otherwise(12).alias("depth"))
    )
    masks = {d: [m for m in range(1 << d) if bin(m).count("1") <= budget] for d in (4, 8, 12)}
    plain = keyed.join(sizes, ["block", "value"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    node = F.expr(f"shiftrightunsigned(shiftleft(turned, {width}), 64 - depth)")
    spread = plain.withColumn("node", F.when(F.col("depth") > 0, node).otherwise(F.lit(0).cast("long"))).withColumn(
        "mask",
        F.explode(
            F.when(F.col("depth") == 0, F.array(F.lit(0)))
            .when(F.col("depth") == 4, F.lit(masks[4]))
            .when(F.col("depth") == 8, F.lit(masks[8]))
            .otherwise(F.lit(masks[12]))
        ),
    )
    pairs = spread.select(
        F.struct("block", "value", F.least(F.col("node"), F.col("node").bitwiseXOR(F.col("mask"))).alias("a"), F.greatest(F.col("node"), F.col("node").bitwiseXOR(F.col("mask"))).alias("b")).alias("key"),
        F.when(F.col("mask") == 0, 2).when(F.col("node") < F.col("node").bitwiseXOR(F.col("mask")), 0).otherwise(1).alias("side"),
        "turned",
        "fp",
    )
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # flipping the sign bit sorts the signed longs as unsigned
    dealt = pairs.repartition(parts, "key").sortWithinPartitions("key", "side", F.col("turned").bitwiseXOR(F.lit(-(2**63)))).select(
        F.xxhash64("key").alias("key"), "side", "turned", "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]))
            if sum(x.shape[1] for x in held) < 200_000:
                continue
            rows = np.concatenate(held, axis=1)
            cut = _last_start(rows[0])
            if cut:
                yield from _links(rows[:, :cut], budget)
            held = [rows[:, cut:]]
        if held:
            yield from _links(np.concatenate(held, axis=1), budget)

    return dealt.mapInArrow(run, "src long, dst long")


def _last_start(key: np.ndarray) -> int:
    """Where the run of the last key begins."""
    changed = np.flatnonzero(key[1:] != key[:-1])
    return int(changed[-1]) + 1 if len(changed) else 0


def _links(rows: np.ndarray, budget: int) -> Iterator[pa.RecordBatch]:
    key, side, turned, fp = rows
    label = trie_links(key, side, turned.view(np.uint64), budget)
    found = np.flatnonzero(label != np.arange(len(label)))
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(fp[label[found]]), pa.array(fp[found])], names=["src", "dst"])


def near_duplicates(
    docs: DataFrame, budget: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, fp, component_id``: one row for each row of ``docs``.

    Rows whose fingerprints differ in at most ``budget`` bits are linked; ``component_id`` is the
    smallest id reachable by links, itself included (null where all of them are null). Copies share
    a fingerprint and are joined once. Null and empty texts have fingerprint 0, linked like any other;
    an empty table gives no rows; other columns are ignored.
    """
    made = materialize(fingerprints(docs, id_col, text_col, words, seed))
    points = materialize(made.groupBy("fp").agg(F.min(id_col).alias("__least")))
    groups = connected_components(trie_self_join(points.select("fp"), budget))
    placed = points.join(groups, points["fp"] == groups["node"], "left").select(
        points["fp"], "__least", F.coalesce("component", points["fp"]).alias("__class")
    )
    smallest = placed.groupBy("__class").agg(F.min("__least").alias("component_id"))
    named = placed.join(smallest, "__class").select("fp", "component_id")
    return made.join(named, "fp").select(id_col, "fp", "component_id")
