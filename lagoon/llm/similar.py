"""Texts of like shingle sets: an exact self-join by prefixes of ordered sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.decontaminate import _gram_hashes
from lagoon.llm.simhash import _last_start, near_duplicates
from lagoon.operators.components import connected_components
from lagoon.llm.rows import pieces, shielded
from lagoon.storage import Scope, discard, materialize

PARTS = "spark.sql.shuffle.partitions"


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of ``words`` words, ascending; A-Z lower-cased, fewer words make one run."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    return np.unique(_gram_hashes(ids, min(words, len(ids))))


#: A token's flag is the bit of this many leading bits of its hash, whatever the number of tokens: 16 MB to broadcast.
_FLAGS = 27


def prefix_of(held: np.ndarray, flags: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least * n) + 1 of a shingle set in the order of (flag, hash)."""
    at = held >> np.uint64(64 - _FLAGS)
    common = (flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    order = np.argsort(common, kind="stable")
    return held[order[: len(held) - int(np.ceil(least * len(held) - 1e-9)) + 1]]


def _prefixes(texts: DataFrame, flags: np.ndarray, least: float, words: int) -> DataFrame:
    """``token, size, row``: the keys of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens, sizes, rows = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = shingle_set(text, words)
                if len(held):
                    keys = prefix_of(held, shared.value, least)
                    tokens.append(keys.view(np.int64))
                    sizes.append(np.full(len(keys), len(held)))
                    rows.append(np.full(len(keys), row))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sizes, rows)], names=["token", "size", "row"])

    return texts.select("__row", "__text").mapInArrow(run, "token long, size long, row long")


def _crowded(texts: DataFrame, least: float, words: int, small: int, rounds: int) -> np.ndarray:
    """Flags of the shingles that more than ``small`` texts have among their keys, so that they come last in the order.

    Every text is counted; each round looks at the keys that the flags of the rounds before give. Flags only choose the
    order, the same for all texts: what they take for crowded wrongly changes no result.
    """
    flags = np.zeros(1 << (_FLAGS - 3), dtype=np.uint8)
    for _ in range(rounds):
        often = _prefixes(texts, flags, least, words).groupBy("token").count().filter(F.col("count") > small)
        at = F.shiftrightunsigned("token", 64 - _FLAGS)
        bits = often.groupBy(F.shiftright(at, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(token, {64 - _FLAGS}) & 7 as int))")).alias("bits")).toArrow()
        found = bits["byte"].to_numpy()
        flags[found] |= bits["bits"].to_numpy().astype(np.uint8)
        if not len(found):
            break
    return flags


def similar_links(texts: DataFrame, least: float = 0.8, words: int = 5, small: int = 20, rounds: int = 2) -> DataFrame:
    """``src, dst``: links that connect just the rows whose shingle sets have Jaccard similarity ``least`` or more.

    ``texts`` has a distinct long ``__row`` and a binary ``__text``. With shingles in one order, two sets of
    that similarity share one among the first n - ceil(least * n) + 1 of each: those are the keys of the join. Crowded shingles come
    last, so what many texts share without being alike is rarely a key.
    In a group of up to ``small`` rows every pair is a candidate. Larger ones are near copies of one another: each row and the group's first are
    candidates, and then rows that the links found don't connect are compared by sketches in blocks. A candidate is checked by
    parity sketches, then on the whole sets.
    """
    parts = int(texts.sparkSession.conf.get(PARTS))
    keyed = _prefixes(texts, _crowded(texts, least, words, small, rounds), least, words)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        begun = False  # whether the rows held go on with a group whose first row leads them
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(x.shape[1] for x in held) < 50_000:
                continue
            rows = np.concatenate(held, axis=1)
            cut = _last_start(rows[0])
            if cut:
                yield from met(rows[:, :cut], begun)
                held, begun = [rows[:, cut:]], False
            else:  # one group fills the buffer: its first row is kept to meet the rest
                yield from met(rows, True, not begun)
                held, begun = [rows[:, :1]], True
        if held:
            yield from met(np.concatenate(held, axis=1), begun)

    def met(rows: np.ndarray, begun: bool, lead: bool = False) -> Iterator[pa.RecordBatch]:
        """Candidates of whole groups; where ``begun``, the first group is a piece of a large one and its first row was given unless it is the ``lead``."""
        token, size, row = rows
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(first, len(token)))
        group = np.repeat(first, count)
        large = np.repeat(count > small, count)
        if begun:
            large[: count[0]] = True
        near = []
        # rows of a group stand by size: each is met with the k-th after it
        for k in range(1, min(small, int(count.max()))):
            a = np.flatnonzero((group[:-k] == group[k:]) & ~large[:-k] & (size[:-k] >= least * size[k:] - 1e-9))
            near.append((row[a], row[a + k]))
        a = np.flatnonzero(large & (group != np.arange(len(token))) & (size[group] >= least * size - 1e-9))
        near.append((row[group[a]], row[a]))
        x, y = (np.concatenate(v) for v in zip(*near))
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1) if len(x) else np.empty((2, 0), dtype=np.int64)
        names = ["src", "dst", "token", "size"]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(len(pairs[0]), pa.int64()), pa.nulls(len(pairs[0]), pa.int64())], names=names)
        if begun and not lead:
            large[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(row[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(token[large]), pa.array(size[large])], names=names)

    dealt = keyed.repartition(parts, "token").sortWithinPartitions("token", "size", "row")
    found = materialize(dealt.mapInArrow(candidates, "src long, dst long, token long, size long"))
    links = materialize(_checked(texts, found.filter("dst IS NOT NULL").select("src", "dst").distinct(), least, words))
    crowded = found.filter("token IS NOT NULL")
    if crowded.isEmpty():
        return links
    apart = _block_candidates(texts, crowded.select("token", "src"), links, least, words)
    return links.unionByName(_checked(texts, apart, least, words))


def _block_candidates(texts: DataFrame, crowded: DataFrame, links: DataFrame, least: float, words: int, block: int = 256) -> DataFrame:
    """``src, dst``: the rows of large groups that no links connect and whose sketches of 1,024 bits allow the similarity.

    Groups that share rows are one cluster. A cluster's rows are dealt into blocks of about ``block``, those of a class of links
    that fills one apart from the others; two blocks are one unit of work, compared by matrices in a task, and only what
    the sketches allow leaves it. No pair is a row before that, and no unit grows with the cluster.
    """
    joined = connected_components(links).select(F.col("node").alias("src"), F.col("component").alias("class"))
    first = crowded.groupBy("token").agg(F.min("src").alias("dst"))
    clusters = connected_components(crowded.join(first, "token").select("src", "dst")).select(F.col("node").alias("src"), F.col("component").alias("cluster"))
    rows = materialize(clusters.join(joined, "src", "left").withColumn("class", F.coalesce("class", "src")))
    counted = rows.groupBy("cluster", "class").agg(F.count("*").alias("c")).withColumn("own", F.col("c") >= block // 2)
    rest = counted.filter("NOT own").groupBy("cluster").agg(F.sum("c").alias("rest"))
    size = F.when(F.col("own"), F.col("c")).otherwise(F.col("rest"))
    placed = rows.join(counted, ["cluster", "class"]).join(rest, "cluster", "left").select(
        "src", "class", "cluster", F.when(F.col("own"), F.col("class")).otherwise(F.lit(-1)).alias("kind"), F.pmod(F.xxhash64("src"), F.ceil(size / block)).alias("part")
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array([parity_sketch(x, 1024) for x in held], pa.binary())], names=["src", "n", "bits"])

    drawn = texts.join(rows.select(F.col("src").alias("__row")), "__row", "left_semi").select("__row", "__text").mapInArrow(draw, "src long, n long, bits binary")
    placed = materialize(placed.join(drawn, "src"))
    blocks = placed.select("cluster", F.struct("kind", "part").alias("a")).distinct()
    units = blocks.join(blocks.withColumnRenamed("a", "b"), "cluster").filter("a <= b AND NOT (a.kind = b.kind AND a.kind <> -1)")
    at = F.struct("kind", "part")
    one = placed.withColumn("a", at).join(units, ["cluster", "a"]).withColumn("side", F.when(F.col("a") == F.col("b"), 2).otherwise(0))
    two = placed.withColumn("b", at).join(units.filter("a <> b"), ["cluster", "b"]).withColumn("side", F.lit(1))
    parts = int(texts.sparkSession.conf.get(PARTS))
    columns = [F.xxhash64("cluster", "a", "b").alias("unit"), "side", "src", "class", "n", "bits"]
    dealt = one.select(*columns).unionByName(two.select(*columns)).repartition(parts, "unit").sortWithinPartitions("unit", "side")

    def compare(held: list[tuple]) -> Iterator[tuple[int, int]]:
        src, cls, n = (np.array(x, dtype=np.int64) for x in zip(*[h[2:5] for h in held]))
        bits = np.frombuffer(b"".join(h[5] for h in held), dtype=np.uint64).reshape(len(held), -1)
        left = np.array([h[1] != 1 for h in held])
        across = not left.all()
        i, j = (np.flatnonzero(left), np.flatnonzero(~left)) if across else (np.arange(len(held)),) * 2
        for k in i.tolist():
            other = j if across else j[j > k]
            other = other[cls[other] != cls[k]]
            if len(other):
                differ = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1)
                fits = (differ <= (1 - least) / (1 + least) * (n[other] + n[k]) + 1e-9) & (np.minimum(n[other], n[k]) >= least * np.maximum(n[other], n[k]) - 1e-9)
                for o in src[other[fits]].tolist():
                    yield (min(o, int(src[k])), max(o, int(src[k])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            found = list(compare(held))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["src", "dst"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    yield made()
                    held = []
                held.append(row)
        if held:
            yield made()

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def _checked(texts: DataFrame, pairs: DataFrame, least: float, words: int) -> DataFrame:
    """The ``pairs`` whose whole shingle sets are similar enough."""
    near = _sketched(texts, pairs, least, words)
    named = near.select(F.col("src").alias("__row")).unionByName(near.select(F.col("dst").alias("__row"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [shingle_set(x, words).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["row", "held"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    held = materialize(texts.join(named, "__row", "left_semi").select("__row", "__text").mapInArrow(sets, "row long, held binary"))
    both = near.join(held.select(F.col("row").alias("src"), F.col("held").alias("a")), "src").join(held.select(F.col("row").alias("dst"), F.col("held").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(check, "src long, dst long")


def parity_sketch(held: np.ndarray, bits: int | None = None) -> bytes:
    """One bit for each value of the low bits of the hashes: whether an odd number of the set has it. 4 to 8 bits a shingle, 1,024 at least, if not told."""
    bits = bits or max(1024, 1 << int(4 * len(held) - 1).bit_length())
    odd = np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_allows(a: bytes, b: bytes, n: int, m: int, least: float) -> bool:
    """False only where sets of ``n`` and ``m`` shingles can't be that similar.

    The sketches differ in no more bits than the sets do in shingles, and similar sets differ in at most
    (1 - least) / (1 + least) of their sizes. The longer sketch is folded to the shorter one's width.
    """
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-9


def _sketched(texts: DataFrame, pairs: DataFrame, least: float, words: int) -> DataFrame:
    """The ``pairs`` whose parity sketches allow the similarity: whole sets are an order larger and few pairs need them."""
    pairs = materialize(pairs)
    named = pairs.select(F.col("src").alias("__row")).unionByName(pairs.select(F.col("dst").alias("__row"))).distinct()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array([parity_sketch(x) for x in held], pa.binary())], names=["row", "n", "bits"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fits = [sketch_allows(*x, least) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(fits, pa.bool_()))

    drawn = materialize(texts.join(named, "__row", "left_semi").select("__row", "__text").mapInArrow(draw, "row long, n long, bits binary"))
    both = pairs.join(drawn.select(F.col("row").alias("src"), F.col("n").alias("n"), F.col("bits").alias("a")), "src").join(
        drawn.select(F.col("row").alias("dst"), F.col("n").alias("m"), F.col("bits").alias("b")), "dst"
    )
    near = materialize(both.select("src", "dst", "a", "b", "n", "m").mapInArrow(keep, "src long, dst long"))
    discard(drawn)
    discard(pairs)
    return near


def similar_groups(texts: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """``node, component``: the rows that similar texts connect, each with the smallest row of its group."""
    return connected_components(similar_links(texts, least, words))


def without_repeats(numbered: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``numbered`` (with a distinct ``__row``) less all but one row of each group of ``groups`` (``node, component``).

    The row of the smallest id stays, null last; among rows of one id the one with the least hash of its columns.
    The hot side of a join is never a group: rows to drop are found by their own number.
    """
    plain = [c for c in numbered.columns if c != "__row" and "map<" not in numbered.schema[c].dataType.simpleString() and "variant" not in numbered.schema[c].dataType.simpleString()]
    who = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[F.col(c) for c in plain]), "__row")
    named = groups.join(numbered.select("__row", who.alias("__who")), F.col("node") == F.col("__row"))
    stays = named.groupBy("component").agg(F.min("__who").alias("__least")).select(F.col("__least.__row").alias("node"))
    gone = materialize(groups.select("node").join(stays, "node", "left_anti").select(F.col("node").alias("__row")))
    return numbered.join(gone, "__row", "left_anti")


@shielded
def drop_similar(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that similar texts connect: that of the smallest id, null last.

    Texts without words are like no other and stay.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    texts = numbered.select("__row", F.col(text_col).cast("binary").alias("__text"))
    return without_repeats(numbered, similar_groups(texts, least, words), id_col).drop("__row")


@shielded
def drop_near_duplicates(docs: DataFrame, least: float = 0.8, words: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; rows are told apart by themselves, not by their ids.

    First the groups of fingerprints within ``budget`` bits (the trie self-join of operator 10, over shingles of
    ``words`` words), then, among the rows left, those of Jaccard similarity ``least`` or more. Null and empty texts
    share fingerprint 0: one of them stays. Of each group the row of the smallest id stays, null last.
    """
    with Scope() as made:
        return _without_near_duplicates(docs, made, least, words, budget, id_col, text_col)


def _without_near_duplicates(docs: DataFrame, made: Scope, least: float, words: int, budget: int, id_col: str, text_col: str) -> DataFrame:
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    alike = near_duplicates(numbered, budget, words, id_col="__row", text_col=text_col)
    groups = materialize(alike.select(F.col("__row").alias("node"), F.col("component_id").alias("component")))
    once = materialize(without_repeats(numbered, groups, id_col))
    made.sweep(once)
    similar = materialize(similar_groups(once.select("__row", F.col(text_col).cast("binary").alias("__text")), least, words))
    made.sweep(once, similar)
    return without_repeats(once, similar, id_col).drop("__row")
