"""Edits and commits: how much of an edit a commit adds, and which commit a session made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon import storage
from lagoon.storage import materialize

#: Fixed value: pairs of an edit and a commit that share a line, of one task.
PAIRS = 1 << 20
#: Fixed values of ``best_overlaps``: lines at most whose number of commits every task knows; bits of a sketch for each line of a mean commit; 64-bit words of a sketch at most.
HEAD, BITS, WORDS = 1 << 17, 4, 16


def edit_overlap(edits: DataFrame, commits: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """Edits with the commits that add at least ``share`` of their distinct lines, ``least`` lines or more each.

    ``edits``: edit, digests. ``commits``: sha, digests. Digests are joined by a shuffle; lines that
    many commits add are counted, not paired with each other. The pairs that share a line are counted first
    and dealt over as many tasks as they need, so that a task's part doesn't grow with them.
    """
    lines = edits.withColumn("__n", F.size(F.array_distinct("digests"))).filter(F.col("__n") >= least).select("edit", "__n", F.explode(F.array_distinct("digests")).alias("d"))
    added = commits.select("sha", F.explode(F.array_distinct("digests")).alias("d"))
    lines, added = materialize(lines), materialize(added)
    both = lines.groupBy("d").count().join(added.groupBy("d").agg(F.count("*").alias("m")), "d")
    pairs = both.agg(F.sum(F.col("count").cast("double") * F.col("m"))).first()[0] or 0
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS) + 1)
    met = lines.repartition(n, "d").join(added.repartition(n, "d"), "d").select("edit", "sha", "__n").repartition(n, "edit", "sha").groupBy("edit", "sha", "__n").agg(F.count("*").alias("common"))
    return met.withColumn("overlap", F.col("common") / F.col("__n")).filter(F.col("overlap") >= share).drop("__n")


def observed_commits(observed: DataFrame, commits: DataFrame) -> DataFrame:
    """Observed revisions with the one commit they name: equal, or the only one that begins so.

    ``observed``: session, revision (7 characters or more). Prefixes meet on their first seven
    characters, so the join is by key.
    """
    short = commits.select("sha", F.substring("sha", 1, 7).alias("__k"))
    met = observed.withColumn("__k", F.substring("revision", 1, 7)).join(short, "__k").filter(F.col("sha").startswith(F.col("revision")))
    alone = F.count("*").over(Window.partitionBy("session", "revision"))
    return met.withColumn("__n", alone).filter((F.col("__n") == 1) | (F.col("sha") == F.col("revision"))).drop("__n", "__k")


def best_edit_commit(overlaps: DataFrame) -> DataFrame:
    """Each edit's commit with the greatest overlap; ties to the earlier name."""
    rank = F.row_number().over(Window.partitionBy("edit").orderBy(F.desc("overlap"), "sha"))
    return overlaps.withColumn("__n", rank).filter("__n = 1").drop("__n")


def best_overlaps(edits: DataFrame, commits: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """What ``best_edit_commit`` takes from ``edit_overlap``, without a shuffled row for each pair that shares a line.

    ``edits``: edit (unique; null names none), digests. ``commits``: sha (unique), digests. A commit that lacks at most k
    of an edit's lines holds one of any k + 1 of them. So an edit asks with its rarest line for the commits that hold all
    of its lines; where there is none, it asks with as many lines as ``share`` needs. A line's commits bring sketches of
    all they add: those that surely lack more than k lines stay inside the task, the others are compared line by line.
    """
    digests = F.array_distinct("digests")
    asked = edits.select("edit", F.size(digests).alias("n"), F.array_compact(digests).alias("lines")).filter(F.col("edit").isNotNull() & (F.col("n") >= max(least, 1)))
    asked = materialize(asked.filter(F.size("lines") / F.col("n") >= share))
    made = materialize(commits.select(F.monotonically_increasing_id().alias("c"), "sha", F.array_compact(digests).alias("adds")))
    held, size = made.agg(F.sum(F.size("adds")), F.avg(F.size("adds"))).first()
    if not held:
        return _best(asked.crossJoin(made).withColumn("common", F.lit(0).cast("long")).filter("false"))
    words = min(WORDS, int(BITS * size) // 64 + 1)
    # a file's commits become many rows: few tasks that read whole files would spill them
    made = storage.spread(made, held, "c").select("*", *_sketch("adds", words, "c"))
    asked = _rarest_first(asked, made).select("*", *_sketch("lines", words, "e"))

    def best(of: DataFrame, lacks: Column, asks: int) -> DataFrame:
        probes = of.withColumn("k", lacks).withColumn("d", F.explode(F.slice("lines", F.lit(1), F.col("k") + 1)))
        added = made.select("c", *[f"c{i}" for i in range(words)], F.explode("adds").alias("d"))
        lacking = sum((F.bit_count(F.col(f"e{i}").bitwiseAND(F.bitwise_not(f"c{i}"))) for i in range(words)), F.lit(0))
        near = (F.broadcast(probes).join(added, "d") if asks <= storage.ROWS else _dealt(probes, asks, added, held, "d")).filter(lacking <= F.col("k")).select("c", "edit", "n", "k", "lines")
        common = F.size(F.array_intersect("lines", "adds")).cast("long")
        met = _dealt(near, asks, made.select("c", "sha", "adds"), held, "c").select("edit", "n", "k", F.size("lines").alias("own"), "sha", common.alias("common"))
        kept = met.filter((F.col("common") >= F.col("own") - F.col("k")) & (F.col("common") / F.col("n") >= share))
        return _best(storage.spread(kept, asks, "edit"))

    all_asked = asked.count()
    found = materialize(best(asked, F.lit(0), all_asked))
    if found.count() == all_asked:
        return found
    # the fewest lines that make the share, by the division that the share is compared with
    fewest = F.greatest(F.ceil(F.col("n") * share).cast("int") - 1, F.lit(1))
    fewest = F.when(fewest / F.col("n") >= share, fewest).otherwise(fewest + 1)
    rest = asked.join(found.select("edit"), "edit", "left_anti").withColumn("open", F.size("lines") - fewest).filter("open > 0")
    rest = materialize(rest)
    asks = rest.agg(F.sum(F.col("open") + 1)).first()[0]
    return found.unionByName(best(rest, F.col("open"), asks)) if asks else found


def _best(met: DataFrame) -> DataFrame:
    """Of ``edit, n, sha, common`` each edit's greatest overlap; ties to the earlier name, none comes last."""
    first = F.min(F.struct(-F.col("common"), F.col("sha").isNull(), "sha", F.col("common").alias("common"))).alias("b")
    return met.groupBy("edit", "n").agg(first).select("edit", "b.sha", "b.common", (F.col("b.common") / F.col("n")).alias("overlap"))


def _sketch(lines: str, words: int, name: str) -> list[Column]:
    """One bit for each line, in columns of 64 bits."""
    at = f"transform({lines}, d -> int(pmod(xxhash64(d), {64 * words})))"
    return [F.expr(f"aggregate({at}, 0L, (a, x) -> a | if(x div 64 = {i}, shiftleft(1L, x), 0L))").alias(f"{name}{i}") for i in range(words)]


def _rarest_first(asked: DataFrame, made: DataFrame) -> DataFrame:
    """``asked`` with its lines in the order of the commits that add them, as far as these are among the ``HEAD`` commonest lines; the others come first."""
    counts = materialize(made.select(F.explode("adds").alias("d")).groupBy("d").agg(F.count("*").alias("m")))
    bits = F.length(F.bin("m"))
    lines, low = 0, None
    for size, n in sorted(counts.groupBy(bits).count().collect(), reverse=True):
        lines += n
        if lines > HEAD:
            break
        low = size
    if low is None:
        return asked
    known = asked.select("edit", "n", F.explode("lines").alias("d")).join(F.broadcast(counts.filter(bits >= low)), "d", "left")
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "d"))).alias("x")
    return materialize(known.groupBy("edit", "n").agg(ranked).select("edit", "n", F.col("x.d").alias("lines")))


def _dealt(asked: DataFrame, asks: int, held: DataFrame, rows: int, key: str) -> DataFrame:
    """Both joined by ``key``, over as many tasks as their rows need."""
    if max(asks, rows) <= storage.ROWS:
        return asked.join(held, key)
    n = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(asks, rows) // storage.ROWS + 1)
    return asked.repartition(n, key).join(held.repartition(n, key), key)


def uncommitted(requests: DataFrame, commits: DataFrame, place: str = "directory") -> DataFrame:
    """Requests after the last commit at their place; places without commits are uncommitted whole."""
    last = commits.groupBy(place).agg(F.max("committed_at").alias("__last"))
    joined = requests.join(last, place, "left")
    return joined.withColumn("uncommitted", F.col("__last").isNull() | (F.col("at") > F.col("__last"))).drop("__last")
