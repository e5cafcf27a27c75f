"""Operator 5: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.rows import occurrences, shielded
from lagoon.storage import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    epochs: int = 3,
    blocks: int = 8192,
    shards: int = 16,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, quotas)``: the words that the mix takes of each row, whole and by shard, and the block quotas by shard.

    Sizes are words. Sources in code point order (null last) weigh ``weights``, repeating; together
    they get ``share`` of all words, no source more than ``epochs`` times its size, the excess going
    to the others by weight. Blocks are of equal words: ``blocks`` of them in all, or as many more as give the
    smallest target 64. They go to the sources by the highest quotients target/(2k-1), ties to the earlier source,
    none to a source beyond ``epochs`` times its own blocks. The seats of each prefix of ``shards`` equal shards
    are apportioned so; as a larger house only adds seats, the differences are integer quotas by source and shard.

    Each source's documents lie on a line in seeded hash order. Its blocks are taken in turns from a seeded block on
    (the line is shuffled already), and each shard's quota is filled by the blocks that come next: ``parts``
    has the words of the row in each shard that takes some, ``taken`` is their sum. No block is a row: a row's
    words follow from where it lies on the line and from its source's quotas by arithmetic, whatever the size of a block.

    One row for each source and shard meets in a single task, and a few candidate seats for each source;
    lines are laid by hash buckets of about 20,000 rows whose totals are summed first, so a source with a third of all
    rows is spread like any other. Null texts and texts without words have size 0 and take 0; an empty table gives no rows.
    Where ``size_col`` names the sizes, texts aren't read and rows lie on the line by their ids alone.
    """
    text = F.coalesce(F.col(text_col), F.lit("")) if size_col is None else F.lit("")
    words = F.regexp_count(text, F.lit(WORDS)).cast("long") if size_col is None else F.col(size_col)
    sized = materialize(
        docs.select(
            F.col(id_col),
            F.col(source_col).alias("__source"),
            words.alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__h"),
        )
    )
    buckets = max(16, -(-sized.count() // 20_000))
    laid_by = sized.withColumn("__bucket", F.pmod("__h", F.lit(buckets)).cast("int"))
    cells = materialize(laid_by.groupBy("__source", "__bucket").agg(F.sum("size").alias("__cell")))
    targets = materialize(
        source_targets(cells.groupBy("__source").agg(F.sum("__cell").alias("source_size")), weights, share, epochs)
    )
    least = targets.filter("target > 0").agg(F.sum("target").alias("all"), F.min("target").alias("least")).first()
    per_block = max(1, int(min((least["all"] or 0) / blocks, (least["least"] or 0) / 64)))
    quotas = materialize(block_quotas(targets, per_block, shards, epochs))

    # for each source: where its walk starts, and how many words it has gone at the end of each shard
    size, first = F.col("source_size"), F.col("__first")
    part = F.lit(per_block).cast("long")

    def gone(taken: Column) -> Column:
        """Words of so many blocks from the first one on; only the line's last block is short."""
        rest = taken % F.col("__blocks")
        ahead = rest * part - F.when(first + rest >= F.col("__blocks"), F.col("__blocks") * part - size).otherwise(F.lit(0))
        return F.floor(taken / F.col("__blocks")) * size + F.when(rest > 0, ahead).otherwise(F.lit(0))

    plan = (
        quotas.groupBy("__source")
        .agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("__upto"))
        .join(targets.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
        .drop("__s")
        .withColumn("__blocks", F.greatest(F.lit(1), F.ceil(size / F.lit(per_block))).cast("long"))
        .withColumn("__first", F.pmod(F.xxhash64(F.lit(seed), "__source", F.lit("first")), F.col("__blocks")))
    )
    plan = plan.select("__source", "source_size", "target", (first * part).alias("__from"), F.transform("__upto", lambda x: gone(x["upto"])).alias("__gone"))

    running = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        F.col("__source").alias("__s"),
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__cell").over(running), F.lit(0)).alias("__before"),
    )
    inside = (
        Window.partitionBy("__source", "__bucket").orderBy("__h", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    laid = (
        laid_by.withColumn("__sum", F.sum("size").over(inside))
        .join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__end", F.col("__before") + F.col("__sum"))
        .withColumn("__start", F.col("__end") - F.col("size"))
        .drop("__s", "__b")
        # one row for each source
        .join(plan.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
    )

    def covered(words: Column) -> Column:
        """Words of the row within so many words of the walk, turn by turn."""
        turns, rest = F.floor(words / F.greatest(size, F.lit(1))), words % F.greatest(size, F.lit(1))
        stop = F.col("__from") + rest

        def between(a: Column, b: Column) -> Column:
            return F.greatest(F.lit(0), F.least(F.col("__end"), b) - F.greatest(F.col("__start"), a))

        return turns * F.col("size") + between(F.col("__from"), F.least(stop, size)) + between(F.lit(0), stop - size)

    reached = laid.withColumn("__reached", F.transform("__gone", covered))
    parts = F.transform(
        "__reached", lambda x, i: F.struct(i.alias("shard"), (x - F.when(i > 0, F.element_at("__reached", i)).otherwise(F.lit(0))).cast("long").alias("words"))
    )
    rows = reached.withColumn("parts", F.filter(parts, lambda x: x["words"] > 0)).select(
        id_col,
        "size",
        "source_size",
        "target",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        "parts",
    )
    return rows, quotas.select(F.col("__source").alias(source_col), "shard", "quota")


def block_quotas(targets: DataFrame, per_block: int, shards: int, epochs: int) -> DataFrame:
    """``__source, shard, quota, upto``: the seats that each source gains with each shard, by highest quotients target/(2k-1).

    With the divisor that the prefix's house suggests, rounding misplaces at most one seat for each source, so a source's seats
    are sure but for a few around its rounded share; only those are ranked: in all about six for each source and shard.
    """
    one = Window.partitionBy(F.lit(0))
    given = targets.select(
        "__source",
        "__rank",
        "target",
        (F.lit(epochs) * F.ceil(F.col("source_size") / F.lit(per_block))).cast("long").alias("__most"),
        F.sum("target").over(one).alias("__all"),
        F.count("*").over(one).alias("__n"),
    )
    houses = given.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn(
        "__house", F.floor(F.ceil(F.col("__all") / F.lit(per_block) - 1e-9) * (F.col("shard") + 1) / F.lit(shards)).cast("long")
    )
    fair = F.when(F.col("__all") > 0, F.col("target") * F.col("__house") / F.col("__all")).otherwise(F.lit(0.0))
    room = F.ceil(2.0 * F.col("__n") * F.col("target") / F.greatest(F.col("__all"), F.lit(1e-9))).cast("long") + 2
    ranged = (
        houses.withColumn("__sure", F.greatest(F.lit(0).cast("long"), F.least("__most", F.floor(fair + 0.5) - room)))
        .withColumn("__last", F.greatest("__sure", F.least("__most", F.floor(fair + 0.5).cast("long") + room)))
        .withColumn("__left", F.col("__house") - F.sum("__sure").over(Window.partitionBy("shard")))
    )
    by_quotient = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "__rank")
    ranked = (
        ranged.filter("target > 0 AND __last > __sure")
        .withColumn("k", F.explode(F.expr("sequence(__sure + 1, __last)")))
        .withColumn("__seat", F.row_number().over(by_quotient))
        .filter("__seat <= __left")
        .groupBy("__rank", "shard")
        .agg(F.count("*").alias("__won"))
    )
    upto = ranged.join(ranked, ["__rank", "shard"], "left").withColumn("upto", F.col("__sure") + F.coalesce("__won", F.lit(0)))
    before = F.lag("upto", 1, 0).over(Window.partitionBy("__rank").orderBy("shard"))
    return upto.select("__source", "shard", (F.col("upto") - before).alias("quota"), "upto")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Words wanted of each source: proportional to weight, at most ``epochs`` times its size.

    Sources reach their limit in order of size over weight; with the first j of that order held at
    their limits, the others share the rest by weight. The smallest j that pushes none above is the
    answer, found by running sums over one row for each source.
    """
    one = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = (
        sizes.withColumn("__rank", F.row_number().over(one.orderBy(F.col("__source").asc_nulls_last())))
        .withColumn("__w", F.element_at(cycle, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("__limit", F.col("source_size") * float(epochs))
        .withColumn("__total", F.sum("source_size").over(one) * float(share))
    )
    fill = one.orderBy(F.col("__limit") / F.col("__w"), "__rank")
    filled = (
        ranked.withColumn("__held", F.coalesce(F.sum("__limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__free", F.sum("__w").over(one) - F.coalesce(F.sum("__w").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__level", (F.col("__total") - F.col("__held")) / F.col("__free"))
        .withColumn("__fits", F.col("__level") * F.col("__w") <= F.col("__limit"))
        .withColumn("__fitted", F.min(F.when(F.col("__fits"), F.struct(F.col("__limit") / F.col("__w"), "__rank", "__level"))).over(one))
    )
    return filled.select(
        "__source",
        "source_size",
        "__rank",
        F.coalesce(F.least("__limit", F.col("__w") * F.col("__fitted.__level")), F.col("__limit")).alias("target"),
    )


@shielded
def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy", seed: int = 42, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with ``copy_col`` from 1 (a column of that name is replaced).

    A row is written as many times as whole sizes were taken of it; what is left of a size counts as
    a whole with the chance that is left, by a seeded hash of the row, so each source's words stay
    near its target and documents stay whole. Rows without words aren't taken. Rows stand for themselves: null and repeated ids, and rows that are
    equal in id, source and text, are taken apart from each other (equal ones by their number, so that they lie all over their source's line).
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    same = F.xxhash64(F.col(id_col).isNull(), id_col, F.col(source_col).isNull(), source_col, text_col)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long")
    thin = materialize(numbered.select("__row", same.alias("__same"), F.col(source_col).alias("__from"), size.alias("__words")))
    apart = materialize(occurrences(thin, "__same", "__row", "__nth").withColumn("__key", F.struct("__same", "__nth")))
    rows, _ = mix_sources(apart, id_col="__key", source_col="__from", size_col="__words", seed=seed, **options)
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "__key"), F.lit(1_000_000)) / 1_000_000.0
    length = F.greatest("size", F.lit(1))  # of rows that are taken it is above 0
    whole = F.floor(F.col("taken") / length)
    times = (
        rows.filter("taken > 0")
        .withColumn("__n", whole + ((F.col("taken") - whole * length) / length > chance).cast("int"))
        .filter("__n > 0")
        .select("__key", "__n")
    )
    wanted = apart.select("__row", "__key").join(times, "__key").select("__row", "__n")
    joined = numbered.join(wanted, "__row").drop("__row")
    return joined.withColumn(copy_col, F.explode(F.expr("sequence(1, cast(__n as int))"))).drop("__n")
