"""Price tables and what a figure costs by them: merging and checking tables, billing, bounds and sums with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def names_of(prices: DataFrame) -> Column:
    return F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>")))


def over(config: DataFrame, fetched: DataFrame) -> DataFrame:
    """A person's price rows over fetched ones: a fetched row stays only if none of its names is named by a row of ``config``."""
    named = config.select(F.explode(names_of(config)).alias("__name")).distinct()
    rows = fetched.withColumn("__id", F.struct(F.col("model"), F.col("from")))
    taken = rows.select("__id", F.explode(names_of(rows)).alias("__name")).join(named, "__name", "left_semi").select("__id").distinct()
    return config.unionByName(rows.join(taken, rows["__id"].eqNullSafe(taken["__id"]), "left_anti").drop("__id"))


def refusals(prices: DataFrame, price_columns: list[str]) -> DataFrame:
    """``model, from, reason``: rows that a table may not hold: negative prices, an end not after the start, names or validities that overlap."""
    bad = F.lit(False)
    for c in price_columns:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    own = prices.select("model", "from", F.when(bad, "negative-price").when(F.col("until") <= F.col("from"), "empty-validity").alias("reason")).filter("reason IS NOT NULL")
    each = prices.select("model", "from", "until", F.explode(names_of(prices)).alias("name"))
    by = Window.partitionBy("name").orderBy(F.col("from").asc_nulls_first(), "model")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    # open ends reach beyond every date
    end = F.max(F.coalesce("until", F.lit("9999-12-31").cast("timestamp_ntz"))).over(upto)
    clash = each.withColumn("__end", end).filter(F.col("__end").isNotNull() & (F.col("from").isNull() | (F.col("from") < F.col("__end"))))
    return own.unionByName(clash.select("model", "from", F.lit("overlapping-validity").alias("reason")).distinct())


def markdown_rows(pages: DataFrame, text: str = "text") -> DataFrame:
    """Cells of the tables in fetched pages: ``page, line, cells`` (trimmed), headings and rulers included as rows of their own."""
    lines = pages.select("page", F.posexplode(F.split(text, "\n")).alias("line", "value")).filter(F.trim("value").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines.select("page", "line", cells.alias("cells")).filter(~F.forall("cells", lambda c: c.rlike(r"^:?-+:?$")))


def price_per_million(cell: Column) -> Column:
    """``$3 / MTok``, ``3.75``, ``$0.30 per million`` as a number; null for anything else."""
    return F.regexp_extract(cell, r"^\$?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:/\s*MTok|per million(?: tokens)?)?$", 1).try_cast("double")


def resolved_billing(records: DataFrame, rules: DataFrame) -> DataFrame:
    """``terms`` of each record: api, subscription or unestablished.

    A plan's rule overrides what the reader saw; a part read of a recording establishes nothing, as a record it left out can
    contradict it. ``records``: terms, plan, partial. ``rules``: plan, terms.
    """
    ruled = rules.select("plan", F.col("terms").alias("__rule"))
    terms = F.when(F.col("partial"), "unestablished").otherwise(F.coalesce("__rule", "terms", F.lit("unestablished")))
    return records.join(ruled, "plan", "left").withColumn("terms", terms).drop("__rule")


def estimate_sum(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``priced, amount, at_least, at_most, reasons``: an amount only where the bounds of all parts meet; the reasons are united.

    ``parts``: keys, low, high (null where not priced), reason.
    """
    summed = parts.groupBy(*keys).agg(
        F.count("low").alias("priced"), F.coalesce(F.sum("low"), F.lit(0)).alias("__low"), F.coalesce(F.sum("high"), F.lit(0)).alias("__high"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")
    )
    any_ = F.col("priced") > 0
    wide = F.col("__high") != F.col("__low")
    return summed.select(*keys, "priced", F.when(any_ & ~wide, F.col("__low")).alias("amount"), F.when(any_ & wide, F.col("__low")).alias("at_least"), F.when(any_ & wide, F.col("__high")).alias("at_most"), "reasons")


def covered_figure(figures: DataFrame, shares: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """For each counter what the models' shares leave of a figure, and ``incomplete-attribution`` where they don't cover it."""
    summed = shares.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in counters])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("whole"), F.coalesce(f"__{c}", F.lit(0)).alias("shared")) for c in counters]))
    left = figures.join(summed, keys, "left").select(*keys, rows.alias("x")).select(*keys, "x.*").filter("whole IS NOT NULL")
    return left.withColumns({"left": F.col("whole") - F.col("shared"), "reason": F.when(F.col("shared") < F.col("whole"), "incomplete-attribution")})


def rate_bounds(remainder: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tokens, low, high, reason``: what tokens that no priced request holds may cost: between the least and the most of all rates of their model."""
    span = rates.groupBy(*keys).agg(F.min("rate").alias("__low"), F.max("rate").alias("__high"), F.count_if(F.col("rate").isNull()).alias("__none"))
    met = remainder.join(span, keys, "left")
    unpriced = F.col("__low").isNull() | (F.col("__none") > 0)
    reason = F.when(F.col("tokens") == 0, None).when(F.col("__low").isNull(), "unlisted-model").when(F.col("__none") > 0, "missing-price").when(F.col("__low") != F.col("__high"), "rate-not-established")
    zero = F.col("tokens") == 0
    return met.select(*keys, "tokens", F.when(zero, 0).when(~unpriced, F.col("tokens") * F.col("__low")).alias("low"), F.when(zero, 0).when(~unpriced, F.col("tokens") * F.col("__high")).alias("high"), reason.alias("reason"))
