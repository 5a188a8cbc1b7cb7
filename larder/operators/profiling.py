"""Profiles of a raw sales panel (store_nbr, item_nbr, date, unit_sales, onpromotion)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_fractional

PAIR = ["store_nbr", "item_nbr"]


def in_window(sales: DataFrame, start: date, end: date) -> DataFrame:
    return sales.filter(F.col("date").between(F.lit(start), F.lit(end)))


def calendar(sales: DataFrame) -> DataFrame:
    """Range of dates, rows, and how many stores, items and pairs."""
    return sales.agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.countDistinct("store_nbr").alias("n_stores"),
        F.countDistinct("item_nbr").alias("n_items"), F.count("*").alias("n_rows"), F.countDistinct(*PAIR).alias("n_pairs"),
    )


def store_lifespan(sales: DataFrame) -> DataFrame:
    """First and last sale of each store, and its days with any row."""
    return sales.groupBy("store_nbr").agg(F.min("date").alias("first_sale"), F.max("date").alias("last_sale"), F.countDistinct("date").alias("n_days"))


def pair_coverage(sales: DataFrame, start: date, end: date) -> DataFrame:
    """Share of days with a sale of each pair: in the span of its sales, and in the part of the window when its store was open.

    A store's opening is its first sale at all, also before the window.
    """
    opened = sales.groupBy("store_nbr").agg(F.min("date").alias("store_open"))
    pairs = in_window(sales, start, end).groupBy(*PAIR).agg(F.min("date").alias("first_sale"), F.max("date").alias("last_sale"), F.countDistinct("date").alias("n_days_with_sale"))
    span = (F.datediff("last_sale", "first_sale") + 1).cast("long")
    window = F.datediff(F.lit(end), F.greatest(F.lit(start), F.col("store_open"))) + 1
    return pairs.join(opened, "store_nbr", "left").select(
        *PAIR, "first_sale", "last_sale", "n_days_with_sale", span.alias("span_days"), (F.col("n_days_with_sale") / span).alias("density_pair_span"),
        (F.col("n_days_with_sale") / window).alias("density_window"), (F.col("store_open") <= F.lit(start)).alias("store_covers_full_window"),
    )


#: Ranges of totals into which items are dealt for their running share.
RANGES = 64


def item_volume(sales: DataFrame) -> DataFrame:
    """Units of each item: total, median, nearest-rank p90, most, stores, and the running share of all units from the largest item on.

    The p90 is the value of rank floor(0.9 (n - 1) + 0.5) + 1. Items of equal totals follow by number. Equal values of an item
    are counted before they are ordered, and the running share is taken range by range of the totals, so no task orders all.
    """
    counted = sales.groupBy("item_nbr", "unit_sales").agg(F.count("*").alias("c"))
    item = Window.partitionBy("item_nbr")
    run = counted.withColumns({"r": F.sum("c").over(item.orderBy("unit_sales").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(item)})
    at = lambda rank: F.min(F.when(F.col("r") >= rank, F.col("unit_sales")))
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    # rounded, so that a total is the same wherever it is added up anew
    values = run.groupBy("item_nbr").agg(F.round(F.sum(F.col("unit_sales") * F.col("c")), 6).alias("total"), middle.alias("median_units"), at(F.floor(0.9 * (F.col("n") - 1) + 0.5) + 1).alias("p90_units"), F.max("unit_sales").alias("max_units"))
    per_item = values.join(sales.groupBy("item_nbr").agg(F.countDistinct("store_nbr").alias("n_stores")), "item_nbr")
    cuts = per_item.agg(F.percentile_approx("total", F.array(*(F.lit((k + 1) / RANGES) for k in range(RANGES - 1))), 10 * RANGES).alias("cuts"))  # one row
    dealt = per_item.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda x: x > F.col("total")))).drop("cuts")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    ranges = dealt.groupBy("range").agg(F.sum("total").alias("s")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("all"))
    own = F.sum("total").over(Window.partitionBy("range").orderBy(F.desc("total"), "item_nbr").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(ranges), "range").withColumn("cumulative_share", (F.col("before") + own) / F.col("all")).drop("range", "before", "all")


def ratio_by_item(sales: DataFrame, flag: F.Column, name: str) -> DataFrame:
    return sales.groupBy("item_nbr").agg(F.count("*").alias("n_rows"), F.count_if(flag).alias(f"n_{name}"), F.avg(flag.cast("double")).alias(f"{name}_ratio"))


def negatives_by_item(sales: DataFrame) -> DataFrame:
    return ratio_by_item(sales, F.col("unit_sales") < 0, "negative")


def fractional_by_item(sales: DataFrame) -> DataFrame:
    return ratio_by_item(sales, is_fractional(F.col("unit_sales")), "fractional")


def global_ratios(sales: DataFrame) -> DataFrame:
    """Rows that are negative and fractional, as numbers and shares."""
    negative, fractional = F.col("unit_sales") < 0, is_fractional(F.col("unit_sales"))
    return sales.agg(F.count("*").alias("n_rows"), F.count_if(negative).alias("n_negative"), F.avg(negative.cast("double")).alias("negative_ratio"), F.count_if(fractional).alias("n_fractional"), F.avg(fractional.cast("double")).alias("fractional_ratio"))


def promo_availability(sales: DataFrame) -> DataFrame:
    """By month, the share of rows whose promotion is unknown."""
    return sales.groupBy(F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("n_rows"), F.avg(F.col("onpromotion").isNull().cast("double")).alias("null_ratio"))


def count_candidates(coverage: DataFrame, items: DataFrame, cuts: tuple[float, ...], require_full_window: bool = True) -> DataFrame:
    """For each cut of density: pairs, stores, items and families that survive, and the family of most pairs (ties by name).

    A cut that nothing survives has its row too. Cuts are a few literals, so each pair is expanded into those that it survives.
    """
    base = coverage.filter("store_covers_full_window") if require_full_window else coverage
    base = base.join(items.select("item_nbr", "family"), "item_nbr", "left")
    alive = base.select(*PAIR, "family", F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("density_window") >= c)).alias("min_density"))
    counted = alive.groupBy("min_density").agg(F.count("*").alias("n_pairs"), F.countDistinct("store_nbr").alias("n_stores"), F.countDistinct("item_nbr").alias("n_items"), F.countDistinct("family").alias("n_families"))
    first = alive.groupBy("min_density", "family").count().groupBy("min_density").agg(F.min(F.struct(-F.col("count"), "family")).alias("f")).select("min_density", F.col("f.family").alias("top_family"))
    every = coverage.sparkSession.createDataFrame([(c,) for c in cuts], "min_density double")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(counted, "min_density", "left").join(first, "min_density", "left").select("min_density", *map(zero, ("n_pairs", "n_stores", "n_items", "n_families")), "top_family")
