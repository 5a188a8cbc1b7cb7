"""Supplier rounding and cash rules over candidate orders (store_id, item_id, category, quantity, value, margin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def margin_cutoff(candidates: DataFrame, budget: float) -> DataFrame:
    """Orders by margin, best first, ties by item, until the first that the store's budget does not hold; all from there on are cut."""
    order = Window.partitionBy("store_id").orderBy(F.desc("margin"), "item_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("value").over(order)
    return candidates.withColumn("spent", spent).withColumn("kept", F.col("spent") <= budget)


def cash_rule(candidates: DataFrame, floor_share: float) -> DataFrame:
    """The whole rule by store and scenario (columns store_id, scenario, budget): kept or not, and why; cash_flag is null, reduced or protected by the floor, and shortfall what the protected lack.

    All stay where the budget holds them. Else each category's protected orders stay, and headroom of all categories as far as
    the first by margin that the rest does not hold. Where the protected alone are too much, categories are granted their
    protected orders whole, by their mean margin weighted by value, passing over those that do not fit; all headroom goes.
    A store's categories are few: they are one array.
    """
    key = ["scenario", "store_id"]
    category, store = Window.partitionBy(*key, "category"), Window.partitionBy(*key)
    running = F.sum("value").over(category.orderBy("margin", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = candidates.withColumn("is_headroom", running <= (1 - floor_share) * F.sum("value").over(category))
    guarded = F.when(~F.col("is_headroom"), F.col("value")).otherwise(0.0)
    rows = rows.withColumns({"total": F.sum("value").over(store), "protected": F.sum(guarded).over(store)})
    spent = F.sum("value").over(Window.partitionBy(*key, "is_headroom").orderBy(F.desc("margin"), "item_id").rowsBetween(Window.unboundedPreceding, 0))
    by = rows.groupBy(*key, "category").agg(F.max("budget").alias("budget"), F.sum(guarded).alias("protected"), (F.sum(F.col("value") * F.col("margin")) / F.sum("value")).alias("mean_margin"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("mean_margin")).alias("m"), "category", "protected")))
    walk = F.aggregate(
        "c", F.struct(F.col("b").alias("left"), F.expr("cast(array() as array<string>)").alias("granted")),
        lambda s, x: F.when(x["protected"] <= s["left"], F.struct((s["left"] - x["protected"]).alias("left"), F.array_append(s["granted"], x["category"]).alias("granted"))).otherwise(s),
    )
    granted = by.groupBy(*key).agg(order.alias("c"), F.max("budget").alias("b")).select(*key, walk["granted"].alias("granted"))
    rows = rows.withColumn("spent", spent).join(granted, key)
    fits, short = F.col("total") <= F.col("budget"), F.col("protected") > F.col("budget")
    alone = F.sum("value").over(Window.partitionBy(*key).orderBy(F.desc("margin"), "item_id").rowsBetween(Window.unboundedPreceding, 0)) <= F.col("budget")
    kept = F.when(fits, True).when(short, ~F.col("is_headroom") & F.array_contains("granted", F.col("category"))).otherwise(~F.col("is_headroom") | (F.col("spent") <= F.col("budget") - F.col("protected")))
    rows = rows.withColumns({"alone": alone, "kept": kept, "case_": F.when(fits, "all").when(short, "shortfall").otherwise("floor")})
    # what stays only because its category is protected, where the margin's order alone would have cut it
    flag = F.when(~F.col("kept"), "reduced").when(~F.col("is_headroom") & ~F.col("alone"), "protected by the floor")
    return rows.withColumn("cash_flag", flag).withColumn("shortfall", F.when(F.col("case_") == "shortfall", F.col("protected") - F.col("budget"))).drop("alone")


def floor_and_headroom(candidates: DataFrame, floor_share: float) -> DataFrame:
    """The orders of least margin of each category, up to 1 - floor_share of its value, are headroom; the others are protected."""
    category = Window.partitionBy("store_id", "category")
    running = F.sum("value").over(category.orderBy("margin", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    return candidates.withColumns({"running": running, "allowance": (1 - floor_share) * F.sum("value").over(category)}).withColumn("is_headroom", F.col("running") <= F.col("allowance"))
