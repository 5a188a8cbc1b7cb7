"""Order quantities, coverage caps, new items and supplier minima over decisions, a row per store and item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def erp_order(daily_mean: Column, position: Column, days: int, factor: float, least: float) -> Column:
    """Mean demand over so many days, scaled, less the position; 0 if not positive, otherwise `least` at least."""
    need = daily_mean * days * factor - position
    return F.when(need > 0, F.greatest(need, F.lit(least))).otherwise(0.0)


def target_order(level: Column, position: Column) -> tuple[Column, Column]:
    """The order up to a target level, and what the position has above it."""
    return F.greatest(level - position, F.lit(0.0)), F.greatest(position - level, F.lit(0.0))


def coverage_cap(quantity: Column, shelf_life: Column, risk_window: int | Column, daily: Column, position: Column) -> tuple[Column, Column, Column]:
    """(quantity, cut, conflict): at most the demand of the shelf life, or of the risk window if longer, less the position.

    A conflict is noted where the shelf life alone would have cut deeper. Without demand or order nothing is cut.
    """
    zero = F.lit(0.0)
    applies = (daily > 0) & (quantity > 0)
    of_shelf = F.greatest(zero, shelf_life * daily - position)
    most = F.greatest(zero, F.greatest(shelf_life, F.lit(risk_window).cast("double")) * daily - position)
    cut = applies & (quantity > most)
    return F.when(cut, most).otherwise(quantity), cut, applies & (shelf_life < risk_window) & (quantity > of_shelf)


def new_items(history: DataFrame, as_of, least_history: int, least_days: int) -> DataFrame:
    """Per pair whether it is new at as_of: never sold, first sold lately, or sold on few days."""
    sold = F.col("units_sold") > 0
    out = history.filter(F.col("date") < F.lit(as_of)).groupBy("store_id", "item_id").agg(F.min(F.when(sold, F.col("date"))).alias("first"), F.count_if(sold).alias("n"))
    new = F.col("first").isNull() | (F.datediff(F.lit(as_of), "first") < least_history) | (F.col("n") < least_days)
    return out.select("store_id", "item_id", new.alias("is_new"))


def new_item_quantity(decisions: DataFrame) -> DataFrame:
    """New items take the median quantity of their category's other items in the store, else the store's, else 0; never what the model would order. by_store tells where the category had none."""
    known = decisions.filter("not is_new")
    by_category = known.groupBy("store_id", "category").agg(F.median("quantity").alias("of_category"))
    by_store = known.groupBy("store_id").agg(F.median("quantity").alias("of_store"))
    joined = decisions.join(by_category, ["store_id", "category"], "left").join(by_store, "store_id", "left")
    return joined.withColumn("quantity", F.when(F.col("is_new"), F.coalesce("of_category", "of_store", F.lit(0.0))).otherwise(F.col("quantity"))).withColumn("by_store", F.col("is_new") & F.col("of_category").isNull()).drop("of_category", "of_store")


def fill_to_minimum(orders: DataFrame, least_value: float, least_units: float, most_packs: int) -> DataFrame:
    """filled() with the same minima for all suppliers, as quantity and outcome alone."""
    out = filled(orders.withColumns({"least_value": F.lit(least_value), "least_units": F.lit(least_units)}), most_packs)
    return out.drop("added_packs", "least_value", "least_units")


def filled(orders: DataFrame, most_packs: int) -> DataFrame:
    """Orders (store_id, supplier_id, item_id, quantity, pack, unit_cost, daily, position, least_value, least_units) with added_packs, order and outcome.

    A supplier's order must reach both its minima (0 is none). If it does not, packs are added one at a time to the item that is
    covered for the fewest days, ties by item, most_packs in all; items without demand get none. Coverage grows with each pack,
    so the greedy order is one sort of all possible packs. An order that stays below is deferred whole; its added packs tell
    what was tried.
    """
    supplier = ["store_id", "supplier_id"]
    totals = orders.groupBy(*supplier).agg(
        F.round(F.sum(F.col("quantity") * F.col("unit_cost")), 6).alias("value0"), F.round(F.sum("quantity"), 6).alias("units0"), F.max("least_value").alias("v"), F.max("least_units").alias("u")
    )
    meets = lambda value, units: ((F.col("v") <= 0) | (value >= F.col("v"))) & ((F.col("u") <= 0) | (units >= F.col("u")))
    totals = totals.withColumn("met0", meets(F.col("value0"), F.col("units0")))
    packs = orders.join(totals.filter("not met0"), supplier).filter("daily > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most_packs - 1))).alias("k"))
    packs = packs.withColumn("days", (F.col("position") + F.col("quantity") + F.col("k") * F.col("pack")) / F.col("daily"))
    order = Window.partitionBy(*supplier).orderBy("days", "item_id", "k").rowsBetween(Window.unboundedPreceding, 0)
    run = packs.select(
        *supplier, "item_id", F.count("*").over(order).alias("rank"),
        meets(F.col("value0") + F.sum(F.col("pack") * F.col("unit_cost")).over(order), F.col("units0") + F.sum("pack").over(order)).alias("met"),
    ).filter(F.col("rank") <= most_packs)
    last = run.groupBy(*supplier).agg(F.min(F.when(F.col("met"), F.col("rank"))).alias("first"))
    added = run.join(last, supplier).filter(F.col("rank") <= F.coalesce("first", F.lit(most_packs))).groupBy(*supplier, "item_id").agg(F.count("*").alias("added_packs"))
    out = orders.join(totals.select(*supplier, "met0"), supplier).join(last, supplier, "left").join(added, [*supplier, "item_id"], "left").fillna(0, ["added_packs"])
    outcome = F.when(F.col("met0"), "placed").when(F.col("first").isNotNull(), "filled").otherwise("deferred")
    return out.withColumn("outcome", outcome).withColumn("order", F.when(F.col("outcome") == "deferred", 0.0).otherwise(F.col("quantity") + F.col("added_packs") * F.col("pack"))).drop("met0", "first")
