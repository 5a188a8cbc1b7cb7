"""The selection funnel of a store's items, all stores at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The stages in order, and why pairs leave at each.
STAGES = {
    "lifespan": "its rows do not cover the whole window",
    "density": "too few days with a sale in the slice",
    "promotion": "too many days on promotion in the slice",
    "family": "its family has too few items",
    "cap": "denser items of its family fill the cap",
}


def no_leakage(slice_end: date, as_of: date) -> None:
    """The slice that selection looks at must end before what is evaluated."""
    if slice_end >= as_of:
        raise ValueError(f"the slice ends on {slice_end}, not before {as_of}")


def slice_density(panel: DataFrame, start: date, end: date) -> DataFrame:
    """Share of the panel's days with a sale, and on promotion (unknown counts as not), of each pair in a slice; with its first and last day at all."""
    inside = F.col("date").between(F.lit(start), F.lit(end))
    share = lambda flag: F.avg(F.when(inside, flag.cast("double")))
    return panel.groupBy("store_id", "item_id").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), share(F.col("units_sold") > 0).alias("density"), share(F.coalesce("on_promo", F.lit(False))).alias("promo_share")
    )


def funnel(density: DataFrame, families: DataFrame, window: tuple[date, date], floor: float, promo_ceiling: float, least: int, cap: int) -> DataFrame:
    """density with family, the items left of it in the store, rank among them, and `left_at`: the stage at which the pair goes, null if it stays."""
    whole = (F.col("first_day") <= F.lit(window[0])) & (F.col("last_day") >= F.lit(window[1]))
    at = F.when(~whole, "lifespan").when(F.coalesce(F.col("density") < floor, F.lit(True)), "density").when(F.col("promo_share") >= promo_ceiling, "promotion")
    family = Window.partitionBy("store_id", "family")
    rows = density.join(families, "item_id").withColumn("at", at).withColumn("n_family", F.count_if(F.col("at").isNull()).over(family))
    rows = rows.withColumn("at", F.coalesce("at", F.when(F.col("n_family") < least, "family")))
    ranked = rows.withColumn("rank", F.when(F.col("at").isNull(), F.row_number().over(Window.partitionBy("store_id", "family", F.col("at").isNull()).orderBy(F.desc("density"), "item_id"))))
    return ranked.withColumn("left_at", F.coalesce("at", F.when(F.col("rank") > cap, "cap"))).drop("at")


def funnel_table(selected: DataFrame) -> DataFrame:
    """By store and stage: pairs before and after, those that go, and why; at the stage of families these are listed."""
    names = list(STAGES)
    counts = selected.groupBy("store_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("left_at") == s).alias(s) for s in names), F.array_join(F.array_sort(F.collect_set(F.when(F.col("left_at") == "family", F.col("family")))), ", ").alias("small"))
    rows, gone = [], F.lit(0)
    for k, s in enumerate(names):
        why = F.when(F.col(s) > 0, F.concat(F.lit(STAGES[s]), F.concat(F.lit(": "), "small") if s == "family" else F.lit("")))
        rows.append(F.struct(F.lit(k + 1).alias("stage"), F.lit(s).alias("name"), (F.col("n") - gone).alias("before"), (F.col("n") - gone - F.col(s)).alias("after"), F.col(s).alias("excluded"), why.alias("reason")))
        gone = gone + F.col(s)
    return counts.select("store_id", F.explode(F.array(*rows)).alias("r")).select("store_id", "r.*")
