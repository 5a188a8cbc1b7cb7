"""From raw sales to a dense daily panel, items and suppliers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import positive_part
from .profiling import PAIR, fractional_by_item, in_window

KEYS = ["store_id", "item_id", "date"]


def lifespans(sales: DataFrame, start: date, end: date, gap_days: int) -> DataFrame:
    """First and last day of each pair in the panel; pairs without a sale in the window have none.

    A pair enters at its first sale at all, or the window's start. One whose last sale in the window lies more than gap_days
    before its end leaves gap_days after that sale. Nothing after the window is looked at for the exit.
    """
    # a pair's first sale is never before its store's, so the opening needs no aggregation of its own
    first = sales.groupBy(*PAIR).agg(
        F.min("date").alias("first_sale"), F.max(F.when(F.col("date").between(F.lit(start), F.lit(end)), F.col("date"))).alias("last_sale")
    ).filter("last_sale is not null")
    late = F.datediff(F.lit(end), F.col("last_sale")) > gap_days
    return first.select(*PAIR, F.greatest("first_sale", F.lit(start)).alias("entry_date"), F.when(late, F.date_add("last_sale", gap_days)).otherwise(F.lit(end)).alias("exit_date"))


def spine(bounds: DataFrame) -> DataFrame:
    """A row per pair and day of its life."""
    return bounds.select(*PAIR, F.explode(F.sequence("entry_date", "exit_date")).alias("date"))


def operating_days(sales: DataFrame) -> DataFrame:
    return sales.select("store_nbr", "date").distinct()


def anomaly(day: Column, periods: tuple[tuple[date, date, str], ...]) -> tuple[Column, Column]:
    """Whether a day lies in a period, and the reason of the first that it lies in."""
    reason = F.lit(None).cast("string")
    for start, end, why in reversed(periods):
        reason = F.when(day.between(F.lit(start), F.lit(end)), why).otherwise(reason)
    return reason.isNotNull(), reason


def panel(sales: DataFrame, start: date, end: date, gap_days: int, anomalies: tuple[tuple[date, date, str], ...] = ()) -> DataFrame:
    """Dense daily sales of each pair's life: units sold and returned parted, unknown promotions null, days without any sale of the store marked."""
    windowed = in_window(sales, start, end)
    days = operating_days(windowed).withColumn("is_operating_day", F.lit(True))
    marked, why = anomaly(F.col("date"), anomalies)
    units = F.coalesce("unit_sales", F.lit(0.0))
    return (
        spine(lifespans(sales, start, end, gap_days)).join(windowed, [*PAIR, "date"], "left").join(days, ["store_nbr", "date"], "left")
        .select(
            F.col("store_nbr").cast("string").alias("store_id"), F.col("item_nbr").cast("string").alias("item_id"), "date", positive_part(units).alias("units_sold"), positive_part(-units).alias("units_returned"),
            F.col("onpromotion").alias("on_promo"), F.coalesce("is_operating_day", F.lit(False)).alias("is_operating_day"), marked.alias("is_anomaly"), why.alias("anomaly_reason"),
        )
    )


def items(raw: DataFrame, windowed: DataFrame, margins: tuple[tuple[str, float], ...], default_margin: float, threshold: float, price: float) -> DataFrame:
    """Registry of items: sold by weight where more than threshold of its rows are fractional; cost from the family's margin."""
    ratio = fractional_by_item(windowed).select("item_nbr", "fractional_ratio")
    table = F.broadcast(raw.sparkSession.createDataFrame(list(margins), "family string, margin double"))
    margin = F.coalesce("margin", F.lit(default_margin))
    return raw.join(ratio, "item_nbr", "left").join(table, "family", "left").select(
        F.col("item_nbr").cast("string").alias("item_id"), F.col("family").alias("category"), supplier_slug(F.col("family")).alias("supplier_id"),
        F.when(F.coalesce("fractional_ratio", F.lit(0.0)) > threshold, "kg").otherwise("unidade").alias("unit_of_sale"), (F.col("perishable") == 1).alias("is_perishable"),
        F.lit(price).alias("price_ref"), (F.lit(price) * (1 - margin)).alias("cost"),
    )


def supplier_slug(family: Column) -> Column:
    return F.concat(F.lit("SUP-"), F.regexp_replace(F.regexp_replace(F.upper(F.trim(family)), "[^A-Z0-9]+", "_"), "^_+|_+$", ""))


def slug_collisions(raw: DataFrame) -> DataFrame:
    """Slugs that several families share: an error to its caller."""
    return raw.select(supplier_slug(F.col("family")).alias("supplier_id"), "family").distinct().groupBy("supplier_id").agg(F.count("*").alias("n_families")).filter("n_families > 1")


def probable_stockouts(sales: DataFrame, window: int, least_mean: float, least_days: int, receipts: DataFrame | None = None, quiet_days: int = 3) -> DataFrame:
    """Days without a sale after a window (days, the day itself left out) of brisk ones, unless goods came in a few days before."""
    past = Window.partitionBy("store_id", "item_id").orderBy(F.unix_date("date")).rangeBetween(-window, -1)
    found = sales.select(*KEYS, "units_sold", F.avg("units_sold").over(past).alias("m"), F.count_if(F.col("units_sold") > 0).over(past).alias("n"))
    pattern = F.coalesce((F.col("units_sold") == 0) & (F.col("m") >= least_mean) & (F.col("n") >= least_days), F.lit(False))
    if receipts is not None and quiet_days > 0:
        covered = receipts.select("store_id", "item_id", F.explode(F.sequence(F.date_add("received_date", 1), F.date_add("received_date", quiet_days))).alias("date")).distinct().withColumn("recent", F.lit(True))
        found = found.join(covered, KEYS, "left")
        pattern = pattern & F.col("recent").isNull()
    return found.select(*KEYS, pattern.alias("is_censored"), F.when(pattern, "entries_unknown" if receipts is None else "no_recent_entry").alias("reason"))


def flags_if_active(sales: DataFrame, active: bool, window: int, least_mean: float | None, least_days: int | None, receipts: DataFrame | None = None, quiet_days: int = 3) -> DataFrame | None:
    """probable_stockouts() where censoring is switched on, else None. A threshold that is not set is an error only when it is needed, which names it."""
    if not active:
        return None
    unset = [name for name, value in (("least_mean", least_mean), ("least_days", least_days)) if value is None]
    if unset:
        raise ValueError(f"censoring is on, but {', '.join(unset)} is not set")
    return probable_stockouts(sales, window, least_mean, least_days, receipts, quiet_days)


def drop_censored(history: DataFrame, flags: DataFrame) -> DataFrame:
    return history.join(flags.filter("is_censored").select(*KEYS), KEYS, "left_anti")


def uncensored(sales: DataFrame, window: int, least_mean: float, least_days: int) -> DataFrame:
    """sales without its probable stockouts, found in the same pass: no join of the panel with its own flags."""
    past = Window.partitionBy("store_id", "item_id").orderBy(F.unix_date("date")).rangeBetween(-window, -1)
    brisk = (F.avg("units_sold").over(past) >= least_mean) & (F.count_if(F.col("units_sold") > 0).over(past) >= least_days)
    flagged = sales.withColumn("_censored", F.coalesce((F.col("units_sold") == 0) & brisk, F.lit(False)))
    return flagged.filter("not _censored").drop("_censored")


def suppliers(raw: DataFrame, lead_days: int, review_days: int, order_days: tuple[int, ...], least_value: float, least_units: float) -> DataFrame:
    """A supplier for each family, on assumed terms."""
    return raw.select(supplier_slug(F.col("family")).alias("supplier_id")).distinct().select(
        "supplier_id", F.lit(lead_days).cast("long").alias("lead_time_days"), F.array(*(F.lit(d).cast("long") for d in order_days)).alias("order_days"), F.lit(review_days).cast("long").alias("review_period_days"),
        F.lit(least_value).alias("min_order_value"), F.lit(least_units).alias("min_order_units"),
    )


def censoring_summary(flags: DataFrame, alert_share: float = 0.15) -> DataFrame:
    """Flagged days by pair, and a row TOTAL; alert where their share is above alert_share."""
    out = flags.groupingSets([["store_id", "item_id"], []], "store_id", "item_id").agg(F.count("*").alias("n_days"), F.count_if("is_censored").alias("n_censored"))
    return out.select(F.coalesce("store_id", F.lit("TOTAL")).alias("store_id"), F.coalesce("item_id", F.lit("TOTAL")).alias("item_id"), "n_days", "n_censored", (F.col("n_censored") / F.col("n_days")).alias("censored_share"), (F.col("n_censored") / F.col("n_days") > alert_share).alias("alert"))
