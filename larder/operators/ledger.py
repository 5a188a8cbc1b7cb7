"""Daily ledgers of what was asked for, sold, lost and held, and money measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ["store_id", "item_id"]
DAYS_A_YEAR = 365


def observed(days: DataFrame, moves: DataFrame, orders: DataFrame, held_days: int, lead_days: int) -> DataFrame:
    """The ledger of every day of a panel: demand, sold, unmet and expired units (0 where nothing moved), and the order placed, null on days without one.

    moves: (store_id, item_id, date, demand, unmet, expired), orders: (store_id, item_id, date, order). Units are held from
    held_days before the day that asks for them, and on their way for lead_days after their order.
    """
    rows = days.select(*_PAIR, "date").join(moves, [*_PAIR, "date"], "left").join(orders, [*_PAIR, "date"], "left").fillna(0.0, ["demand", "unmet", "expired"])
    by_day = Window.partitionBy(*_PAIR).orderBy(F.unix_date("date"))
    return rows.select(
        *_PAIR, "date", "demand", (F.col("demand") - F.col("unmet")).alias("sold"), "unmet", "expired", "order",
        F.sum("demand").over(by_day.rangeBetween(0, held_days)).alias("on_hand"), F.coalesce(F.sum("order").over(by_day.rangeBetween(-lead_days, -1)), F.lit(0.0)).alias("in_transit"),
    )


def item_economics(items: DataFrame, margins: tuple[tuple[str, float], ...], default_margin: float, price: float) -> DataFrame:
    """(item_id, price, cost, margin) from the category's margin; categories without one have the default."""
    margin = F.coalesce(*(F.when(F.col("category") == c, F.lit(m)) for c, m in margins), F.lit(default_margin))
    return items.select("item_id", F.lit(price).alias("price"), (F.lit(price) * (1 - margin)).alias("cost"), margin.alias("margin"))


def priced(events: DataFrame, economics: DataFrame, start) -> DataFrame:
    """Events from `start` on, when the warm-up is over, with price and cost; an item that has none is an error, which tells some."""
    rows = events.filter(F.col("date") >= F.lit(start))
    lost = [r.item_id for r in rows.select("item_id").distinct().join(economics.filter("price is not null and cost is not null"), "item_id", "left_anti").orderBy("item_id").limit(5).collect()]
    if lost:
        raise ValueError(f"no price or cost of items {', '.join(lost)}")
    return rows.join(economics.select("item_id", "price", "cost"), "item_id")


def _ratios(out: DataFrame, capital_cost: float) -> DataFrame:
    """service_level, turn, carrying_cost and decision_metric from sums; null where what divides is 0."""
    return out.withColumns({
        "service_level": F.try_divide("units_sold", "units_asked"), "turn": F.try_divide(F.col("cogs"), F.col("mean_capital")) * DAYS_A_YEAR / F.col("n_days"),
        "carrying_cost": F.col("mean_capital") * F.col("n_days") * capital_cost / DAYS_A_YEAR, "decision_metric": F.try_divide(F.col("margin") - F.col("loss"), F.col("mean_capital")),
    }).drop("units_sold", "units_asked", "cogs")


def _sums() -> list[Column]:
    earned = F.col("price") - F.col("cost")
    return [
        F.sum(F.col("sold") * earned).alias("margin"), F.sum(F.col("unmet") * earned).alias("stockout_cost"), F.sum(F.col("expired") * F.col("cost")).alias("loss"),
        F.sum(F.col("sold") * F.col("cost")).alias("cogs"), F.sum("sold").alias("units_sold"), F.sum("demand").alias("units_asked"),
    ]


def item_money(rows: DataFrame, capital_cost: float, by: tuple[str, ...] = ("store_id", "item_id")) -> DataFrame:
    """Per item of a priced ledger: margin, stockout cost, loss, mean capital, service level, annualised turn, carrying cost and the decision metric (margin less loss per money held)."""
    return _ratios(rows.groupBy(*by).agg(*_sums(), F.avg(F.col("on_hand") * F.col("cost")).alias("mean_capital"), F.count("*").alias("n_days")), capital_cost)


def portfolio_money(rows: DataFrame, capital_cost: float, by: tuple[str, ...] = ("store_id",)) -> DataFrame:
    """The same over all items: ratios of sums, never means of ratios; capital is summed by day, then averaged."""
    daily = rows.groupBy(*by, "date").agg(*_sums(), F.sum(F.col("on_hand") * F.col("cost")).alias("capital"))
    summed = [F.sum(c).alias(c) for c in ("margin", "stockout_cost", "loss", "cogs", "units_sold", "units_asked")]
    return _ratios(daily.groupBy(*by).agg(*summed, F.avg("capital").alias("mean_capital"), F.count("*").alias("n_days")), capital_cost)


def daily_margin(rows: DataFrame) -> DataFrame:
    """Margin less loss by store and day, and its running total."""
    net = F.sum(F.col("sold") * (F.col("price") - F.col("cost")) - F.col("expired") * F.col("cost"))
    out = rows.groupBy("store_id", "date").agg(net.alias("net_margin"))
    return out.withColumn("running", F.sum("net_margin").over(Window.partitionBy("store_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """All doubles at so many decimals: sums of doubles depend on their order beyond that."""
    return df.withColumns({name: F.round(name, places) for name, kind in df.dtypes if kind == "double"})
