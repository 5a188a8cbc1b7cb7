"""Monthly figures and comparisons from the money of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS_A_MONTH = 30


def store_totals(money: DataFrame) -> DataFrame:
    """Per store: sums over its items, and margin and stockout cost of a month of 30 days."""
    out = money.groupBy("store_id").agg(F.sum("margin").alias("margin"), F.sum("stockout_cost").alias("stockout_cost"), F.sum("loss").alias("loss"), F.sum("mean_capital").alias("capital"), F.max("n_days").alias("n_days"))
    months = F.col("n_days") / DAYS_A_MONTH
    return out.withColumns({f"monthly_{c}": F.col(c) / months for c in ("margin", "stockout_cost", "loss")})


def margin_sensitivity(totals: DataFrame, factors: tuple[float, ...]) -> DataFrame:
    """Totals under each factor of the margin; they are linear in it."""
    by = totals.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    return by.select("store_id", "factor", (F.col("margin") * F.col("factor")).alias("margin"), (F.col("stockout_cost") * F.col("factor")).alias("stockout_cost"))


def most_lost(money: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The n pairs that lose most margin to stockouts, with the share of the margin they could have made and their item's columns; ties go to the smaller store, then item."""
    top = money.orderBy(F.desc("stockout_cost"), "store_id", "item_id").limit(n)
    return top.join(items, "item_id", "left").withColumn("lost_share", F.try_divide(F.col("stockout_cost"), F.col("stockout_cost") + F.col("margin")))


def item_decomposition(ledger: DataFrame, money: DataFrame, start) -> DataFrame:
    """money with the days of the ledger from `start` on, and the days and share of them on which the pair sold something."""
    days = ledger.filter(F.col("date") >= F.lit(start)).groupBy("store_id", "item_id").agg(F.count("*").alias("days"), F.count_if(F.col("sold") > 0).alias("sale_days"))
    return money.join(days.withColumn("sale_day_share", F.col("sale_days") / F.col("days")), ["store_id", "item_id"], "left")


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation of x and y per group, equal values at the mean of their ranks; rows with a null in either are left out. Where x or y has one value alone it is NaN."""
    group = Window.partitionBy(by)

    def ranked(c: str):
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    varied = (F.min(x).over(group) < F.max(x).over(group)) & (F.min(y).over(group) < F.max(y).over(group))
    ranks = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, ranked(x).alias("rx"), ranked(y).alias("ry"), varied.alias("varied"))
    # ranks without variance would be divided by zero, which is an error; of none at all the correlation is null
    known = F.corr(F.when(F.col("varied"), F.col("rx")), F.when(F.col("varied"), F.col("ry")))
    return ranks.groupBy(by).agg(F.coalesce(known, F.lit(float("nan"))).alias("spearman"), F.count("*").alias("n"))


def order_variation(ledger: DataFrame, days: int, factor: float) -> DataFrame:
    """Orders placed, the mean of those placed on the days before, and whether an order exceeds factor times that; never cut."""
    before = Window.partitionBy("store_id", "item_id").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    placed = F.when(F.col("order") > 0, F.col("order"))
    out = ledger.withColumn("recent", F.avg(placed).over(before)).filter(F.col("order") > 0)
    return out.select("store_id", "item_id", "date", "order", "recent", F.coalesce(F.col("order") > factor * F.col("recent"), F.lit(False)).alias("flagged"))
