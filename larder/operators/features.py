"""Feature rows at decision dates, also for items without any history, and the demand that followed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ["store_id", "item_id"]


def at_dates(pairs: DataFrame, dates: Column) -> DataFrame:
    """A row per pair and date of the array `dates`, named as_of: the rows for which features are asked."""
    return pairs.select(*_PAIR, F.explode(dates).alias("as_of"))


def history_features(history: DataFrame, asked: DataFrame, lags: tuple[int, ...], windows: tuple[int, ...], flags: DataFrame | None = None) -> DataFrame:
    """For every row of asked (store_id, item_id, as_of, a pair and date once): what the days strictly before as_of tell.

    lag_units_k: units exactly k days before, null without such a row. For each window of w days the mean and sum of units and
    the shares of days with a sale, on promotion and with a promotion known; what divides is the days that are there, and all
    are null where none is. Days since the last sale and promotion. Days that `flags` marks as censored are no history.

    The asked rows stand in the history as rows without units, so one exchange and one sort by pair serve all windows, and a
    pair without history has its row all the same.
    """
    if flags is not None:
        history = history.join(flags.filter("is_censored").select(*_PAIR, "date"), [*_PAIR, "date"], "left_anti")
    known = history.select(*_PAIR, "date", "units_sold", "on_promo", F.lit(False).alias("asked"))
    rows = known.unionByName(asked.select(*_PAIR, F.col("as_of").alias("date"), F.lit(None).cast("double").alias("units_sold"), F.lit(None).cast("boolean").alias("on_promo"), F.lit(True).alias("asked")))
    by_day = Window.partitionBy(*_PAIR).orderBy(F.unix_date("date"))
    there, promo = ~F.col("asked"), F.coalesce("on_promo", F.lit(False))
    columns = {f"lag_units_{k}": F.max("units_sold").over(by_day.rangeBetween(-k, -k)) for k in lags}
    for w in windows:
        past = by_day.rangeBetween(-w, -1)
        n = F.count_if(there).over(past)
        share = lambda flag, past=past, n=n: F.when(n > 0, F.count_if(there & flag).over(past) / n)
        columns |= {
            f"rolling_mean_units_{w}d": F.avg("units_sold").over(past), f"rolling_sum_units_{w}d": F.sum("units_sold").over(past),
            f"share_days_with_sale_{w}d": share(F.col("units_sold") > 0), f"promo_share_{w}d": share(promo), f"promo_known_share_{w}d": share(F.col("on_promo").isNotNull()),
        }
    ever = by_day.rangeBetween(Window.unboundedPreceding, -1)
    since = lambda flag: F.datediff("date", F.max(F.when(flag, F.col("date"))).over(ever)).cast("long")
    columns |= {"days_since_last_sale": since(F.col("units_sold") > 0), "days_since_last_promo": since(promo)}
    return rows.select(*_PAIR, "date", "asked", *(c.alias(name) for name, c in columns.items())).filter("asked").drop("asked").withColumnRenamed("date", "as_of")


def feature_rows(history: DataFrame, asked: DataFrame, items: DataFrame, calendar: DataFrame, lags: tuple[int, ...], windows: tuple[int, ...], active: tuple[str, ...], flags: DataFrame | None = None) -> DataFrame:
    """history_features() with the items' attributes (item_id, ...) and the calendar's (store_id, date, ...), cut down to the active columns."""
    rows = history_features(history, asked, lags, windows, flags)
    return active_columns(rows.join(items, "item_id", "left").join(calendar.withColumnRenamed("date", "as_of"), ["store_id", "as_of"], "left"), active)


def active_columns(frame: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """The key and the active columns; a name that the frame lacks is an error that tells all such names."""
    unknown = [c for c in active if c not in frame.columns]
    if unknown:
        raise ValueError(f"no such features: {', '.join(unknown)}; there are {', '.join(sorted(frame.columns))}")
    return frame.select(*_PAIR, "as_of", *active)


def window_targets(history: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (store_id, item_id, as_of, horizon) with `target`: the units of the horizon's days, as_of the first of them. A day without a row sold nothing.

    Each asked row is dealt out to its days and these are joined by key, so horizons may differ from item to item.
    """
    days = asked.select(*_PAIR, "as_of", "horizon", F.explode(F.sequence(F.lit(0), F.col("horizon").cast("int") - 1)).alias("k")).withColumn("date", F.date_add("as_of", F.col("k")))
    joined = days.join(history.select(*_PAIR, "date", "units_sold"), [*_PAIR, "date"], "left")
    return joined.groupBy(*_PAIR, "as_of", "horizon").agg(F.coalesce(F.sum("units_sold"), F.lit(0.0)).alias("target"))


def category_codes(items: DataFrame, column: str) -> DataFrame:
    """(column, code): each value's place among all values of the item registry, as text, from 0 on; the values of a column are few."""
    return items.select(column).filter(F.col(column).isNotNull()).distinct().select(column, (F.row_number().over(Window.orderBy(F.col(column).cast("string"))) - 1).alias("code"))


def usable_origins(asked: DataFrame, retrains: DataFrame, least: int) -> DataFrame:
    """asked (with horizon) once per retraining date by which the longest horizon of all its rows has passed, with the age in days.

    A retraining date with fewer than `least` origins is an error, never a fit on less.
    """
    longest = asked.agg(F.max("horizon")).first()[0] or 0
    origins = asked.select("as_of").distinct().join(F.broadcast(retrains), F.date_add("as_of", longest) <= F.col("retrain"))
    counts = {r.retrain: r.n for r in origins.groupBy("retrain").agg(F.count("*").alias("n")).collect()}
    short = [f"{r.retrain}: {counts.get(r.retrain, 0)}" for r in retrains.collect() if counts.get(r.retrain, 0) < least]
    if short:
        raise ValueError(f"origins known by each retraining date, at least {least} are asked for: {', '.join(short)}")
    return asked.join(F.broadcast(retrains), F.date_add("as_of", longest) <= F.col("retrain")).withColumn("age", F.datediff("retrain", "as_of").cast("long"))
