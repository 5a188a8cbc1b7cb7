"""Forecasts of the demand summed over a risk window, from a daily panel. Windows count days, not rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ["store_id", "item_id"]


def _days(low: int, high: int):
    return Window.partitionBy(*_PAIR).orderBy(F.unix_date("date")).rangeBetween(low, high)


def lag_on_day(history: DataFrame, days: int) -> DataFrame:
    """Units exactly so many days before, null where the panel has no row: rows may have gaps, so lag() would be wrong."""
    return history.select(*_PAIR, "date", F.max("units_sold").over(_days(-days, -days)).alias(f"lag_{days}"))


def window_features(history: DataFrame, days: int) -> DataFrame:
    """Mean, sum, shares of days with a sale, on promotion and with a known promotion over the days before; and days since the last sale and promotion."""
    past, ever = _days(-days, -1), _days(Window.unboundedPreceding, -1)
    promo = F.coalesce("on_promo", F.lit(False))
    since = lambda flag: F.datediff("date", F.max(F.when(flag, F.col("date"))).over(ever)).cast("long")
    return history.select(
        *_PAIR, "date", F.avg("units_sold").over(past).alias("mean"), F.sum("units_sold").over(past).alias("total"), F.avg((F.col("units_sold") > 0).cast("double")).over(past).alias("sale_share"),
        F.avg(promo.cast("double")).over(past).alias("promo_share"), F.avg(F.col("on_promo").isNotNull().cast("double")).over(past).alias("promo_known_share"),
        since(F.col("units_sold") > 0).alias("days_since_sale"), since(promo).alias("days_since_promo"),
    )


def naive_points(history: DataFrame, weeks: int, horizon: int) -> DataFrame:
    """For every day: the trailing mean (0 without history), the forecast of the risk window that begins with it, what came, and the residual.

    A residual exists where all days of the window are there and the day has history.
    """
    past, ahead = _days(-7 * weeks, -1), _days(0, horizon - 1)
    mean = F.coalesce(F.avg("units_sold").over(past), F.lit(0.0))
    out = history.select(*_PAIR, "date", mean.alias("daily_mean"), F.count("*").over(past).alias("n_past"), F.sum("units_sold").over(ahead).alias("actual"), F.count("*").over(ahead).alias("n_ahead"))
    whole = (F.col("n_ahead") == horizon) & (F.col("n_past") > 0)
    return out.select(*_PAIR, "date", "daily_mean", (F.col("daily_mean") * horizon).alias("point"), F.when(F.col("n_ahead") == horizon, F.col("actual")).alias("actual"), F.when(whole, F.col("actual") - F.col("daily_mean") * horizon).alias("residual"))


def naive_quantiles(points: DataFrame, as_of, horizon: int, quantiles: tuple[float, ...], least: int) -> DataFrame:
    """Quantiles of the summed demand at as_of: the point and the residuals' linear quantile, at least 0; the point alone where residuals are few.

    Only residuals whose whole window lies before as_of are known then.
    """
    known = points.filter(F.col("date") <= F.date_sub(F.lit(as_of), horizon)).groupBy(*_PAIR).agg(F.percentile("residual", F.array(*map(F.lit, quantiles))).alias("r"), F.count("residual").alias("n"))
    at = points.filter(F.col("date") == F.lit(as_of)).select(*_PAIR, "point").join(known, _PAIR, "left")
    long = at.select(*_PAIR, "point", "n", F.posexplode(F.coalesce("r", F.array_repeat(F.lit(0.0), len(quantiles)))).alias("k", "r"))
    value = F.when(F.coalesce("n", F.lit(0)) >= least, F.greatest(F.lit(0.0), F.col("point") + F.col("r"))).otherwise(F.col("point"))
    return long.select(*_PAIR, F.element_at(F.array(*map(F.lit, quantiles)), F.col("k") + 1).alias("quantile"), value.alias("value"))


def seasonal_naive(history: DataFrame, as_of, horizon: int) -> DataFrame:
    """Each day of the risk window takes the last same weekday before as_of; null where one is missing."""
    back = lambda k: 7 * (k // 7 + 1) - k
    wanted = {k: back(k) for k in range(horizon)}
    pairs = history.filter(F.col("date") < F.lit(as_of)).groupBy(*_PAIR)
    ago = F.datediff(F.lit(as_of), F.col("date"))
    times = sum((F.when(ago == d, 1).otherwise(0) for d in wanted.values()), F.lit(0))
    return pairs.agg(F.sum(times * F.col("units_sold")).alias("s"), F.sum(times).alias("n")).select(*_PAIR, F.when(F.col("n") == horizon, F.col("s")).alias("value"))


def seasonal_rival(history: DataFrame, horizon: int) -> DataFrame:
    """For every day the seasonal naive forecast of the window of at most a week that begins with it: the same days a week before, null where one is missing."""
    if horizon > 7:
        raise ValueError("windows of more than a week repeat reference days")
    week_ago = _days(-7, horizon - 8)
    return history.select(*_PAIR, "date", F.when(F.count("*").over(week_ago) == horizon, F.sum("units_sold").over(week_ago)).alias("rival"))


def non_crossing(quantiles: DataFrame) -> DataFrame:
    """Values of each pair's quantiles put in order, by rank; `crossed` tells whether that moved any."""
    by = quantiles.groupBy(*_PAIR).agg(F.array_sort(F.collect_list(F.struct("quantile", "value"))).alias("q"))
    raw = F.transform("q", lambda x: x["value"])
    by = by.select(*_PAIR, F.transform("q", lambda x: x["quantile"]).alias("names"), F.array_sort(raw).alias("sorted"), (F.array_sort(raw) != raw).alias("crossed"))
    return by.select(*_PAIR, "crossed", F.explode(F.arrays_zip("names", "sorted")).alias("z")).select(*_PAIR, F.col("z.names").alias("quantile"), F.col("z.sorted").alias("value"), "crossed")


def as_of_retrain(days: DataFrame, retrains: tuple, column: str = "date") -> DataFrame:
    """days with the latest retraining date that is not after each, null before the first; the few retraining dates are parameters."""
    known = F.array(*(F.lit(d) for d in retrains))
    return days.withColumn("retrain", F.array_max(F.filter(known, lambda d: d <= F.col(column))))


def weekly_points(history: DataFrame, season_weeks: int, level_weeks: int, horizon: int) -> DataFrame:
    """For every day the level, and the point forecast of the risk window: level times the indices of its weekdays.

    A weekday's index is its mean over the season before, by the mean of all days there; 1 where either is missing or the latter
    is 0. The level is the mean of the recent units, each by its index if that is positive; 0 without any.
    """
    season, recent = _days(-7 * season_weeks, -1), _days(-7 * level_weeks, -1)
    today, units = F.weekday("date"), F.col("units_sold")
    on = lambda w, window: F.sum(F.when(today == w, units)).over(window)
    sums = history.select(
        *_PAIR, "date", "units_sold", today.alias("wd"), F.avg(units).over(season).alias("overall"), F.count("*").over(recent).alias("n"),
        F.array(*(F.avg(F.when(today == w, units)).over(season) for w in range(7))).alias("means"), F.array(*(F.coalesce(on(w, recent), F.lit(0.0)) for w in range(7))).alias("recent"),
    )
    index = F.transform("means", lambda m: F.when(F.col("overall") > 0, F.coalesce(m / F.col("overall"), F.lit(1.0))).otherwise(1.0))
    indexed = sums.withColumn("idx", index)
    level = F.aggregate(F.zip_with("recent", "idx", lambda s, i: F.when(i > 0, s / i).otherwise(s)), F.lit(0.0), lambda a, x: a + x)
    ahead = sum((F.element_at("idx", F.pmod(F.col("wd") + k, F.lit(7)) + 1) for k in range(horizon)), F.lit(0.0))
    return indexed.withColumn("level", F.when(F.col("n") > 0, level / F.col("n")).otherwise(0.0)).select(*_PAIR, "date", "level", (F.col("level") * ahead).alias("point"))


def naive_quantiles_at(points: DataFrame, dates: list, horizon: int, quantiles: tuple[float, ...], least: int) -> DataFrame:
    """naive_quantiles() at each of a few dates, as a store of forecasts: (store_id, item_id, as_of, horizon, quantile, value)."""
    each = [naive_quantiles(points, d, horizon, quantiles, least).withColumns({"as_of": F.lit(d), "horizon": F.lit(horizon)}) for d in dates]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.select(*_PAIR, "as_of", "horizon", "quantile", "value")


def look_up(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked (store_id, item_id, as_of, horizon, quantile) with `value` of the store's row of the same key, and `finding` where there is none.

    The finding is the first thing that the store lacks: the pair, the date, the horizon or the quantile. Nothing is taken from
    another date, window or quantile. The quantiles and horizons of a pair and date are few, so they are one row to join.
    """
    at = store.groupBy(*_PAIR, "as_of").agg(F.collect_list(F.struct("horizon", "quantile", "value")).alias("known"))
    pairs = store.select(*_PAIR).distinct().withColumn("pair_known", F.lit(True))
    rows = asked.join(at, [*_PAIR, "as_of"], "left").join(pairs, _PAIR, "left")
    window = F.filter("known", lambda x: x["horizon"] == F.col("horizon"))
    rows = rows.withColumn("window", window).withColumn("hit", F.get(F.filter("window", lambda x: x["quantile"] == F.col("quantile")), F.lit(0)))
    lacks = F.when(F.col("hit").isNotNull(), F.lit(None).cast("string")).when(F.col("pair_known").isNull(), "pair").when(F.col("known").isNull(), "as_of").when(F.size("window") == 0, "horizon").otherwise("quantile")
    return rows.select(*asked.columns, F.col("hit.value").alias("value"), lacks.alias("finding"))


def latest_before(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked (store_id, item_id, date) with the as_of and forecast (array of quantile and value) of the store's last date not after it; null before the first.

    Both are one table ordered by day, so each pair is sorted once and nothing is joined by range.
    """
    known = store.groupBy(*_PAIR, "as_of").agg(F.array_sort(F.collect_list(F.struct("quantile", "value"))).alias("forecast"))
    rows = known.select(*_PAIR, F.col("as_of").alias("date"), F.struct("as_of", "forecast").alias("known"), F.lit(0).alias("asks")).unionByName(asked.select(*_PAIR, "date", F.lit(1).alias("asks")), allowMissingColumns=True)
    past = Window.partitionBy(*_PAIR).orderBy("date", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("last", F.last("known", ignorenulls=True).over(past)).filter("asks = 1").select(*_PAIR, "date", "last.as_of", "last.forecast")


def forecast_findings(store: DataFrame, alpha: float) -> DataFrame:
    """(store_id, item_id, as_of, horizon, finding) of forecasts that no order may use: a window of no days, a quantile that is not between 0 and 1, values that fall as quantiles rise, or alpha not among the quantiles."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1; 1 would ask for the largest value ever seen")
    by = [*_PAIR, "as_of", "horizon"]
    q = store.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("quantile", "value"))).alias("q")).withColumn("v", F.transform("q", lambda x: x["value"]))
    names = F.transform("q", lambda x: x["quantile"])
    falls = F.exists(F.sequence(F.lit(2), F.size("v")), lambda i: F.element_at("v", i) < F.element_at("v", i - 1))
    found = F.array_compact(F.array(
        F.when(F.col("horizon") <= 0, "window"), F.when(F.exists(names, lambda x: (x <= 0) | (x >= 1)), "quantile"),
        F.when((F.size("v") > 1) & F.when(F.size("v") > 1, falls).otherwise(False), "falling"), F.when(~F.array_contains(names, alpha), "alpha"),
    ))
    return q.select(*by, F.explode(found).alias("finding"))


def error_metrics(scored: DataFrame) -> DataFrame:
    """By store, over rows with actual, point, rival and unit_value, less those whose `masked` is true: relative mean absolute
    error, absolute error weighted by value, and bias; null where what divides is 0."""
    rows = scored.filter("actual is not null and point is not null and rival is not null and unit_value is not null")
    if "masked" in scored.columns:
        rows = rows.filter(~F.coalesce("masked", F.lit(False)))
    miss, other, value = F.col("point") - F.col("actual"), F.col("rival") - F.col("actual"), F.col("unit_value")
    nonzero = lambda c: F.when(c != 0, c)
    return rows.groupBy("store_id").agg(
        F.count("*").alias("n"), (F.avg(F.abs(miss)) / nonzero(F.avg(F.abs(other)))).alias("relative_mae"),
        (F.sum(F.abs(miss) * value) / nonzero(F.sum(F.col("actual") * value))).alias("wape"), (F.sum(miss) / nonzero(F.sum("actual"))).alias("bias"),
    )


def demand_classes(history: DataFrame, before, interval: float, variation: float) -> DataFrame:
    """(store_id, item_id, demand_class) from the days before `before` alone: erratic where the units of days with a sale vary much (squared variation), else intermittent where sales are far apart, else regular; none where nothing was sold."""
    known = history.filter(F.col("date") < F.lit(before))
    sold = F.when(F.col("units_sold") > 0, F.col("units_sold"))
    out = known.groupBy(*_PAIR).agg(F.count("*").alias("n"), F.count(sold).alias("k"), F.avg(sold).alias("m"), F.var_pop(sold).alias("v"))
    kind = F.when(F.col("k") == 0, "none").when(F.round(F.col("v") / (F.col("m") * F.col("m")), 9) >= variation, "erratic").when(F.round(F.col("n") / F.col("k"), 9) >= interval, "intermittent").otherwise("regular")
    return out.select(*_PAIR, kind.alias("demand_class"))


def methods_compared(scored: DataFrame, rival: str) -> DataFrame:
    """Per demand class and method, over rows (store_id, item_id, as_of, demand_class, method, point, actual, unit_value, masked) that every method has a point for and that are not masked: absolute error relative to the rival's on the same rows, absolute error weighted by value, bias; null where what divides is 0."""
    rows = scored.filter(~F.coalesce("masked", F.lit(False)) & F.col("actual").isNotNull())
    by = Window.partitionBy(*_PAIR, "as_of")
    whole = rows.withColumns({"lacks": F.count_if(F.col("point").isNull()).over(by), "rival": F.max(F.when(F.col("method") == rival, F.col("point"))).over(by)}).filter("lacks = 0 and rival is not null")
    miss, other, value = F.col("point") - F.col("actual"), F.col("rival") - F.col("actual"), F.col("unit_value")
    return whole.groupBy("demand_class", "method").agg(
        F.count("*").alias("n"), F.try_divide(F.sum(F.abs(miss)), F.sum(F.abs(other))).alias("relative_mae"), F.try_divide(F.sum(F.abs(miss) * value), F.sum(F.col("actual") * value)).alias("wape"), F.try_divide(F.sum(miss), F.sum("actual")).alias("bias"),
    )


def quantile_metrics(scored: DataFrame) -> DataFrame:
    """By store and quantile, over rows with an actual: share at or below the forecast, and pinball loss."""
    e = F.col("actual") - F.col("value")
    return scored.filter("actual is not null").groupBy("store_id", "quantile").agg(F.avg((F.col("actual") <= F.col("value")).cast("double")).alias("coverage"), F.avg(F.greatest(F.col("quantile") * e, (F.col("quantile") - 1) * e)).alias("pinball"))
