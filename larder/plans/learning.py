"""Registered queries of features, the boosted quantile model and stores of forecasts, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, calendar, features, forecast
from ..params import PARAMS as P
from ..sources import results
from ..sources.canonical import fingerprint, params_key
from ..sources.intermediate import shared_dir, written
from ..sources.retail import kept_sales, raw_items, raw_sales
from .replenishment import _WEEKLY, _WEEKLY_Q, ORACLE_SQL, _asked, _payday_sql, _weekly_quantiles
from .retail import _POINTS, _panel, _query, _rounded

_PAIR = ["store_id", "item_id"]
_DATES = ", ".join(f"(date '{d}')" for d in P.feature_dates)
_WIN = {w: f"p.date between a.as_of - {w} and a.as_of - 1" for w in P.feature_windows}


def _calendar(asked: DataFrame) -> DataFrame:
    d = F.col("date")
    return asked.select("store_id", F.col("as_of").alias("date")).distinct().select("store_id", "date", calendar.iso_weekday(d).alias("iso_weekday"), calendar.days_to_payday(d, P.paydays).alias("days_to_payday"))


def _items(sales: DataFrame) -> DataFrame:
    return raw_items(sales).select(F.col("item_nbr").cast("string").alias("item_id"), F.col("family").alias("category"), F.col("class").alias("item_class"), (F.col("perishable") == 1).alias("is_perishable"))


@_query(
    "x5_feature_rows",
    f"""dates(as_of) as (values {_DATES}), asked as (select store_id, item_id, as_of from (select distinct cast(store_nbr as varchar) store_id, cast(item_nbr as varchar) item_id from raw) cross join dates),
f as (select a.*, {', '.join(f"max(case when p.date = a.as_of - {k} then units_sold end) lag_units_{k}" for k in P.lags)}, avg(case when {_WIN[14]} then units_sold end) rolling_mean_units_14d, avg(case when {_WIN[28]} then units_sold end) rolling_mean_units_28d,
  sum(case when {_WIN[28]} then units_sold end) rolling_sum_units_28d, avg(case when {_WIN[28]} then cast(units_sold > 0 as double) end) share_days_with_sale_28d, avg(case when {_WIN[28]} then cast(coalesce(on_promo, false) as double) end) promo_share_28d,
  avg(case when {_WIN[28]} then cast(on_promo is not null as double) end) promo_known_share_28d, a.as_of - max(case when units_sold > 0 then date end) days_since_last_sale, a.as_of - max(case when on_promo then date end) days_since_last_promo
  from asked a left join panel p on p.store_id = a.store_id and p.item_id = a.item_id and p.date < a.as_of group by a.store_id, a.item_id, a.as_of)
select store_id, item_id, as_of, {', '.join(f'lag_units_{k}' for k in P.lags)}, round(rolling_mean_units_14d, 9) rolling_mean_units_14d, round(rolling_mean_units_28d, 9) rolling_mean_units_28d, round(rolling_sum_units_28d, 4) rolling_sum_units_28d, round(share_days_with_sale_28d, 9) share_days_with_sale_28d,
  round(promo_share_28d, 9) promo_share_28d, round(promo_known_share_28d, 9) promo_known_share_28d, days_since_last_sale, days_since_last_promo, family category, class item_class, perishable = 1 is_perishable, cast(isodow(as_of) as integer) iso_weekday,
  cast(least({', '.join(_payday_sql(m, s).replace('date ', 'as_of ').replace("('month', date)", "('month', as_of)").replace('- date', '- as_of') for m in (0, 1) for s in P.paydays)}) as integer) days_to_payday
from f join items on cast(item_nbr as varchar) = item_id""",
)
def x5(spark, sf_dir):
    """Every pair that was ever sold, also before its first day in the panel."""
    sales = kept_sales(spark, sf_dir)
    pairs = sales.select(F.col("store_nbr").cast("string").alias("store_id"), F.col("item_nbr").cast("string").alias("item_id")).distinct()
    asked = features.at_dates(pairs, F.array(*(F.lit(d) for d in P.feature_dates)))
    rows = features.feature_rows(_panel(spark, sf_dir, sales), asked, _items(sales), _calendar(asked), P.lags, P.feature_windows, P.active_features)
    rows = _rounded(rows, *(c for c in rows.columns if "mean" in c or "share" in c), places=9)
    return _rounded(rows, "rolling_sum_units_28d", places=4)


#: What the model learns from: the active features as numbers, and the days of the window.
_SEEN = P.active_features + P.learned_features
_LEARNED = tuple("category_code" if c == "category" else c for c in _SEEN) + ("horizon",)
_HOW = boosting.Boosting(P.quantiles, P.boost_rounds, P.boost_depth, P.boost_rate, P.boost_bins, P.boost_least_rows)


def _learning_rows(items: DataFrame, history: DataFrame, asked: DataFrame) -> DataFrame:
    rows = features.feature_rows(history, asked.drop("horizon"), items, _calendar(asked), P.lags, P.learned_windows, _SEEN)
    coded = rows.join(features.category_codes(items, "category").withColumnRenamed("code", "category_code"), "category", "left").join(asked, [*_PAIR, "as_of"])
    return coded.withColumn("is_perishable", F.col("is_perishable").cast("int"))


def _trees(spark: SparkSession, items: DataFrame, history: DataFrame) -> DataFrame:
    """The model's trees: trained once for the same sales and parameters, then read."""
    key = {"params": params_key(P), "how": _HOW, "learned": _LEARNED, "history": fingerprint(history)}

    def make() -> DataFrame:
        asked = written(_asked(spark, history))
        usable = features.usable_origins(asked, spark.createDataFrame([(d,) for d in P.retrains], "retrain date"), P.least_origins)
        rows = _learning_rows(items, history, asked).join(features.window_targets(history, asked).drop("horizon"), [*_PAIR, "as_of"])
        panel = written(usable.drop("horizon").join(rows, [*_PAIR, "as_of"]))
        return boosting.train(panel.withColumn("weight", F.pow(F.lit(0.5), F.col("age") / P.half_life)), "retrain", _LEARNED, "target", "weight", _HOW)

    return results.load_or_make(spark, f"{shared_dir(spark)}/quantile-model-{params_key(key)}", key, make)


def _decisions(history: DataFrame) -> DataFrame:
    """Every pair at every decision date from the first retraining on, with its horizon."""
    dates = F.sequence(F.lit(P.retrains[0]), F.lit(P.evaluation_end), F.expr(f"interval {P.evaluation_days} days"))
    return features.at_dates(history.select(*_PAIR).distinct(), dates).withColumn("horizon", F.lit(P.horizon))


def _grid(spark: SparkSession, items: DataFrame, history: DataFrame) -> DataFrame:
    """(store_id, item_id, as_of, horizon, quantile, value): the forecasts of each decision by the latest model, in order and not below 0."""
    asked = _decisions(history)
    rows = forecast.as_of_retrain(_learning_rows(items, history, asked), P.retrains, "as_of")
    made = boosting.predict(rows, "retrain", _trees(spark, items, history), _LEARNED, P.boost_depth, P.quantiles)
    ordered = F.array_sort(F.transform("forecast", lambda x: x["value"]))
    long = made.select(*_PAIR, "as_of", "horizon", F.posexplode(ordered).alias("k", "v"))
    return long.select(*_PAIR, "as_of", "horizon", F.element_at(F.array(*map(F.lit, P.quantiles)), F.col("k") + 1).alias("quantile"), F.greatest(F.col("v"), F.lit(0.0)).alias("value"))


@_query("m10_quantile_model")
def m10(spark, sf_dir):
    """Pinball loss and coverage of the boosted model by quantile at the decision dates, beside those of the naive quantiles on the same rows."""
    sales = kept_sales(spark, sf_dir)
    history = written(_panel(spark, sf_dir, sales))
    dates = [P.retrains[0] + timedelta(k) for k in range(0, (P.evaluation_end - P.retrains[0]).days + 1, P.evaluation_days)]
    points = written(forecast.naive_points(history, P.naive_weeks, P.horizon))
    naive = forecast.naive_quantiles_at(points, dates, P.horizon, P.quantiles, P.min_residuals).withColumnRenamed("value", "naive")
    actual = features.window_targets(history, _decisions(history))
    rows = _grid(spark, _items(sales), history).join(naive, [*_PAIR, "as_of", "horizon", "quantile"]).join(actual, [*_PAIR, "as_of", "horizon"])
    loss = lambda c: F.avg(F.greatest(F.col("quantile") * (F.col("target") - F.col(c)), (F.col("quantile") - 1) * (F.col("target") - F.col(c))))
    return rows.groupBy("quantile").agg(F.count("*").alias("n"), F.round(loss("value"), 6).alias("pinball"), F.round(loss("naive"), 6).alias("naive_pinball"), F.round(F.avg((F.col("target") <= F.col("value")).cast("double")), 6).alias("coverage"))


@_query("m13_prediction_grid")
def m13(spark, sf_dir):
    sales = kept_sales(spark, sf_dir)
    return _rounded(_grid(spark, _items(sales), written(_panel(spark, sf_dir, sales))), "value")


_STORE = f"""qs(quantile) as (values {', '.join(f"(cast({q} as double))" for q in P.quantiles)}), retrains(as_of) as (values {', '.join(f"(date '{d}')" for d in P.retrains)}),
res as (select store_id, item_id, as_of, quantile, count(residual) n, quantile_cont(residual, {P.quantiles[0]}) a, quantile_cont(residual, {P.quantiles[1]}) b, quantile_cont(residual, {P.quantiles[2]}) c from pts cross join retrains cross join qs where date <= as_of - {P.horizon} group by all),
store as (select p.store_id, p.item_id, t.as_of, {P.horizon} horizon, qs.quantile, case when coalesce(n, 0) >= {P.min_residuals} then greatest(0, point + case qs.quantile when {P.quantiles[0]} then a when {P.quantiles[1]} then b else c end) else point end "value"
  from pts p join retrains t on p.date = t.as_of cross join qs left join res on res.store_id = p.store_id and res.item_id = p.item_id and res.as_of = t.as_of and res.quantile = qs.quantile)"""


def _naive_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive forecasts at the retraining dates, written: both sides of a look-up read them."""
    points = written(forecast.naive_points(_panel(spark, sf_dir), P.naive_weeks, P.horizon))
    return written(forecast.naive_quantiles_at(points, list(P.retrains), P.horizon, P.quantiles, P.min_residuals))


@_query(
    "m14_forecast_look_up",
    f"""{_POINTS}, {_STORE}, ask as (select cast(store_nbr as varchar) store_id, cast(item_nbr as varchar) item_id, as_of, case when item_nbr % 5 = 1 then {P.horizon + 2} else {P.horizon} end horizon, case when item_nbr % 5 = 2 then 0.8 else cast({P.quantiles[-1]} as double) end quantile
  from (select distinct store_nbr, item_nbr from raw) cross join (select as_of from retrains union all select date '{P.retrains[0] + timedelta(1)}') union all select '0', '0', date '{P.as_of}', {P.horizon}, {P.quantiles[0]})
select a.store_id, a.item_id, a.as_of, a.horizon, a.quantile, round(s."value", 6) "value", case when s."value" is not null then null when not exists (select 1 from store x where x.store_id = a.store_id and x.item_id = a.item_id) then 'pair'
  when not exists (select 1 from store x where x.store_id = a.store_id and x.item_id = a.item_id and x.as_of = a.as_of) then 'as_of' when a.horizon <> {P.horizon} then 'horizon' else 'quantile' end finding
from ask a left join store s on s.store_id = a.store_id and s.item_id = a.item_id and s.as_of = a.as_of and s.horizon = a.horizon and s.quantile = a.quantile""",
)
def m14(spark, sf_dir):
    """Requests for known forecasts, for a date between two, for longer windows, for a quantile off the grid, and of a pair that is unknown."""
    pairs = raw_sales(spark, sf_dir).select(F.col("store_nbr").cast("string").alias("store_id"), F.col("item_nbr").cast("string").alias("item_id")).distinct()
    asked = features.at_dates(pairs, F.array(*(F.lit(d) for d in (*P.retrains, P.retrains[0] + timedelta(1)))))
    kind = F.col("item_id").cast("long") % 5
    asked = asked.withColumns({"horizon": F.when(kind == 1, P.horizon + 2).otherwise(P.horizon), "quantile": F.when(kind == 2, 0.8).otherwise(P.quantiles[-1])})
    stranger = spark.createDataFrame([("0", "0", P.as_of, P.horizon, P.quantiles[0])], asked.schema)
    return _rounded(forecast.look_up(asked.unionByName(stranger), _naive_store(spark, sf_dir)), "value")


@_query(
    "m12_latest_forecast",
    f"""{_POINTS}, {_STORE}, d as (select store_id, item_id, p.date, (select max(as_of) from retrains where as_of <= p.date) last from panel p)
select d.store_id, d.item_id, d.date, s.as_of, round(s."value", 6) "value" from d left join store s on s.store_id = d.store_id and s.item_id = d.item_id and s.quantile = {P.quantiles[1]}
  and s.as_of = (select max(x.as_of) from retrains x where x.as_of <= d.date and exists (select 1 from pts y where y.store_id = d.store_id and y.item_id = d.item_id and y.date = x.as_of))""",
)
def m12_latest(spark, sf_dir):
    """Each day of the panel with the median of the pair's latest forecast."""
    found = forecast.latest_before(_panel(spark, sf_dir).select(*_PAIR, "date"), _naive_store(spark, sf_dir))
    return found.select(*_PAIR, "date", "as_of", F.round(F.element_at("forecast", 2)["value"], 6).alias("value"))


@_query(
    "l3_forecast_findings",
    f"""{_POINTS}, {_WEEKLY}, {_WEEKLY_Q}, quant as ({ORACLE_SQL['m4_naive_quantiles']}),
mixed as (select store_id, item_id, case when cast(item_id as bigint) % 4 = 0 and quantile = {P.quantiles[-1]} then 0.95 else quantile end quantile, round(case when quantile = {P.quantiles[1]} then v else "value" end, 6) v from quant join wq using (store_id, item_id, quantile)),
f as (select *, v < lag(v) over (partition by store_id, item_id order by quantile) falls from mixed), g as (select store_id, item_id, bool_or(coalesce(falls, false)) falls, bool_or(quantile = {P.ask_alpha}) has from f group by 1, 2)
select store_id, item_id, date '{P.as_of}' as_of, {P.horizon} horizon, 'falling' finding from g where falls union all select store_id, item_id, date '{P.as_of}', {P.horizon}, 'alpha' from g where not has""",
)
def l3(spark, sf_dir):
    """Quantiles of two fits, some of another grid: those that no order at the asked quantile may use."""
    naive = forecast.naive_quantiles(written(forecast.naive_points(_panel(spark, sf_dir), P.naive_weeks, P.horizon)), P.as_of, P.horizon, P.quantiles, P.min_residuals)
    both = naive.join(_weekly_quantiles(spark, sf_dir).withColumnRenamed("value", "other"), [*_PAIR, "quantile"])
    value = F.round(F.when(F.col("quantile") == P.quantiles[1], F.col("other")).otherwise(F.round("value", 9)), 6)
    off = (F.col("item_id").cast("long") % 4 == 0) & (F.col("quantile") == P.quantiles[-1])
    mixed = both.select(*_PAIR, F.lit(P.as_of).alias("as_of"), F.lit(P.horizon).alias("horizon"), F.when(off, 0.95).otherwise(F.col("quantile")).alias("quantile"), value.alias("value"))
    return forecast.forecast_findings(mixed, P.ask_alpha)
