"""Registered queries of calendars, training data, seasonal forecasts, orders and ledgers, with DuckDB SQL for the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_up_to_pack
from ..operators import calendar, features, forecast, ledger, ordering
from ..params import PARAMS as P
from ..sources.intermediate import written
from ..sources.retail import raw_items, raw_sales
from .retail import _BASE, _MARGIN, _POINTS, ORACLE_SQL, QUERIES, _panel, _query, _rounded

_ORIGINS = f"origins as (select cast(unnest(generate_series(date '{P.window_start}' + 28, date '{P.as_of}', interval 7 day)) as date) date)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("date").distinct()


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.naive_points(_panel(spark, sf_dir), P.naive_weeks, P.horizon)


def _payday_sql(month: int, spec: int) -> str:
    first = f"cast(date_trunc('month', date) + interval {month} month as date)"
    at = f"last_day({first})" if spec == -1 else f"least({first} + {spec - 1}, last_day({first}))"
    return f"case when {at} >= date then {at} - date end"


@_query(
    "k3_day_features",
    f"select date, cast(isodow(date) as integer) iso_weekday, day(date) = 1 is_month_start, day(date) > 15 is_second_half, cast(least({', '.join(_payday_sql(m, s) for m in (0, 1) for s in P.paydays)}) as integer) days_to_payday from (select distinct date from panel)",
)
def k3(spark, sf_dir):
    d = F.col("date")
    return _days(spark, sf_dir).select("date", calendar.iso_weekday(d).alias("iso_weekday"), (F.dayofmonth(d) == 1).alias("is_month_start"), (F.dayofmonth(d) > 15).alias("is_second_half"), calendar.days_to_payday(d, P.paydays).alias("days_to_payday"))


@_query("k4_review_days", f"select date, (date - date '{P.window_start}') % {P.review_days} = 0 on_grid, isodow(date) in {P.order_days} on_weekday from (select distinct date from panel)")
def k4(spark, sf_dir):
    d = F.col("date")
    return _days(spark, sf_dir).select("date", calendar.every_n_days(d, P.window_start, P.review_days).alias("on_grid"), calendar.iso_weekday(d).isin(*P.order_days).alias("on_weekday"))


@_query("k6_next_order_day", f"select p.date, min(p.date + cast(k as integer)) next_day from (select distinct date from panel) p, generate_series(1, 7) t(k) where isodow(p.date + cast(k as integer)) in {P.order_days} group by 1")
def k6(spark, sf_dir):
    return _days(spark, sf_dir).select("date", calendar.next_order_day(F.col("date"), P.order_days).alias("next_day"))


_ASKED = f"""{_ORIGINS}, asked as (select store_id, item_id, date as_of from (select distinct cast(store_nbr as varchar) store_id, cast(item_nbr as varchar) item_id from lives) cross join origins),
targets as (select a.store_id, a.item_id, a.as_of, coalesce(sum(units_sold), 0) target from asked a left join panel p on p.store_id = a.store_id and p.item_id = a.item_id and p.date between a.as_of and a.as_of + {P.horizon - 1} group by all)"""


def _asked(spark: SparkSession, history: DataFrame) -> DataFrame:
    """Every pair of the panel at every origin, with its horizon."""
    dates = F.sequence(F.date_add(F.lit(P.window_start), 28), F.lit(P.as_of), F.expr(f"interval {P.origin_days} days"))
    return features.at_dates(history.select("store_id", "item_id").distinct(), dates).withColumn("horizon", F.lit(P.horizon))


@_query("k7_x8_window_demand", f"{_ASKED} select store_id, item_id, as_of as origin, as_of + {P.horizon - 1} last_day, round(target, 4) target from targets")
def x8(spark, sf_dir):
    history = _panel(spark, sf_dir)
    found = features.window_targets(history, _asked(spark, history))
    return found.select("store_id", "item_id", F.col("as_of").alias("origin"), F.date_add("as_of", P.horizon - 1).alias("last_day"), F.round("target", 4).alias("target"))


def _origins(spark: SparkSession) -> DataFrame:
    """K5: the weekly grid of origins, a few rows of parameters."""
    return spark.range(1).select(F.explode(F.sequence(F.date_add(F.lit(P.window_start), 28), F.lit(P.as_of), F.expr("interval 7 days"))).alias("origin"))


@_query("x9_category_codes", "select item_nbr, family, cast(dense_rank() over (order by family) - 1 as integer) code from items")
def x9(spark, sf_dir):
    items = raw_items(raw_sales(spark, sf_dir)).select("item_nbr", "family")
    # one row per family: far fewer than items
    codes = items.select("family").distinct().selectExpr("family", "row_number() over (order by family) - 1 as code")
    return items.join(codes, "family").select("item_nbr", "family", "code")


_RETRAINS = f"retrains(retrain) as (values {', '.join(f"(date '{d}')" for d in P.retrains)})"


@_query(
    "x12_training_panel",
    f"""{_ASKED}, {_RETRAINS}
select store_id, item_id, as_of, retrain, round(avg(units_sold), 9) "mean", round(avg(cast(units_sold > 0 as double)), 9) sale_share, round(any_value(target), 4) target, cast(retrain - as_of as bigint) age, round(pow(0.5, (retrain - as_of) / {P.half_life}), 9) weight
from targets t join retrains on as_of + {P.horizon} <= retrain left join panel p using (store_id, item_id) where p.date between as_of - 28 and as_of - 1 group by all
union all by name select store_id, item_id, as_of, retrain, round(target, 4) target, cast(retrain - as_of as bigint) age, round(pow(0.5, (retrain - as_of) / {P.half_life}), 9) weight
from targets t join retrains on as_of + {P.horizon} <= retrain where not exists (select 1 from panel p where p.store_id = t.store_id and p.item_id = t.item_id and p.date between as_of - 28 and as_of - 1)""",
)
def x12(spark, sf_dir):
    history = written(_panel(spark, sf_dir))
    asked = written(_asked(spark, history))
    usable = features.usable_origins(asked, spark.createDataFrame([(d,) for d in P.retrains], "retrain date"), P.least_origins)
    rows = features.history_features(history, asked.drop("horizon"), (), (28,))
    rows = rows.select("store_id", "item_id", "as_of", F.col("rolling_mean_units_28d").alias("mean"), F.col("share_days_with_sale_28d").alias("sale_share"))
    key = ["store_id", "item_id", "as_of"]
    panel = usable.drop("horizon").join(rows, key).join(features.window_targets(history, asked).drop("horizon"), key)
    out = panel.withColumn("weight", F.pow(F.lit(0.5), F.col("age") / P.half_life))
    return _rounded(_rounded(out, "mean", "sale_share", "weight", places=9), "target", places=4)


_S, _L = ("partition by store_id, item_id order by date range between interval {} day preceding and interval 1 day preceding".format(7 * w) for w in (P.season_weeks, P.level_weeks))
_WEEKLY = (
    "sums as (select store_id, item_id, date, isodow(date) - 1 wd, avg(units_sold) over s overall, count(*) over l n, "
    + ", ".join(f"avg(case when isodow(date) = {w + 1} then units_sold end) over s m{w}, coalesce(sum(case when isodow(date) = {w + 1} then units_sold end) over l, 0) r{w}" for w in range(7))
    + f" from panel window s as ({_S}), l as ({_L})), idx as (select *, "
    + ", ".join(f"case when overall > 0 then coalesce(m{w} / overall, 1) else 1.0 end i{w}" for w in range(7))
    + " from sums), weekly0 as (select *, case when n > 0 then ("
    + " + ".join(f"case when i{w} > 0 then r{w} / i{w} else r{w} end" for w in range(7))
    + ") / n else 0.0 end as lvl, list_value("
    + ", ".join(f"i{w}" for w in range(7))
    + ") ix from idx), weekly as (select store_id, item_id, date, lvl, lvl * ("
    + " + ".join(f"ix[(wd + {k}) % 7 + 1]" for k in range(P.horizon))
    + ") point from weekly0)"
)


@_query("m7_weekly_points", f'{_WEEKLY} select store_id, item_id, date, round(lvl, 9) "level", round(point, 9) point from weekly')
def m7(spark, sf_dir):
    return _rounded(forecast.weekly_points(_panel(spark, sf_dir), P.season_weeks, P.level_weeks, P.horizon), "level", "point", places=9)


_RIVAL = f"""rivals as (select store_id, item_id, date, case when count(*) over w = {P.horizon} then sum(units_sold) over w end rival from panel
  window w as (partition by store_id, item_id order by date range between interval 7 day preceding and interval {8 - P.horizon} day preceding))"""


@_query(
    "q2_q4_error_metrics",
    f"""{_POINTS}, {_WEEKLY}, {_ORIGINS}, {_RIVAL}, e as (select q.store_id, actual, w.point point, rival, cast(5 + cast(item_id as bigint) % 10 as double) v from pts0 q join rivals using (store_id, item_id, date) join weekly w using (store_id, item_id, date) join origins using (date) where n_ahead = {P.horizon} and rival is not null)
select store_id, count(*) n, round(avg(abs(point - actual)) / nullif(avg(abs(rival - actual)), 0), 6) relative_mae, round(sum(abs(point - actual) * v) / nullif(sum(actual * v), 0), 6) wape, round(sum(point - actual) / nullif(sum(actual), 0), 6) bias from e group by 1""",
)
def q24(spark, sf_dir):
    key, history = ["store_id", "item_id", "date"], written(_panel(spark, sf_dir))
    actual = forecast.naive_points(history, P.naive_weeks, P.horizon).join(_origins(spark), F.col("date") == F.col("origin")).select(*key, "actual", (5 + F.col("item_id").cast("long") % 10).cast("double").alias("unit_value"))
    weekly = forecast.weekly_points(history, P.season_weeks, P.level_weeks, P.horizon).select(*key, "point")
    return _rounded(forecast.error_metrics(actual.join(weekly, key).join(forecast.seasonal_rival(history, P.horizon), key)), "relative_mae", "wape", "bias")


_WEEKLY_Q = f"""wres as (select w.store_id, w.item_id, date, w.point, case when n_ahead = {P.horizon} and n_past > 0 then actual - w.point end residual from weekly w join pts0 using (store_id, item_id, date)),
wr as (select store_id, item_id, quantile, count(residual) n, quantile_cont(residual, {P.quantiles[0]}) a, quantile_cont(residual, {P.quantiles[1]}) b, quantile_cont(residual, {P.quantiles[2]}) c from wres, (values {', '.join(f"(cast({q} as double))" for q in P.quantiles)}) qs(quantile) where date <= date '{P.as_of}' - {P.horizon} group by all),
wq as (select d.store_id, d.item_id, qs.quantile, case when coalesce(n, 0) >= {P.min_residuals} then greatest(0, point + case qs.quantile when {P.quantiles[0]} then a when {P.quantiles[1]} then b else c end) else point end v
  from (select * from wres where date = date '{P.as_of}') d cross join (values {', '.join(f"(cast({q} as double))" for q in P.quantiles)}) qs(quantile) left join wr on wr.store_id = d.store_id and wr.item_id = d.item_id and wr.quantile = qs.quantile)"""


def _weekly_quantiles(spark: SparkSession, sf_dir: str, history: DataFrame | None = None) -> DataFrame:
    key = ["store_id", "item_id", "date"]
    history = written(_panel(spark, sf_dir)) if history is None else history
    # the index of every day comes from what lies before it, so each residual is one of a fit of its own
    points = forecast.weekly_points(history, P.season_weeks, P.level_weeks, P.horizon).select(*key, "point")
    known = forecast.naive_points(history, P.naive_weeks, P.horizon).select(*key, "actual", F.col("residual").isNotNull().alias("whole"))
    residuals = points.join(known, key).withColumn("residual", F.when(F.col("whole"), F.col("actual") - F.col("point")))
    return forecast.naive_quantiles(written(residuals), P.as_of, P.horizon, P.quantiles, P.min_residuals)


@_query("m8_weekly_quantiles", f'{_POINTS}, {_WEEKLY}, {_WEEKLY_Q} select store_id, item_id, quantile, round(v, 6) "value" from wq')
def m8(spark, sf_dir):
    return _rounded(_weekly_quantiles(spark, sf_dir), "value")


@_query("m12_as_of_retrain", "select date, (select max(r) from (values " + ", ".join(f"(date '{d}')" for d in P.retrains) + ") t(r) where r <= date) retrain from (select distinct date from win) d")
def m12(spark, sf_dir):
    from .retail import c3

    return forecast.as_of_retrain(c3(spark, sf_dir).select("date").distinct(), P.retrains)


_QUANTILES = f"quant as ({ORACLE_SQL['m4_naive_quantiles']})"


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .retail import m4

    return m4(spark, sf_dir)


@_query(
    "m11_non_crossing",
    f"""{_POINTS}, {_WEEKLY}, {_WEEKLY_Q}, {_QUANTILES}, mixed as (select store_id, item_id, quantile, round(case when quantile = {P.quantiles[1]} then v else "value" end, 6) v from quant join wq using (store_id, item_id, quantile)),
o as (select *, row_number() over (partition by store_id, item_id order by v) k, row_number() over (partition by store_id, item_id order by quantile) kq from mixed)
select a.store_id, a.item_id, a.quantile, b.v "value", bool_or(a.v <> b.v) over (partition by a.store_id, a.item_id) crossed from o a join o b on a.store_id = b.store_id and a.item_id = b.item_id and a.kq = b.k""",
)
def m11(spark, sf_dir):
    """Outer quantiles of the naive forecast about the weekly one's median: values from two fits, which may cross."""
    key = ["store_id", "item_id", "quantile"]
    history = written(_panel(spark, sf_dir))
    naive = forecast.naive_quantiles(written(forecast.naive_points(history, P.naive_weeks, P.horizon)), P.as_of, P.horizon, P.quantiles, P.min_residuals)
    both = _rounded(naive, "value", places=9).join(_weekly_quantiles(spark, sf_dir, history).withColumnRenamed("value", "other"), key)
    return forecast.non_crossing(both.select(*key, F.round(F.when(F.col("quantile") == P.quantiles[1], F.col("other")).otherwise(F.col("value")), 6).alias("value")))


@_query(
    "q5_q6_quantile_metrics",
    f"""{_POINTS}, {_QUANTILES}, e as (select store_id, quantile, "value" v, actual from quant join pts0 using (store_id, item_id) where date = date '{P.as_of}' and n_ahead = {P.horizon})
select store_id, quantile, round(avg(cast(actual <= v as double)), 6) coverage, round(avg(greatest(quantile * (actual - v), (quantile - 1) * (actual - v))), 6) pinball from e group by 1, 2""",
)
def q56(spark, sf_dir):
    actual = _points(spark, sf_dir).filter(F.col("date") == F.lit(P.as_of)).select("store_id", "item_id", "actual")
    return _rounded(forecast.quantile_metrics(_quantiles(spark, sf_dir).join(actual, ["store_id", "item_id"])), "coverage", "pinball")


_NEED = f"pos as (select store_id, item_id, daily_mean daily, cast((cast(item_id as bigint) * 13 + cast(store_id as bigint) * 7) % 20 as double) \"position\", round(\"value\", 6) lvl from pts join quant using (store_id, item_id) where date = date '{P.as_of}' and quantile = {P.quantiles[-1]})"


def _needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair at as_of: trailing daily demand, position (made from its numbers: the tables hold no stock) and target level. Points are written once for both."""
    item, store = F.col("item_id").cast("long"), F.col("store_id").cast("long")
    points = written(_points(spark, sf_dir))
    level = forecast.naive_quantiles(points, P.as_of, P.horizon, P.quantiles, P.min_residuals).filter(F.col("quantile") == P.quantiles[-1]).select("store_id", "item_id", F.round(F.round("value", 9), 6).alias("level"))
    daily = points.filter(F.col("date") == F.lit(P.as_of)).select("store_id", "item_id", F.col("daily_mean").alias("daily"))
    return written(daily.join(level, ["store_id", "item_id"]).withColumn("position", ((item * 13 + store * 7) % 20).cast("double")))


@_query(
    "l1_l2_orders",
    f"""{_POINTS}, {_QUANTILES}, {_NEED}
select store_id, item_id, round(case when daily * 28 * {P.erp_factor} - "position" > 0 then greatest(daily * 28 * {P.erp_factor} - "position", {P.erp_least}) else 0 end, 6) erp_order, round(greatest(lvl - "position", 0), 6) target_order, round(greatest("position" - lvl, 0), 6) surplus from pos""",
)
def l12(spark, sf_dir):
    order, surplus = ordering.target_order(F.col("level"), F.col("position"))
    return _needs(spark, sf_dir).select("store_id", "item_id", F.round(ordering.erp_order(F.col("daily"), F.col("position"), 28, P.erp_factor, P.erp_least), 6).alias("erp_order"), F.round(order, 6).alias("target_order"), F.round(surplus, 6).alias("surplus"))


_CAPPED = f"""want as (select *, greatest(lvl - "position", 0) q, cast(2 + cast(item_id as bigint) % 10 as double) shelf from pos),
caps as (select *, greatest(0, greatest(shelf, {P.horizon}) * daily - "position") most from want),
capped as (select *, daily > 0 and q > 0 and q > most cut, daily > 0 and q > 0 and shelf < {P.horizon} and q > greatest(0, shelf * daily - "position") conflict, round(case when daily > 0 and q > 0 and q > most then most else q end, 6) quantity from caps)"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = (2 + F.col("item_id").cast("long") % 10).cast("double")
    order, _ = ordering.target_order(F.col("level"), F.col("position"))
    quantity, cut, conflict = ordering.coverage_cap(order, shelf, P.horizon, F.col("daily"), F.col("position"))
    return _needs(spark, sf_dir).select("*", F.round(quantity, 6).alias("quantity"), cut.alias("cut"), conflict.alias("conflict"))


@_query("y1_coverage_cap", f"{_POINTS}, {_QUANTILES}, {_NEED}, {_CAPPED} select store_id, item_id, quantity, cut, conflict from capped")
def y1(spark, sf_dir):
    return _capped(spark, sf_dir).select("store_id", "item_id", "quantity", "cut", "conflict")


@_query(
    "y3_y4_new_items",
    f"""{_POINTS}, {_QUANTILES}, {_NEED}, {_CAPPED},
fresh as (select store_id, item_id, coalesce(date '{P.as_of}' - min(case when units_sold > 0 then date end) < {P.new_history_days}, true) or count(*) filter (where units_sold > 0) < {P.new_sale_days} is_new from panel where date < date '{P.as_of}' group by 1, 2),
d as (select store_id, item_id, 'FAMILY ' || cast(cast(item_id as bigint) % 6 as varchar) category, quantity, is_new from capped join fresh using (store_id, item_id))
select d.store_id, d.item_id, d.is_new, round(case when is_new then coalesce(c.m, s.m, 0) else quantity end, 6) quantity from d
left join (select store_id, category, median(quantity) m from d where not is_new group by 1, 2) c on c.store_id = d.store_id and c.category = d.category left join (select store_id, median(quantity) m from d where not is_new group by 1) s on s.store_id = d.store_id""",
)
def y34(spark, sf_dir):
    new = ordering.new_items(_panel(spark, sf_dir), P.as_of, P.new_history_days, P.new_sale_days)
    category = F.concat(F.lit("FAMILY "), (F.col("item_id").cast("long") % 6).cast("string"))
    decisions = _capped(spark, sf_dir).join(new, ["store_id", "item_id"]).select("store_id", "item_id", category.alias("category"), "quantity", "is_new")
    return _rounded(ordering.new_item_quantity(decisions).select("store_id", "item_id", "is_new", "quantity"), "quantity")


@_query(
    "g3_g5_supplier_minimum",
    f"""{_POINTS}, {_QUANTILES}, {_NEED}, {_CAPPED},
o as (select store_id, 'SUP-' || cast(cast(item_id as bigint) % 6 as varchar) supplier_id, item_id, daily, "position", cast(1 + cast(item_id as bigint) % 3 as double) pack, cast(8 + cast(item_id as bigint) % 5 as double) unit_cost,
  case when quantity <= 0 then 0.0 else ceil(round(quantity / (1 + cast(item_id as bigint) % 3), 9)) * (1 + cast(item_id as bigint) % 3) end quantity from capped),
t as (select store_id, supplier_id, sum(quantity * unit_cost) v, sum(quantity) u from o group by 1, 2),
tt as (select *, v >= {P.least_value} and u >= {P.least_units} met0 from t),
pk as (select o.*, v, u, k, ("position" + quantity + k * pack) / daily covered from o join tt using (store_id, supplier_id), generate_series(0, {P.most_packs - 1}) g(k) where not met0 and daily > 0),
r as (select store_id, supplier_id, item_id, row_number() over w rk, v + sum(pack * unit_cost) over w >= {P.least_value} and u + sum(pack) over w >= {P.least_units} met from pk window w as (partition by store_id, supplier_id order by covered, item_id, k rows unbounded preceding)),
f as (select store_id, supplier_id, min(rk) first from r where met and rk <= {P.most_packs} group by 1, 2),
a as (select store_id, supplier_id, item_id, count(*) n from r join f using (store_id, supplier_id) where rk <= first group by 1, 2, 3)
select store_id, supplier_id, item_id, case when met0 then 'placed' when first is not null then 'filled' else 'deferred' end outcome, case when met0 or first is not null then quantity + coalesce(n, 0) * pack else 0.0 end "order"
from o join tt using (store_id, supplier_id) left join f using (store_id, supplier_id) left join a using (store_id, supplier_id, item_id)""",
)
def g35(spark, sf_dir):
    item = F.col("item_id").cast("long")
    pack = (1 + item % 3).cast("double")
    orders = _capped(spark, sf_dir).select(
        "store_id", F.concat(F.lit("SUP-"), (item % 6).cast("string")).alias("supplier_id"), "item_id", "daily", "position", pack.alias("pack"), (8 + item % 5).cast("double").alias("unit_cost"),
        round_up_to_pack(F.col("quantity"), pack).alias("quantity"),
    )
    return ordering.fill_to_minimum(written(orders), P.least_value, P.least_units, P.most_packs).select("store_id", "supplier_id", "item_id", "outcome", "order")


_START = f"date '{P.window_start}' + {P.warm_up_days}"
_LEDGER = f"""with {_BASE},
lines as (select cast(n_regionkey + 1 as varchar) store_id, cast(cast(substr(p_brand, 7) as bigint) as varchar) item_id, cast(l_shipdate as date) shipped, cast(o_orderdate as date) ordered, cast(l_quantity as double) q, l_returnflag f
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey left join orders on o_orderkey = l_orderkey),
moves as (select store_id, item_id, shipped date, sum(q) demand, sum(case when f = 'A' then q else 0 end) unmet, sum(case when f = 'R' then q else 0 end) expired from lines group by 1, 2, 3),
placed as (select store_id, item_id, ordered date, sum(q) "order" from lines where ordered is not null group by 1, 2, 3),
led0 as (select store_id, item_id, date, coalesce(demand, 0) demand, coalesce(unmet, 0) unmet, coalesce(expired, 0) expired, "order" from panel left join moves using (store_id, item_id, date) left join placed using (store_id, item_id, date)),
ledger as (select store_id, item_id, date, demand, demand - unmet sold, unmet, expired, "order", sum(demand) over (w range between current row and interval {P.held_days} day following) on_hand, coalesce(sum("order") over (w range between interval {P.lead_days} day preceding and interval 1 day preceding), 0) in_transit
  from led0 window w as (partition by store_id, item_id order by date)),
eco as (select cast(item_nbr as varchar) item_id, family category, cast({P.price_ref} as double) price, cast({_MARGIN} as double) margin_share, cast({P.price_ref} as double) * (1 - cast({_MARGIN} as double)) as cost from items),
priced as (select l.*, price, cost from ledger l join eco using (item_id) where date >= {_START}) """


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by store and item, with the days of shipment and order."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(read("part"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        (F.col("n_regionkey") + 1).cast("string").alias("store_id"), F.expr("cast(cast(substr(p_brand, 7) as bigint) as string)").alias("item_id"), F.col("l_shipdate").cast("date").alias("shipped"),
        F.col("o_orderdate").cast("date").alias("ordered"), F.col("l_quantity").cast("double").alias("q"), F.col("l_returnflag").alias("f"),
    )


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed ledger: lines that are flagged A were asked for and not served, R expired; orders stand on the day of their order."""
    lines, key = written(_lines(spark, sf_dir)), ["store_id", "item_id"]
    of = lambda flag: F.sum(F.when(F.col("f") == flag, F.col("q")).otherwise(0.0))
    moves = lines.groupBy(*key, F.col("shipped").alias("date")).agg(F.sum("q").alias("demand"), of("A").alias("unmet"), of("R").alias("expired"))
    orders = lines.filter("ordered is not null").groupBy(*key, F.col("ordered").alias("date")).agg(F.sum("q").alias("order"))
    return ledger.observed(_panel(spark, sf_dir), moves, orders, P.held_days, P.lead_days)


def _start():
    return P.window_start + timedelta(P.warm_up_days)


def _economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = raw_items(raw_sales(spark, sf_dir)).select(F.col("item_nbr").cast("string").alias("item_id"), F.col("family").alias("category"))
    return ledger.item_economics(items, P.margins, P.default_margin, P.price_ref)


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced ledger, written once for all that is asked of it."""
    return written(ledger.priced(written(_ledger(spark, sf_dir)), _economics(spark, sf_dir), _start()))


def _ratios(by: str, capital: str, days: str) -> str:
    """SQL for the money columns; capital and days are expressions over what is grouped."""
    return f"""{by}, round(sum(margin), 4) margin, round(sum(lost), 4) stockout_cost, round(sum(loss), 4) loss, round({capital}, 4) mean_capital, {days} n_days, round(sum(s) / nullif(sum(q), 0), 6) service_level,
  round(sum(cogs) / nullif({capital}, 0) * 365 / {days}, 6) turn, round({capital} * {days} * {P.capital_cost} / 365, 4) carrying_cost, round((sum(margin) - sum(loss)) / nullif({capital}, 0), 6) decision_metric"""


_DAY_MONEY = "sum(sold * (price - cost)) margin, sum(unmet * (price - cost)) lost, sum(expired * cost) loss, sum(on_hand * cost) capital, sum(sold * cost) cogs, sum(sold) s, sum(demand) q"


def _money_rounded(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, "margin", "stockout_cost", "loss", "mean_capital", "carrying_cost", places=4), "service_level", "turn", "decision_metric")


@_query("r1_ledger")
def r1(spark, sf_dir):
    return _rounded(_ledger(spark, sf_dir), "demand", "sold", "unmet", "expired", "order", "on_hand", "in_transit", places=4)


@_query("e1_item_economics")
def e1(spark, sf_dir):
    return _rounded(_economics(spark, sf_dir), "cost")


@_query("e3_item_money")
def e3(spark, sf_dir):
    return _money_rounded(ledger.item_money(_priced(spark, sf_dir), P.capital_cost))


@_query("e4_portfolio_money")
def e4(spark, sf_dir):
    return _money_rounded(ledger.portfolio_money(_priced(spark, sf_dir), P.capital_cost))


@_query("e5_daily_margin")
def e5(spark, sf_dir):
    return _rounded(ledger.daily_margin(_priced(spark, sf_dir)), "net_margin", "running", places=4)


ORACLE_SQL["r1_ledger"] = _LEDGER + 'select store_id, item_id, date, round(demand, 4) demand, round(sold, 4) sold, round(unmet, 4) unmet, round(expired, 4) expired, round("order", 4) "order", round(on_hand, 4) on_hand, round(in_transit, 4) in_transit from ledger'
ORACLE_SQL["e1_item_economics"] = _LEDGER + "select item_id, price, round(cost, 6) as cost, margin_share margin from eco"
ORACLE_SQL["e3_item_money"] = _LEDGER + f"select {_ratios('store_id, item_id', 'avg(capital)', 'count(*)')} from (select store_id, item_id, date, {_DAY_MONEY} from priced group by all) group by all"
ORACLE_SQL["e4_portfolio_money"] = _LEDGER + f"select {_ratios('store_id', 'avg(capital)', 'count(*)')} from (select store_id, date, {_DAY_MONEY} from priced group by all) group by all"
ORACLE_SQL["e5_daily_margin"] = _LEDGER + "select store_id, date, round(x, 4) net_margin, round(sum(x) over (partition by store_id order by date rows unbounded preceding), 4) running from (select store_id, date, sum(sold * (price - cost) - expired * cost) x from priced group by 1, 2)"
