"""Registered retail queries by name, each with DuckDB SQL for the same rows. Both read one parameter record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import round_up_to_pack
from ..operators import calendar, contracts, forecast, guards, panel, profiling, selection
from ..params import PARAMS as P
from ..sources.retail import kept_sales, raw_items, raw_sales

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_RAW = """l0 as (
  select cast(n_regionkey + 1 as bigint) store_nbr, cast(substr(p_brand, 7) as bigint) item_nbr, cast(l_shipdate as date) date, cast(l_quantity as double) q,
         cast(l_tax as double) tax, cast(l_discount as double) disc, l_returnflag = 'R' and l_linenumber = 7 back
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey),
raw as (
  select store_nbr, item_nbr, date, round(sum((case when back then -1 else 1 end) * q * (case when item_nbr % 5 = 0 then 1 - tax else 1 end)), 4) unit_sales,
         case when date < date '1996-01-01' then null else max(disc) >= 0.08 end onpromotion
  from l0 group by store_nbr, item_nbr, date),
items as (select distinct item_nbr, 'FAMILY ' || cast(item_nbr % 6 as varchar) family, item_nbr % 10 class, item_nbr % 2 perishable from raw)"""
_WINDOW = f"win as (select * from raw where date between date '{P.window_start}' and date '{P.window_end}')"
_LIVES = f"""lives as (
  select store_nbr, item_nbr, greatest(min(date), date '{P.window_start}') entry_date,
         case when date '{P.window_end}' - max(date) filter (where date between date '{P.window_start}' and date '{P.window_end}') > {P.delisting_gap_days}
              then max(date) filter (where date between date '{P.window_start}' and date '{P.window_end}') + {P.delisting_gap_days} else date '{P.window_end}' end exit_date
  from raw group by all having max(date) filter (where date between date '{P.window_start}' and date '{P.window_end}') is not null)"""
_REASON = "case " + " ".join(f"when s.date between date '{a}' and date '{b}' then '{why}'" for a, b, why in P.anomalies) + " end"
_PANEL = f"""spine as (select store_nbr, item_nbr, cast(unnest(generate_series(entry_date, exit_date, interval 1 day)) as date) date from lives),
panel as (
  select cast(s.store_nbr as varchar) store_id, cast(s.item_nbr as varchar) item_id, s.date, greatest(coalesce(w.unit_sales, 0), 0) + 0.0 units_sold, greatest(-coalesce(w.unit_sales, 0), 0) + 0.0 units_returned,
         w.onpromotion on_promo, d.date is not null is_operating_day, {_REASON} is not null is_anomaly, {_REASON} anomaly_reason
  from spine s left join win w using (store_nbr, item_nbr, date) left join (select distinct store_nbr, date from win) d on d.store_nbr = s.store_nbr and d.date = s.date)"""
_BASE = ",\n".join((_RAW, _WINDOW, _LIVES, _PANEL))


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = f"with {_BASE}{' ' if sql.startswith('select') else ', '}{sql}"
        return fn

    return add


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _panel(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    return panel.panel(kept_sales(spark, sf_dir) if sales is None else sales, P.window_start, P.window_end, P.delisting_gap_days, P.anomalies)


@_query("s4_known_totals", "select count(*) n_rows, min(date) min_date, max(date) max_date, round(avg(cast(onpromotion is null as double)), 6) promo_null_share from raw")
def known_totals(spark, sf_dir):
    return _rounded(raw_sales(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.avg(F.col("onpromotion").isNull().cast("double")).alias("promo_null_share")), "promo_null_share")


@_query("a1_calendar", "select min(date) min_date, max(date) max_date, count(distinct store_nbr) n_stores, count(distinct item_nbr) n_items, count(*) n_rows, count(distinct (store_nbr, item_nbr)) n_pairs from raw")
def a1(spark, sf_dir):
    return profiling.calendar(raw_sales(spark, sf_dir))


@_query("a2_store_lifespan", "select store_nbr, min(date) first_sale, max(date) last_sale, count(distinct date) n_days from raw group by 1")
def a2(spark, sf_dir):
    return profiling.store_lifespan(raw_sales(spark, sf_dir))


_COVERAGE = f"""coverage as (
  select store_nbr, item_nbr, min(date) first_sale, max(date) last_sale, count(distinct date) n_days_with_sale, cast(max(date) - min(date) + 1 as bigint) span_days,
         count(distinct date) / cast(max(date) - min(date) + 1 as double) density_pair_span,
         count(distinct date) / cast(date '{P.window_end}' - greatest(any_value(store_open), date '{P.window_start}') + 1 as double) density_window, any_value(store_open) <= date '{P.window_start}' store_covers_full_window
  from win join (select store_nbr, min(date) store_open from raw group by 1) using (store_nbr) group by 1, 2)"""


@_query("a3_pair_coverage", f"{_COVERAGE} select * replace (round(density_pair_span, 6) as density_pair_span, round(density_window, 6) as density_window) from coverage")
def a3(spark, sf_dir):
    return _rounded(profiling.pair_coverage(raw_sales(spark, sf_dir), P.window_start, P.window_end), "density_pair_span", "density_window")


@_query(
    "a4_item_volume",
    """r as (select *, row_number() over (partition by item_nbr order by unit_sales) r, count(*) over (partition by item_nbr) n from raw),
v as (select item_nbr, sum(unit_sales) total, median(unit_sales) median_units, max(case when r = floor(0.9 * (n - 1) + 0.5) + 1 then unit_sales end) p90_units, max(unit_sales) max_units, count(distinct store_nbr) n_stores from r group by 1)
select item_nbr, round(total, 4) total, round(median_units, 4) median_units, p90_units, max_units, n_stores, round(sum(total) over (order by total desc, item_nbr) / sum(total) over (), 6) cumulative_share from v""",
)
def a4(spark, sf_dir):
    return _rounded(_rounded(profiling.item_volume(raw_sales(spark, sf_dir)), "cumulative_share"), "total", "median_units", places=4)


@_query("a5_negatives_by_item", "select item_nbr, count(*) n_rows, count(*) filter (where unit_sales < 0) n_negative, round(avg(cast(unit_sales < 0 as double)), 6) negative_ratio from raw group by 1")
def a5(spark, sf_dir):
    return _rounded(profiling.negatives_by_item(raw_sales(spark, sf_dir)), "negative_ratio")


@_query("a6_fractional_by_item", "select item_nbr, count(*) n_rows, count(*) filter (where unit_sales <> round(unit_sales)) n_fractional, round(avg(cast(unit_sales <> round(unit_sales) as double)), 6) fractional_ratio from raw group by 1")
def a6(spark, sf_dir):
    return _rounded(profiling.fractional_by_item(raw_sales(spark, sf_dir)), "fractional_ratio")


@_query(
    "a5_a6_global_ratios",
    "select count(*) n_rows, count(*) filter (where unit_sales < 0) n_negative, round(avg(cast(unit_sales < 0 as double)), 6) negative_ratio, count(*) filter (where unit_sales <> round(unit_sales)) n_fractional, round(avg(cast(unit_sales <> round(unit_sales) as double)), 6) fractional_ratio from raw",
)
def a56(spark, sf_dir):
    return _rounded(profiling.global_ratios(raw_sales(spark, sf_dir)), "negative_ratio", "fractional_ratio")


@_query("a7_promo_availability", "select cast(date_trunc('month', date) as date) as month, count(*) n_rows, round(avg(cast(onpromotion is null as double)), 6) null_ratio from raw group by 1")
def a7(spark, sf_dir):
    return _rounded(profiling.promo_availability(raw_sales(spark, sf_dir)), "null_ratio")


_CUTS = ", ".join(f"(cast({c} as double))" for c in P.density_cuts)


@_query(
    "a8_candidates",
    f"""{_COVERAGE}, cuts(min_density) as (values {_CUTS}),
alive as (select min_density, store_nbr, item_nbr, family from cuts join coverage on density_window >= min_density and store_covers_full_window join items using (item_nbr)),
top as (select min_density, family, row_number() over (partition by min_density order by count(*) desc, family) r from alive group by 1, 2)
select c.min_density, count(a.item_nbr) n_pairs, count(distinct a.store_nbr) n_stores, count(distinct a.item_nbr) n_items, count(distinct a.family) n_families, any_value(t.family) top_family
from cuts c left join alive a using (min_density) left join top t on t.min_density = c.min_density and t.r = 1 group by 1""",
)
def a8(spark, sf_dir):
    sales = kept_sales(spark, sf_dir)
    return profiling.count_candidates(profiling.pair_coverage(sales, P.window_start, P.window_end), raw_items(sales), P.density_cuts)


@_query("c1_lifespans", "select store_nbr, item_nbr, entry_date, exit_date from lives")
def c1(spark, sf_dir):
    return panel.lifespans(raw_sales(spark, sf_dir), P.window_start, P.window_end, P.delisting_gap_days)


@_query("c2_spine", "select store_nbr, item_nbr, date from spine")
def c2(spark, sf_dir):
    return panel.spine(c1(spark, sf_dir))


@_query("c3_operating_days", "select distinct store_nbr, date from win")
def c3(spark, sf_dir):
    return panel.operating_days(profiling.in_window(raw_sales(spark, sf_dir), P.window_start, P.window_end))


@_query("c5_panel", "select store_id, item_id, date, units_sold, units_returned, on_promo, is_operating_day, is_anomaly, anomaly_reason from panel")
def c5(spark, sf_dir):
    return _panel(spark, sf_dir)


_MARGIN = "case family " + " ".join(f"when '{f}' then {m}" for f, m in P.margins) + f" else {P.default_margin} end"


@_query(
    "c6_items",
    f"""frac as (select item_nbr, avg(cast(unit_sales <> round(unit_sales) as double)) r from win group by 1)
select cast(item_nbr as varchar) item_id, family category, 'SUP-' || trim(regexp_replace(upper(trim(family)), '[^A-Z0-9]+', '_', 'g'), '_') supplier_id, case when coalesce(r, 0) > {P.fractional_threshold} then 'kg' else 'unidade' end unit_of_sale,
       perishable = 1 is_perishable, cast({P.price_ref} as double) price_ref, round(cast({P.price_ref} as double) * (1 - cast({_MARGIN} as double)), 6) cost from items left join frac using (item_nbr)""",
)
def c6(spark, sf_dir):
    sales = kept_sales(spark, sf_dir)
    return _rounded(panel.items(raw_items(sales), profiling.in_window(sales, P.window_start, P.window_end), P.margins, P.default_margin, P.fractional_threshold, P.price_ref), "cost")


_SLICE = f"date between date '{P.window_start}' and date '{P.slice_end}'"
_FUNNEL = f"""density as (
  select store_id, item_id, min(date) f, max(date) l, avg(case when {_SLICE} then cast(units_sold > 0 as double) end) density, avg(case when {_SLICE} then cast(coalesce(on_promo, false) as double) end) promo_share from panel group by 1, 2),
s1 as (select d.*, family, case when f > date '{P.window_start}' or l < date '{P.window_end}' then 'lifespan' when coalesce(density < {P.density_floor}, true) then 'density' when promo_share >= {P.promo_ceiling} then 'promotion' end a1 from density d join items on cast(item_nbr as varchar) = item_id),
s2 as (select *, count(*) filter (where a1 is null) over (partition by store_id, family) n_family from s1),
s3 as (select *, coalesce(a1, case when n_family < {P.min_family_items} then 'family' end) a2 from s2),
s4 as (select *, case when a2 is null then row_number() over (partition by store_id, family, a2 is null order by density desc, item_id) end r from s3),
funnel as (select *, coalesce(a2, case when r > {P.family_cap} then 'cap' end) left_at from s4)"""


def _density(spark, sf_dir, sales=None):
    selection.no_leakage(P.slice_end, P.as_of)
    return selection.slice_density(_panel(spark, sf_dir, sales), P.window_start, P.slice_end)


def _funnel(spark, sf_dir):
    sales = kept_sales(spark, sf_dir)
    families = raw_items(sales).select(F.col("item_nbr").cast("string").alias("item_id"), "family")
    return selection.funnel(_density(spark, sf_dir, sales), families, (P.window_start, P.window_end), P.density_floor, P.promo_ceiling, P.min_family_items, P.family_cap)


@_query("b3_density_by_item", f"{_FUNNEL} select store_id, item_id, f first_day, l last_day, round(density, 6) density, round(promo_share, 6) promo_share from density")
def b3(spark, sf_dir):
    return _rounded(_density(spark, sf_dir), "density", "promo_share")


@_query("b6_selection", f'{_FUNNEL} select store_id, family, item_id, round(density, 6) density, n_family, cast(r as integer) "rank" from funnel where left_at is null')
def b6(spark, sf_dir):
    return _rounded(_funnel(spark, sf_dir).filter("left_at is null").select("store_id", "family", "item_id", "density", "n_family", "rank"), "density")


_WHY = "case name " + " ".join(f"when '{k}' then '{v}'" for k, v in selection.STAGES.items()) + " end"
_NAMES = ", ".join(f"({k + 1}, '{s}')" for k, s in enumerate(selection.STAGES))


@_query(
    "b8_funnel",
    f"""{_FUNNEL}, st(stage, name) as (values {_NAMES}), c as (select store_id, stage, name, count(*) n, count(*) filter (where left_at = name) x from funnel cross join st group by all),
o as (select *, coalesce(sum(x) over (partition by store_id order by stage rows between unbounded preceding and 1 preceding), 0) gone from c),
small as (select store_id, string_agg(distinct family, ', ' order by family) fams from funnel where left_at = 'family' group by 1)
select o.store_id, cast(stage as integer) stage, name, cast(n - gone as bigint) "before", cast(n - gone - x as bigint) "after", x excluded, case when x > 0 then {_WHY} || case when name = 'family' then ': ' || fams else '' end end reason from o left join small using (store_id)""",
)
def b8(spark, sf_dir):
    return selection.funnel_table(_funnel(spark, sf_dir))


@_query("c7_suppliers", f"select distinct 'SUP-' || trim(regexp_replace(upper(trim(family)), '[^A-Z0-9]+', '_', 'g'), '_') supplier_id, cast({P.lead_days} as bigint) lead_time_days, '{','.join(map(str, P.order_days))}' order_days, cast({P.review_days} as bigint) review_period_days, cast({P.least_value} as double) min_order_value, cast({P.least_units} as double) min_order_units from items")
def c7(spark, sf_dir):
    found = panel.suppliers(raw_items(raw_sales(spark, sf_dir)), P.lead_days, P.review_days, P.order_days, P.least_value, P.least_units)
    return found.withColumn("order_days", F.array_join("order_days", ","))


_HOLIDAYS = "hol(date, type, locale, locale_name, transferred) as (values " + ", ".join(f"(date '{d}', '{t}', '{a}', '{n}', {str(m).lower()})" for d, t, a, n, m in P.holidays) + ")"
_EFFECTIVE = "type in ('Holiday', 'Additional', 'Transfer', 'Bridge') and not (type = 'Holiday' and transferred)"


@_query(
    "k2_holiday_flags",
    f"""{_HOLIDAYS}, eff as (select * from hol where {_EFFECTIVE}), d as (select distinct store_nbr, date, 'STATE ' || cast(store_nbr % 2 as varchar) state, 'CITY ' || cast(store_nbr as varchar) city from win)
select store_nbr, date, state, city, exists (select 1 from eff e where e.date = d.date and locale = 'National') is_holiday_national, exists (select 1 from eff e where e.date = d.date and locale = 'Regional' and locale_name = state) is_holiday_regional,
       exists (select 1 from eff e where e.date = d.date and locale = 'Local' and locale_name = city) is_holiday_local from d""",
)
def k2(spark, sf_dir):
    days = c3(spark, sf_dir).withColumns({"state": F.concat(F.lit("STATE "), (F.col("store_nbr") % 2).cast("string")), "city": F.concat(F.lit("CITY "), F.col("store_nbr").cast("string"))})
    holidays = spark.createDataFrame(list(P.holidays), "date date, type string, locale string, locale_name string, transferred boolean")
    return calendar.holiday_flags(days, holidays).select("store_nbr", "date", "state", "city", "is_holiday_national", "is_holiday_regional", "is_holiday_local")


_FLAGS = f"""past as (select *, avg(units_sold) over w m, count(*) filter (where units_sold > 0) over w n from panel window w as (partition by store_id, item_id order by date range between interval {P.censor_window} day preceding and interval 1 day preceding)),
flags as (select store_id, item_id, date, coalesce(units_sold = 0 and m >= {P.censor_mean} and n >= {P.censor_sale_days}, false) is_censored from past)"""


def _flags(spark, sf_dir):
    return panel.probable_stockouts(_panel(spark, sf_dir), P.censor_window, P.censor_mean, P.censor_sale_days)


@_query("z1_probable_stockouts", f"{_FLAGS} select store_id, item_id, date, is_censored, case when is_censored then 'entries_unknown' end reason from flags")
def z1(spark, sf_dir):
    return _flags(spark, sf_dir)


_ENTRIES = f"entries as (select distinct cast(n_regionkey + 1 as varchar) store_id, cast(cast(substr(p_brand, 7) as bigint) as varchar) item_id, cast(l_shipdate as date) + cast(k as integer) date from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey cross join generate_series(1, {P.quiet_days}) g(k) where l_linenumber = 1)"


@_query("z1_stockouts_with_receipts", f"{_FLAGS}, {_ENTRIES} select store_id, item_id, date, is_censored and e.date is null is_censored, case when is_censored and e.date is null then 'no_recent_entry' end reason from flags left join entries e using (store_id, item_id, date)")
def z1_receipts(spark, sf_dir):
    """Stockouts where goods came in: the first lines of orders are receipts, after which a day without a sale is none for some days."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").filter("l_linenumber = 1").join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(read("part"), F.col("p_partkey") == F.col("l_partkey"))
    receipts = lines.select((F.col("n_regionkey") + 1).cast("string").alias("store_id"), F.expr("cast(cast(substr(p_brand, 7) as bigint) as string)").alias("item_id"), F.col("l_shipdate").cast("date").alias("received_date"))
    return panel.flags_if_active(_panel(spark, sf_dir), True, P.censor_window, P.censor_mean, P.censor_sale_days, receipts, P.quiet_days)


@_query("z4_drop_censored", f"{_FLAGS} select store_id, item_id, date, units_sold from past where not coalesce(units_sold = 0 and m >= {P.censor_mean} and n >= {P.censor_sale_days}, false)")
def z4(spark, sf_dir):
    return panel.uncensored(_panel(spark, sf_dir).select(*panel.KEYS, "units_sold"), P.censor_window, P.censor_mean, P.censor_sale_days)


@_query("z5_censoring_summary", f"{_FLAGS} select coalesce(store_id, 'TOTAL') store_id, coalesce(item_id, 'TOTAL') item_id, count(*) n_days, count(*) filter (where is_censored) n_censored, round(avg(cast(is_censored as double)), 6) censored_share, avg(cast(is_censored as double)) > 0.15 alert from flags group by grouping sets ((store_id, item_id), ())")
def z5(spark, sf_dir):
    return _rounded(panel.censoring_summary(_flags(spark, sf_dir)), "censored_share")


@_query("x1_lag_7", "select store_id, item_id, date, max(units_sold) over (partition by store_id, item_id order by date range between interval 7 day preceding and interval 7 day preceding) lag_7 from panel")
def x1(spark, sf_dir):
    return forecast.lag_on_day(_panel(spark, sf_dir), 7)


@_query(
    "x2_window_features",
    """f as (select store_id, item_id, date, avg(units_sold) over w "mean", sum(units_sold) over w total, avg(cast(units_sold > 0 as double)) over w sale_share, avg(cast(coalesce(on_promo, false) as double)) over w promo_share,
  avg(cast(on_promo is not null as double)) over w promo_known_share, date - max(case when units_sold > 0 then date end) over e days_since_sale, date - max(case when on_promo then date end) over e days_since_promo
  from panel window w as (partition by store_id, item_id order by date range between interval 28 day preceding and interval 1 day preceding), e as (partition by store_id, item_id order by date range between unbounded preceding and interval 1 day preceding))
select store_id, item_id, date, round("mean", 9) "mean", round(total, 4) total, round(sale_share, 9) sale_share, round(promo_share, 9) promo_share, round(promo_known_share, 9) promo_known_share, days_since_sale, days_since_promo from f""",
)
def x2(spark, sf_dir):
    return _rounded(_rounded(forecast.window_features(_panel(spark, sf_dir), 28), "mean", "sale_share", "promo_share", "promo_known_share", places=9), "total", places=4)


_POINTS = f"""pts0 as (select store_id, item_id, date, coalesce(avg(units_sold) over w, 0) daily_mean, count(*) over w n_past, sum(units_sold) over a actual, count(*) over a n_ahead from panel
  window w as (partition by store_id, item_id order by date range between interval {7 * P.naive_weeks} day preceding and interval 1 day preceding), a as (partition by store_id, item_id order by date range between current row and interval {P.horizon - 1} day following)),
pts as (select store_id, item_id, date, daily_mean, daily_mean * {P.horizon} point, case when n_ahead = {P.horizon} and n_past > 0 then actual - daily_mean * {P.horizon} end residual from pts0)"""


@_query("m3_naive_residuals", f"{_POINTS} select store_id, item_id, date, round(daily_mean, 9) daily_mean, round(point, 9) point, round(residual, 9) residual from pts")
def m3(spark, sf_dir):
    return _rounded(forecast.naive_points(_panel(spark, sf_dir), P.naive_weeks, P.horizon).drop("actual"), "daily_mean", "point", "residual", places=9)


_QS = ", ".join(f"(cast({q} as double))" for q in P.quantiles)


@_query(
    "m4_naive_quantiles",
    f"""{_POINTS}, qs(quantile) as (values {_QS}), at_day as (select * from pts where date = date '{P.as_of}'),
r as (select store_id, item_id, quantile, count(residual) n, quantile_cont(residual, {P.quantiles[0]}) a, quantile_cont(residual, {P.quantiles[1]}) b, quantile_cont(residual, {P.quantiles[2]}) c from pts, qs where date <= date '{P.as_of}' - {P.horizon} group by all)
select store_id, item_id, quantile, round(case when coalesce(n, 0) >= {P.min_residuals} then greatest(0, point + case quantile when {P.quantiles[0]} then a when {P.quantiles[1]} then b else c end) else point end, 9) "value" from at_day cross join qs left join r using (store_id, item_id, quantile)""",
)
def m4(spark, sf_dir):
    return _rounded(forecast.naive_quantiles(forecast.naive_points(_panel(spark, sf_dir), P.naive_weeks, P.horizon), P.as_of, P.horizon, P.quantiles, P.min_residuals), "value", places=9)


@_query(
    "m9_seasonal_naive",
    f"""want as (select k, 7 * (k // 7 + 1) - k ago from generate_series(0, {P.horizon - 1}) t(k)), pairs as (select distinct store_id, item_id from panel where date < date '{P.as_of}')
select q.store_id, q.item_id, round(case when count(p.date) = {P.horizon} then sum(p.units_sold) end, 4) "value" from pairs q cross join want left join panel p on p.store_id = q.store_id and p.item_id = q.item_id and p.date = date '{P.as_of}' - cast(ago as integer) group by 1, 2""",
)
def m9(spark, sf_dir):
    return _rounded(forecast.seasonal_naive(_panel(spark, sf_dir), P.as_of, P.horizon), "value", places=4)


_PACK = "(1 + item_nbr % 7)"


@_query("g2_round_up_to_pack", f"select store_nbr, item_nbr, date, case when unit_sales <= 0 then 0.0 else case when abs(unit_sales / {_PACK} - round_even(unit_sales / {_PACK}, 0)) <= 1e-9 * greatest(abs(unit_sales / {_PACK}), abs(round_even(unit_sales / {_PACK}, 0))) then round_even(unit_sales / {_PACK}, 0) else ceil(unit_sales / {_PACK}) end * {_PACK} end quantity from raw")
def g2(spark, sf_dir):
    return raw_sales(spark, sf_dir).select("store_nbr", "item_nbr", "date", round_up_to_pack(F.col("unit_sales"), (1 + F.col("item_nbr") % 7).cast("double")).alias("quantity"))


_CANDIDATES = "cand as (select cast(store_nbr as varchar) store_id, cast(item_nbr as varchar) item_id, family category, round(sum(greatest(unit_sales, 0)), 4) value, cast(0.05 as double) + cast(item_nbr * 37 % 100 as double) / 200 margin from win join items using (item_nbr) group by store_nbr, item_nbr, family)"


def _candidates(spark, sf_dir):
    sales = kept_sales(spark, sf_dir)
    rows = profiling.in_window(sales, P.window_start, P.window_end).join(raw_items(sales).select("item_nbr", "family"), "item_nbr")
    return rows.groupBy("store_nbr", "item_nbr", "family").agg(F.round(F.sum(F.greatest("unit_sales", F.lit(0.0))), 4).alias("value")).select(
        F.col("store_nbr").cast("string").alias("store_id"), F.col("item_nbr").cast("string").alias("item_id"), F.col("family").alias("category"), "value", (0.05 + (F.col("item_nbr") * 37 % 100) / 200.0).alias("margin")
    )


@_query("y5_margin_cutoff", f"{_CANDIDATES} select store_id, item_id, value, sum(value) over (partition by store_id order by margin desc, item_id rows unbounded preceding) <= {P.cash_budget} kept from cand")
def y5(spark, sf_dir):
    return guards.margin_cutoff(_candidates(spark, sf_dir), P.cash_budget).select("store_id", "item_id", "value", "kept")


@_query("y6_floor_and_headroom", f"{_CANDIDATES} select store_id, item_id, category, sum(value) over (partition by store_id, category order by margin, item_id rows unbounded preceding) <= {1 - P.floor_share} * sum(value) over (partition by store_id, category) is_headroom from cand")
def y6(spark, sf_dir):
    return guards.floor_and_headroom(_candidates(spark, sf_dir), P.floor_share).select("store_id", "item_id", "category", "is_headroom")


@_query("v4_column_findings", "select 'null' rule, 'onpromotion' column_name, count(*) filter (where onpromotion is null) n from raw union all select 'bound', 'unit_sales', count(*) filter (where unit_sales < 0) from raw")
def v4(spark, sf_dir):
    return contracts.column_findings(raw_sales(spark, sf_dir), ["onpromotion"], {"unit_sales": 0.0}, {})


@_query("v8_duplicate_keys", "select count(*) n_keys, cast(coalesce(sum(n), 0) as bigint) n_rows from (select count(*) n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)")
def v8(spark, sf_dir):
    return contracts.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


_DAYS = "sd as (select supplier, d from (select l_suppkey supplier, isodow(l_shipdate) d, count(*) c, sum(count(*)) over (partition by l_suppkey) n from lineitem group by 1, 2) where 7 * c > n)"


def _order_days(spark, sf_dir):
    """Weekdays on which a supplier ships more than a seventh of its lines: the order days that its suppliers' table would state."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("supplier"), (F.weekday("l_shipdate") + 1).alias("d")).agg(F.count("*").alias("c"))
    days = lines.groupBy("supplier").agg(F.collect_list(F.struct("d", "c")).alias("all"), F.sum("c").alias("n"))
    return days.select("supplier", F.transform(F.filter("all", lambda x: 7 * x["c"] > F.col("n")), lambda x: x["d"]).alias("days")).filter(F.size("days") > 0)


@_query("v7_array_findings", f"{_DAYS}, a as (select supplier, count(*) n, bool_or(d > 5) o from sd group by 1) select count(*) filter (where n < 3) n_short, count(*) filter (where o) n_out_of_bounds, count(*) n_rows from a")
def v7(spark, sf_dir):
    return contracts.array_findings(_order_days(spark, sf_dir), "days", 3, 1, 5)


@_query(
    "v10_supplier_cadence",
    f"""{_DAYS}, g as (select supplier, coalesce(lead(d) over (partition by supplier order by d), first_value(d) over (partition by supplier order by d) + 7) - d gap from sd)
select supplier, max(gap) gap, cast({P.cadence_days} as bigint) review_days from g group by 1 having max(gap) > {P.cadence_days}""",
)
def v10(spark, sf_dir):
    return contracts.cadence_findings(_order_days(spark, sf_dir), "supplier", "days", F.lit(P.cadence_days))


@_query("v9_orphans", 'select cast(o_orderkey as varchar) "value", count(*) n_rows from orders where o_orderkey is not null and not exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1')
def v9(spark, sf_dir):
    """Orders that no line refers to: keys that the other table lacks by nature."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contracts.orphans(read("orders"), "o_orderkey", read("lineitem"), "l_orderkey")


_CASH = f"""scen(scenario, share) as (values {', '.join(f"({k}, cast({c} as double))" for k, c in enumerate(P.cash_shares))}),
cc as (select scenario, c.*, floor(share * sum(value) over (partition by scenario, store_id) * 100 + 0.001) / 100 budget from cand c cross join scen),
c1 as (select *, sum(value) over (partition by scenario, store_id, category order by margin, item_id rows unbounded preceding) <= {1 - P.floor_share} * sum(value) over (partition by scenario, store_id, category) hr from cc),
c2 as (select *, sum(value) over (partition by scenario, store_id) total, sum(case when not hr then value else 0 end) over (partition by scenario, store_id) protected,
  sum(value) over (partition by scenario, store_id, hr order by margin desc, item_id rows unbounded preceding) spent from c1),
cat as (select scenario, store_id, category, max(budget) budget, sum(case when not hr then value else 0 end) p, row_number() over (partition by scenario, store_id order by sum(value * margin) / sum(value) desc, category) k from c1 group by 1, 2, 3),
walk as (select scenario, store_id, cast(0 as bigint) k, max(budget) room, cast(null as varchar) got from cat group by 1, 2 union all
  select w.scenario, w.store_id, c.k, case when c.p <= w.room then w.room - c.p else w.room end, case when c.p <= w.room then c.category end from walk w join cat c on c.scenario = w.scenario and c.store_id = w.store_id and c.k = w.k + 1)"""


@_query("y9_cash_rule")
def y9(spark, sf_dir):
    shares = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(c).alias("share")) for k, c in enumerate(P.cash_shares))))
    rows = _candidates(spark, sf_dir).withColumn("s", shares).select("*", "s.scenario", "s.share")
    rows = rows.withColumn("budget", F.floor(F.col("share") * F.sum("value").over(Window.partitionBy("scenario", "store_id")) * 100 + 0.001) / 100)
    return guards.cash_rule(rows, P.floor_share).select("scenario", "store_id", "item_id", "category", F.col("case_").alias("rule_case"), "kept", "cash_flag", F.round("shortfall", 4).alias("shortfall"))


ORACLE_SQL["y9_cash_rule"] = f"""with recursive {_BASE}, {_CANDIDATES}, {_CASH}
select * exclude (hr, alone), case when not kept then 'reduced' when not hr and not alone then 'protected by the floor' end cash_flag from (
select c2.scenario, c2.store_id, item_id, category, case when total <= budget then 'all' when protected > budget then 'shortfall' else 'floor' end rule_case, hr, sum(value) over (partition by c2.scenario, c2.store_id order by margin desc, item_id rows unbounded preceding) <= budget alone,
  case when total <= budget then true when protected > budget then not hr and w.got is not null else not hr or spent <= budget - protected end kept, case when total > budget and protected > budget then round(protected - budget, 4) end shortfall
from c2 left join walk w on w.scenario = c2.scenario and w.store_id = c2.store_id and w.got = c2.category)"""
