"""Registered queries of data quality, guard counts and monthly figures, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, panel, quality, reporting, scenarios
from ..params import PARAMS as P
from ..sources.intermediate import written
from .replenishment import _CAPPED, _DAY_MONEY, _LEDGER, _NEED, _QUANTILES, _START, ORACLE_SQL, QUERIES, _capped, _economics, _ledger, _money_rounded, _needs, _priced, _ratios, _start, e3, r1
from .retail import _FLAGS, _POINTS, _panel, _query, _rounded

_NO_SALE = f"count(*) filter (where units_sold > 0) over (partition by store_id, item_id order by date range between interval {P.return_days} day preceding and interval 1 day preceding)"


@_query("d1_divergent_values")
def d1(spark, sf_dir):
    return quality.divergent_values(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", "p_type")


ORACLE_SQL["d1_divergent_values"] = "select p_brand code, count(distinct p_type) n_values, min(p_type) first_value, max(p_type) last_value from part group by 1 having count(distinct p_type) > 1"


@_query("d2_returns_without_sale", f"select store_id, item_id, date, round(units_returned, 4) units_returned from (select *, {_NO_SALE} n from panel) where units_returned > 0 and n = 0")
def d2(spark, sf_dir):
    return _rounded(quality.returns_without_sale(_panel(spark, sf_dir), P.return_days), "units_returned", places=4)


@_query(
    "d7_quality_report",
    f"""{_FLAGS}, j as (select p.*, is_censored from panel p join flags f using (store_id, item_id, date)),
c as (select count(*) n, count(*) filter (where is_censored) a, count(*) filter (where units_returned > 0) b, count(*) filter (where units_sold <> round(units_sold)) c, count(*) filter (where on_promo is null) d, count(*) filter (where not is_operating_day) e from j)
select 'zero day in regular item' "check", a n_findings, round(a / n, 6) share from c union all select 'net return', b, round(b / n, 6) from c union all select 'fractional units', c, round(c / n, 6) from c
union all select 'promotion unknown', d, round(d / n, 6) from c union all select 'store closed', e, round(e / n, 6) from c""",
)
def d7(spark, sf_dir):
    history = _panel(spark, sf_dir)
    flags = panel.probable_stockouts(history, P.censor_window, P.censor_mean, P.censor_sale_days).select(*panel.KEYS, "is_censored")
    checks = {
        "zero day in regular item": F.col("is_censored"), "net return": F.col("units_returned") > 0, "fractional units": F.col("units_sold") != F.round("units_sold"),
        "promotion unknown": F.col("on_promo").isNull(), "store closed": ~F.col("is_operating_day"),
    }
    return _rounded(quality.check_summary(history.join(flags, panel.KEYS), checks), "share")


@_query(
    "d8_table_diff",
    f"""{_FLAGS}, k as (select store_id, item_id, date, units_sold from panel join flags using (store_id, item_id, date) where not is_censored),
b as (select p.units_sold x, k.units_sold y, p.store_id is not null in_x, k.store_id is not null in_y from panel p full join k on p.store_id = k.store_id and p.item_id = k.item_id and p.date = k.date)
select 'only in expected' "check", count(*) filter (where not in_y) n_findings from b union all select 'only in actual', count(*) filter (where not in_x) from b union all select 'units_sold', count(*) filter (where in_x and in_y and x is distinct from y) from b""",
)
def d8(spark, sf_dir):
    history = _panel(spark, sf_dir)
    slim = history.select(*panel.KEYS, "units_sold")
    kept = panel.drop_censored(slim, panel.probable_stockouts(history, P.censor_window, P.censor_mean, P.censor_sale_days))
    return quality.table_diff(slim, kept, panel.KEYS)


@_query(
    "i1_i3_coverage_days",
    f"""{_POINTS}, {_QUANTILES}, {_NEED}, d28 as (select store_id, item_id, avg(units_sold) daily from panel where date between date '{P.as_of}' - {P.demand_days} and date '{P.as_of}' - 1 group by 1, 2)
select p.store_id, p.item_id, round(coalesce(d.daily, 0), 6) daily, round(case when d.daily > 0 then "position" / d.daily end, 6) coverage_days from pos p left join d28 d on d.store_id = p.store_id and d.item_id = p.item_id""",
)
def i3(spark, sf_dir):
    """Mean demand of the last DEMAND_DAYS days, and the days that the position lasts at it; null without demand."""
    recent = F.col("date").between(F.date_sub(F.lit(P.as_of), P.demand_days), F.date_sub(F.lit(P.as_of), 1))
    demand = _panel(spark, sf_dir).filter(recent).groupBy("store_id", "item_id").agg(F.avg("units_sold").alias("mean_demand"))
    rows = _needs(spark, sf_dir).select("store_id", "item_id", "position").join(demand, ["store_id", "item_id"], "left")
    return rows.select("store_id", "item_id", F.round(F.coalesce("mean_demand", F.lit(0.0)), 6).alias("daily"), F.round(F.when(F.col("mean_demand") > 0, F.col("position") / F.col("mean_demand")), 6).alias("coverage_days"))


@_query(
    "y10_guard_counts",
    f"""{_POINTS}, {_QUANTILES}, {_NEED}, {_CAPPED}, c as (select count(*) n, count(*) filter (where cut) a, count(*) filter (where conflict) b, count(*) filter (where quantity <= 0) z from capped)
select 'coverage cap' "check", a n_findings, round(a / n, 6) share from c union all select 'shelf conflict', b, round(b / n, 6) from c union all select 'nothing to order', z, round(z / n, 6) from c""",
)
def y10(spark, sf_dir):
    return _rounded(quality.check_summary(_capped(spark, sf_dir), {"coverage cap": F.col("cut"), "shelf conflict": F.col("conflict"), "nothing to order": F.col("quantity") <= 0}), "share")


_MONEY = _LEDGER + ", money as (" + ORACLE_SQL["e3_item_money"].removeprefix(_LEDGER) + ")"
_TOTALS = ", totals as (select store_id, sum(margin) margin, sum(stockout_cost) stockout_cost, sum(loss) loss, sum(mean_capital) capital, max(n_days) n_days from money group by 1) "


@_query("n1_n2_store_totals")
def n12(spark, sf_dir):
    return _rounded(reporting.store_totals(e3(spark, sf_dir)), "margin", "stockout_cost", "loss", "capital", "monthly_margin", "monthly_stockout_cost", "monthly_loss", places=4)


ORACLE_SQL["n1_n2_store_totals"] = _MONEY + _TOTALS + (
    "select store_id, round(margin, 4) margin, round(stockout_cost, 4) stockout_cost, round(loss, 4) loss, round(capital, 4) capital, n_days, round(margin / (n_days / 30), 4) monthly_margin, round(stockout_cost / (n_days / 30), 4) monthly_stockout_cost, round(loss / (n_days / 30), 4) monthly_loss from totals"
)


@_query("n4_margin_sensitivity")
def n4(spark, sf_dir):
    return _rounded(reporting.margin_sensitivity(reporting.store_totals(e3(spark, sf_dir)), P.margin_factors), "margin", "stockout_cost", places=6)


ORACLE_SQL["n4_margin_sensitivity"] = _MONEY + _TOTALS + f"select store_id, cast(factor as double) factor, round(margin * factor, 6) margin, round(stockout_cost * factor, 6) stockout_cost from totals, unnest({[*P.margin_factors]}::double[]) t(factor)"


@_query("n5_most_lost_margin")
def n5(spark, sf_dir):
    economics = _rounded(_economics(spark, sf_dir).withColumnRenamed("margin", "margin_share"), "cost")
    money = e3(spark, sf_dir).select("store_id", "item_id", "margin", "stockout_cost", "service_level")
    return _rounded(reporting.most_lost(money, economics, P.most_lost), "lost_share")


ORACLE_SQL["n5_most_lost_margin"] = _MONEY + (
    "select store_id, item_id, margin, stockout_cost, service_level, price, round(cost, 6) as cost, margin_share, round(stockout_cost / nullif(stockout_cost + margin, 0), 6) lost_share from "
    f"(select * from money order by stockout_cost desc, store_id, item_id limit {P.most_lost}) join eco using (item_id)"
)

_SHARES = f", shares as (select m.store_id, m.item_id, decision_metric, stockout_cost, s.days, sale_days, sale_days / s.days sale_day_share from money m join (select store_id, item_id, count(*) as days, count(*) filter (where sold > 0) sale_days from ledger where date >= {_START} group by 1, 2) s using (store_id, item_id)) "


def _decomposed(spark, sf_dir):
    events = written(_ledger(spark, sf_dir))
    money = _money_rounded(ledger.item_money(ledger.priced(events, _economics(spark, sf_dir), _start()), P.capital_cost))
    return reporting.item_decomposition(events, money.select("store_id", "item_id", "decision_metric", "stockout_cost"), _start())


@_query("h8_item_decomposition")
def h8(spark, sf_dir):
    return _rounded(_decomposed(spark, sf_dir), "sale_day_share")


@_query("h8_rank_correlation")
def h8_rank(spark, sf_dir):
    return _rounded(reporting.spearman(_decomposed(spark, sf_dir), "store_id", "decision_metric", "sale_day_share"), "spearman")


@_query("h8_metric_spread")
def h8_spread(spark, sf_dir):
    return scenarios.spread(_decomposed(spark, sf_dir), ["store_id"], "decision_metric")


ORACLE_SQL["h8_item_decomposition"] = _MONEY + _SHARES + "select store_id, item_id, decision_metric, stockout_cost, days, sale_days, round(sale_day_share, 6) sale_day_share from shares"
ORACLE_SQL["h8_rank_correlation"] = _MONEY + _SHARES + (
    ", k as (select * from shares where decision_metric is not null), r as (select store_id, rank() over (partition by store_id order by decision_metric) + (count(*) over (partition by store_id, decision_metric) - 1) / 2 rx, "
    "rank() over (partition by store_id order by sale_day_share) + (count(*) over (partition by store_id, sale_day_share) - 1) / 2 ry from k) select store_id, round(corr(rx, ry), 6) spearman, count(*) n from r group by 1"
)
ORACLE_SQL["h8_metric_spread"] = _MONEY + _SHARES + (
    ", k as (select store_id, decision_metric x, row_number() over (partition by store_id order by decision_metric) r, count(*) over (partition by store_id) n from shares where decision_metric is not null) "
    "select store_id, count(*) n, min(x) least, max(x) largest, median(x) median, max(case when r = floor(0.1 * (n - 1) + 0.5) + 1 then x end) p10, max(case when r = floor(0.9 * (n - 1) + 0.5) + 1 then x end) p90 from k group by 1"
)

_SCENARIO = "case " + " ".join(f"when date < date '{d}' then '{s}'" for s, d in P.scenarios) + " end"
_COVERED = "case scenario " + " ".join(f"when '{s}' then cast({c} as double)" for s, c in P.coverage) + " end"
_SCENARIOS = _LEDGER + f", days as (select store_id, {_SCENARIO} scenario, date, {_DAY_MONEY} from priced group by all), scen as (select {_ratios('store_id, scenario', 'avg(capital)', 'count(*)')} from days group by all) "
_RISK = P.lead_days + P.review_days


def _scenario_money(spark, sf_dir):
    """A row per store and scenario: the ledger's days under three regimes, one after another."""
    name = F.coalesce(*(F.when(F.col("date") < F.lit(d), s) for s, d in P.scenarios))
    return written(_money_rounded(ledger.portfolio_money(_priced(spark, sf_dir).withColumn("scenario", name), P.capital_cost, ("store_id", "scenario"))))


@_query("h10_scenario_comparison")
def h10(spark, sf_dir):
    days = F.coalesce(*(F.when(F.col("scenario") == s, F.lit(c)) for s, c in P.coverage), F.lit(None).cast("double"))
    found = scenarios.compared(_scenario_money(spark, sf_dir).withColumn("coverage_days", days), ["store_id"], "recalibrated", P.service_target, _RISK)
    return _rounded(found, "gap_to_target_pp", "gap_to_baseline_pp", "decision_vs_baseline_pct", "capital_vs_baseline_pct", "coverage_by_window", places=3)


ORACLE_SQL["h10_scenario_comparison"] = _SCENARIOS + (
    f"select s.store_id, s.scenario, s.service_level, round(({P.service_target} - s.service_level) * 100, 3) gap_to_target_pp, round((b.service_level - s.service_level) * 100, 3) gap_to_baseline_pp, s.decision_metric, round((s.decision_metric / nullif(b.decision_metric, 0) - 1) * 100, 3) decision_vs_baseline_pct, "
    f"s.mean_capital, round((s.mean_capital / nullif(b.mean_capital, 0) - 1) * 100, 3) capital_vs_baseline_pct, round({_COVERED.replace('case scenario', 'case s.scenario')} / {_RISK}, 3) coverage_by_window from scen s left join scen b on b.store_id = s.store_id and b.scenario = 'recalibrated'"
)


@_query("h11_gain_split")
def h11(spark, sf_dir):
    found = scenarios.gain_split(_scenario_money(spark, sf_dir), ["store_id"], "stale", "recalibrated", "model")
    return _rounded(found, *(c for c in found.columns if c != "store_id"))


_THREE = "select store_id, " + ", ".join(f"max({c}) filter (where scenario = '{s}') {s[0]}_{c}" for s, _ in P.scenarios for c in ("decision_metric", "service_level", "stockout_cost", "mean_capital", "loss", "n_days")) + " from scen group by 1"
ORACLE_SQL["h11_gain_split"] = _SCENARIOS + (
    ", x as (" + _THREE + ") select store_id, round(m_decision_metric - s_decision_metric, 6) gain, round(r_decision_metric - s_decision_metric, 6) gain_by_recalibration, round(m_decision_metric - r_decision_metric, 6) gain_by_model, round((r_service_level - s_service_level) * 100, 6) gap_pp, "
    "round((r_service_level - s_service_level) * 100, 6) closed_by_recalibration_pp, round((m_service_level - r_service_level) * 100, 6) closed_by_model_pp, case when (r_service_level - s_service_level) * 100 <> 0 then 100.0::double end closed_by_recalibration_pct from x"
)


@_query("n3_gains")
def n3(spark, sf_dir):
    return _rounded(scenarios.gains(_scenario_money(spark, sf_dir), ["store_id"], "recalibrated", "model"), "stockout_avoided", "capital_freed", "loss_avoided", places=4)


ORACLE_SQL["n3_gains"] = _SCENARIOS + ", x as (" + _THREE + ") select store_id, round(r_stockout_cost - m_stockout_cost, 4) stockout_avoided, round(r_mean_capital - m_mean_capital, 4) capital_freed, round(r_loss - m_loss, 4) loss_avoided from x"


@_query("n6_s17_monthly_report")
def n6(spark, sf_dir):
    return _rounded(scenarios.monthly_report(_scenario_money(spark, sf_dir), ["store_id"], "stale", "recalibrated", "model"), "value", places=4)


_OF_MONTH = {c: f"{c} * 30.0 / n_days" for c in ("margin", "stockout_cost", "loss")} | {c: c for c in ("mean_capital", "service_level", "decision_metric")}
_STEP = {
    ("recalibration", "stale to recalibrated"): {"stockout_avoided": "s_stockout_cost * 30.0 / s_n_days - r_stockout_cost * 30.0 / r_n_days", "capital_added": "r_mean_capital - s_mean_capital", "loss_avoided": "s_loss * 30.0 / s_n_days - r_loss * 30.0 / r_n_days"},
    ("model", "recalibrated to model"): {"stockout_avoided": "r_stockout_cost * 30.0 / r_n_days - m_stockout_cost * 30.0 / m_n_days", "capital_freed": "r_mean_capital - m_mean_capital", "loss_avoided": "r_loss * 30.0 / r_n_days - m_loss * 30.0 / m_n_days"},
}
ORACLE_SQL["n6_s17_monthly_report"] = _SCENARIOS + ", x as (" + _THREE + ") " + " union all ".join(
    [f"select store_id, 'scenarios' section, '{k}' as indicator, scenario, round({v}, 4) as \"value\" from scen" for k, v in _OF_MONTH.items()]
    + [f"select store_id, '{section}', '{k}', '{name}', round({v}, 4) from x" for (section, name), values in _STEP.items() for k, v in values.items()]
)


@_query("h3_grid_choice")
def h3(spark, sf_dir):
    """Of each store's items, as points of a grid, the one of least stock that is served well enough."""
    rows = _priced(spark, sf_dir).groupBy("store_id", F.col("item_id").cast("int").alias("place")).agg(F.try_divide(F.sum("sold"), F.sum("demand")).alias("fill_rate"), F.avg("on_hand").alias("mean_on_hand"))
    return scenarios.choose(_rounded(rows, "fill_rate", "mean_on_hand"), ["store_id"], P.service_target)


_GRID = "grid as (select store_id, cast(item_id as integer) place, round(sum(sold) / nullif(sum(demand), 0), 6) fill_rate, round(avg(on_hand), 6) mean_on_hand from priced group by 1, 2)"
ORACLE_SQL["h3_grid_choice"] = _LEDGER + (
    f", {_GRID}, o as (select *, coalesce(fill_rate >= {P.service_target}, false) meets from grid), r as (select *, row_number() over (partition by store_id order by meets desc, case when meets then mean_on_hand else -coalesce(fill_rate, 0) end, place) k from o) "
    "select store_id, place, fill_rate, mean_on_hand, meets from r where k = 1"
)


@_query("h7_h15_equal_service")
def h7(spark, sf_dir):
    """Each store's item whose service is nearest to that of the recalibrated scenario, its number over 100 as alpha, beside that scenario."""
    rows = _priced(spark, sf_dir).groupBy("store_id", (F.col("item_id").cast("int") / 100).alias("alpha")).agg(F.try_divide(F.sum("sold"), F.sum("demand")).alias("service_level"), F.avg(F.col("on_hand") * F.col("cost")).alias("mean_capital"))
    base = _scenario_money(spark, sf_dir).filter("scenario = 'recalibrated'")
    found = scenarios.closest(_rounded(_rounded(rows, "service_level"), "mean_capital", places=4), base, ["store_id"])
    beside = found.join(base.select("store_id", F.col("mean_capital").alias("b")), "store_id").withColumn("capital_vs_baseline_pct", (F.try_divide("mean_capital", "b") - 1) * 100).drop("b")
    return _rounded(beside, "distance_pp", "capital_vs_baseline_pct", places=3)


ORACLE_SQL["h7_h15_equal_service"] = _SCENARIOS + (
    ", pts_ as (select store_id, cast(item_id as integer) / 100 alpha, round(sum(sold) / nullif(sum(demand), 0), 6) service_level, round(avg(on_hand * cost), 4) mean_capital from priced group by 1, 2), "
    "r as (select p.*, b.service_level goal, b.mean_capital bc, row_number() over (partition by p.store_id order by round(abs(p.service_level - b.service_level), 12), alpha) k from pts_ p join scen b on b.store_id = p.store_id and scenario = 'recalibrated' where p.service_level is not null) "
    "select store_id, alpha, service_level, mean_capital, round((service_level - goal) * 100, 3) distance_pp, round((mean_capital / nullif(bc, 0) - 1) * 100, 3) capital_vs_baseline_pct from r where k = 1"
)


@_query("y2_order_variation")
def y2(spark, sf_dir):
    return _rounded(reporting.order_variation(written(r1(spark, sf_dir)), P.variation_days, P.variation_factor), "recent", places=6)


ORACLE_SQL["y2_order_variation"] = _LEDGER + (
    ', o as (select store_id, item_id, date, round("order", 4) "order" from ledger), '
    f'w as (select *, avg(case when "order" > 0 then "order" end) over (partition by store_id, item_id order by date range between interval {P.variation_days} day preceding and interval 1 day preceding) recent from o) '
    f'select store_id, item_id, date, "order", round(recent, 6) recent, coalesce("order" > {P.variation_factor} * recent, false) flagged from w where "order" > 0'
)
