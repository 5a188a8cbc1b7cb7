"""Registered queries of the purchase list and its steps, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast, ordering, panel, purchasing
from ..params import PARAMS as P
from ..sources.intermediate import shared_dir, written
from ..sources.retail import raw_items, raw_sales
from .replenishment import _LEDGER, _WEEKLY, _WEEKLY_Q, ORACLE_SQL, _economics, _ledger, _weekly_quantiles
from .retail import _POINTS, _panel, _query, _rounded

_PAIR = ["store_id", "item_id"]
_RISK = P.lead_days + P.review_days
_BUDGET = P.weekly_budget * P.review_days / 7


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.suppliers(raw_items(raw_sales(spark, sf_dir)), P.lead_days, P.review_days, P.order_days, 0.0, P.least_units)
    days = F.coalesce(*(F.when(F.col("supplier_id") == s, F.array(*(F.lit(d).cast("long") for d in own))) for s, own in P.supplier_days), F.col("order_days"))
    return made.select("supplier_id", days.alias("order_days"), F.col("min_order_units").alias("least_units"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every pair wants at as_of: the target level of the weekly forecast less the position, which is made from the pair's numbers, as the tables hold no stock."""
    history = written(_panel(spark, sf_dir))
    item, store = F.col("item_id").cast("long"), F.col("store_id").cast("long")
    level = _weekly_quantiles(spark, sf_dir, history).filter(F.col("quantile") == P.quantiles[-1]).select(*_PAIR, F.round("value", 6).alias("level"))
    recent = F.col("date").between(F.date_sub(F.lit(P.as_of), P.demand_days), F.date_sub(F.lit(P.as_of), 1))
    daily = history.filter(recent).groupBy(*_PAIR).agg(F.avg("units_sold").alias("mean"))
    rows = level.withColumn("position", ((item * 13 + store * 7) % 20).cast("double")).join(daily, _PAIR, "left").withColumn("daily", F.round(F.coalesce("mean", F.lit(0.0)), 6)).drop("mean")
    bought = purchasing.recent_purchases(_ledger(spark, sf_dir), P.as_of, P.variation_days)
    new = ordering.new_items(history, P.as_of, P.new_history_days, P.new_sale_days)
    economics = _economics(spark, sf_dir).select("item_id", F.round("cost", 6).alias("unit_cost"), "margin")
    items = raw_items(raw_sales(spark, sf_dir)).select(F.col("item_nbr").cast("string").alias("item_id"), F.col("family").alias("category"), panel.supplier_slug(F.col("family")).alias("supplier_id"))
    rows = rows.join(bought, _PAIR, "left").fillna(0.0, ["recent_purchase"]).join(new, _PAIR).join(economics, "item_id").join(items, "item_id").join(_suppliers(spark, sf_dir), "supplier_id")
    order, _ = ordering.target_order(F.col("level"), F.col("position"))
    terms = spark.createDataFrame(list(P.category_terms), "category string, pack double, least_value double, shelf_life double")
    return written(purchasing.with_category_terms(rows.withColumns({"desired": order, "risk_window": F.lit(_RISK)}), terms))


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = _decisions(spark, sf_dir)
    budget = decisions.select("store_id").distinct().withColumn("budget", purchasing.cycle_budget(P.weekly_budget, P.review_days))
    return purchasing.purchase_list(decisions, P.as_of, P.variation_factor, P.most_packs, budget, P.floor_share)


_TERMS = "terms(category, pack, least_value, shelf) as (values " + ", ".join(f"('{c}', cast({p} as double), cast({v} as double), cast({d} as double))" for c, p, v, d in P.category_terms) + ")"
_OPEN = "case supplier_id " + " ".join(f"when '{s}' then {str(P.as_of.isoweekday() in own).lower()}" for s, own in P.supplier_days) + f" else {str(P.as_of.isoweekday() in P.order_days).lower()} end"
_NEXT = lambda days: min((d - P.as_of.isoweekday() - 1) % 7 + 1 for d in days)
_AHEAD = "case supplier_id " + " ".join(f"when '{s}' then {_NEXT(own)}" for s, own in P.supplier_days) + f" else {_NEXT(P.order_days)} end"
_STEPS = _LEDGER.replace("with ", "with recursive ", 1) + f""", {_POINTS}, {_WEEKLY}, {_WEEKLY_Q}, {_TERMS},
bought as (select store_id, item_id, coalesce(avg(case when "order" > 0 then "order" end), 0) recent from ledger where date between date '{P.as_of}' - {P.variation_days} and date '{P.as_of}' - 1 group by 1, 2),
d28 as (select store_id, item_id, avg(units_sold) m from panel where date between date '{P.as_of}' - {P.demand_days} and date '{P.as_of}' - 1 group by 1, 2),
fresh as (select store_id, item_id, coalesce(date '{P.as_of}' - min(case when units_sold > 0 then date end) < {P.new_history_days}, true) or count(*) filter (where units_sold > 0) < {P.new_sale_days} is_new from panel where date < date '{P.as_of}' group by 1, 2),
dec as (select q.store_id, q.item_id, round(q.v, 6) lvl, cast((cast(q.item_id as bigint) * 13 + cast(q.store_id as bigint) * 7) % 20 as double) pos, round(coalesce(m, 0), 6) daily, coalesce(recent, 0) recent, is_new, e.category, round(e.cost, 6) as unit_cost, margin_share margin, 'SUP-' || replace(e.category, ' ', '_') supplier_id, pack, least_value, shelf
  from wq q left join d28 using (store_id, item_id) left join bought using (store_id, item_id) join fresh using (store_id, item_id) join eco e using (item_id) join terms using (category) where q.quantile = {P.quantiles[-1]}),
w1 as (select *, greatest(lvl - pos, 0) want, greatest(0, greatest(shelf, {_RISK}) * daily - pos) most, greatest(0, shelf * daily - pos) of_shelf from dec),
w2 as (select *, daily > 0 and want > 0 and want > most cut, daily > 0 and want > 0 and shelf < {_RISK} and want > of_shelf conflict, round(case when daily > 0 and want > 0 and want > most then most else want end, 6) capped from w1),
med as (select store_id, category, median(capped) m from w2 where not is_new group by 1, 2), meds as (select store_id, median(capped) m from w2 where not is_new group by 1),
g as (select w2.*, round(case when is_new then coalesce(med.m, meds.m, 0) else capped end, 6) qty, not is_new and (cut or conflict) f1, not is_new and recent > 0 and capped > {P.variation_factor} * recent f2 from w2 left join med using (store_id, category) left join meds using (store_id)),
open_ as (select *, case when qty <= 0 then 0.0 else ceil(round(qty / pack, 9)) * pack end q0 from g where {_OPEN}),
tt as (select store_id, supplier_id, sum(q0 * unit_cost) v, sum(q0) u, max(least_value) lv from open_ group by 1, 2),
tm as (select *, (lv <= 0 or round(v, 6) >= lv) and round(u, 6) >= {P.least_units} met0 from tt),
pk as (select o.*, v, u, lv, k, (pos + q0 + k * pack) / daily covered from open_ o join tm using (store_id, supplier_id), generate_series(0, {P.most_packs - 1}) s(k) where not met0 and daily > 0),
rk as (select store_id, supplier_id, item_id, row_number() over w rk, (lv <= 0 or v + sum(pack * unit_cost) over w >= lv) and u + sum(pack) over w >= {P.least_units} met from pk window w as (partition by store_id, supplier_id order by covered, item_id, k rows unbounded preceding)),
fs as (select store_id, supplier_id, min(rk) filter (where met and rk <= {P.most_packs}) hit from rk group by 1, 2),
ad as (select store_id, supplier_id, item_id, count(*) n from rk join fs using (store_id, supplier_id) where rk <= coalesce(hit, {P.most_packs}) group by 1, 2, 3),
o1 as (select o.*, coalesce(n, 0) added, case when met0 then 'placed' when hit is not null then 'filled' else 'deferred' end outcome from open_ o join tm using (store_id, supplier_id) left join fs using (store_id, supplier_id) left join ad using (store_id, supplier_id, item_id)),
o2 as (select *, case when outcome = 'deferred' then 0.0 else q0 + added * pack end ord from o1), o3 as (select *, round(ord * unit_cost, 6) value from o2),
k1 as (select *, sum(value) over (partition by store_id, category order by margin, item_id rows unbounded preceding) <= {1 - P.floor_share} * sum(value) over (partition by store_id, category) hr from o3 where ord > 0),
k2 as (select *, sum(value) over (partition by store_id) total, sum(case when not hr then value else 0 end) over (partition by store_id) prot, sum(value) over (partition by store_id, hr order by margin desc, item_id rows unbounded preceding) spent,
  sum(value) over (partition by store_id order by margin desc, item_id rows unbounded preceding) <= {_BUDGET} alone from k1),
kc as (select store_id, category, sum(case when not hr then value else 0 end) p, row_number() over (partition by store_id order by sum(value * margin) / sum(value) desc, category) k from k1 group by 1, 2),
walk as (select distinct store_id, cast(0 as bigint) k, cast({_BUDGET} as double) room, cast(null as varchar) got from kc union all
  select w.store_id, c.k, case when c.p <= w.room then w.room - c.p else w.room end, case when c.p <= w.room then c.category end from walk w join kc c on c.store_id = w.store_id and c.k = w.k + 1),
k3 as (select k2.store_id, item_id, hr, alone, case when total <= {_BUDGET} then true when prot > {_BUDGET} then not hr and w.got is not null else not hr or spent <= {_BUDGET} - prot end kept from k2 left join walk w on w.store_id = k2.store_id and w.got = k2.category),
l1 as (select o3.*, case when not coalesce(kept, true) then 0.0 else ord end fo, case when not coalesce(kept, true) then 0.0 else value end fv,
  list_filter([case when f1 then 'coverage cap' end, case when f2 then 'order variation' end, case when is_new then 'new item' end, case when added > 0 then 'filled to minimum' end, case when outcome = 'deferred' and q0 + added > 0 then 'deferred' end,
    case when kept is not null and not kept then 'cash: reduced' when kept and not hr and not alone then 'cash: protected by the floor' end], lambda x: x is not null) flags from o3 left join k3 using (store_id, item_id)),
listed as (select store_id, supplier_id, item_id, category, case when len(flags) > 0 then 'exceptions' else 'main' end section, outcome, fo final_order, fo / pack packs, pos "position", case when daily > 0 then (pos + fo) / daily end coverage_days, fv final_value, margin, flags,
  outcome <> 'deferred' and ((least_value > 0 and round(sum(fv) over (partition by store_id, supplier_id), 6) < least_value) or round(sum(fo) over (partition by store_id, supplier_id), 6) < {P.least_units}) below_minimum, date '{P.as_of}' + {_AHEAD} next_order_day from l1) """
_SHOWN = "store_id, supplier_id, item_id, category, section, outcome, round(final_order, 6) final_order, round(packs, 6) packs, \"position\", round(coverage_days, 6) coverage_days, round(final_value, 6) final_value, margin, array_to_string(flags, '; ') flags, below_minimum, next_order_day"


@_query("i10_purchase_list")
def i10(spark, sf_dir):
    """All stores' purchase lists at as_of, end to end."""
    return _rounded(_list(spark, sf_dir), "final_order", "packs", "coverage_days", "final_value").withColumn("flags", F.array_join("flags", "; "))


ORACLE_SQL["i10_purchase_list"] = _STEPS + f"select {_SHOWN} from listed"


@_query("s15_list_by_supplier")
def s15(spark, sf_dir):
    """The list, written by supplier and section, and its sections counted as they are read back."""
    path = f"{shared_dir(spark)}/purchase-list-{uuid.uuid4().hex}"
    purchasing.write_list(_list(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return _rounded(back.groupBy("supplier_id", "section").agg(F.count("*").alias("n"), F.sum("final_value").alias("value")), "value", places=4)


ORACLE_SQL["s15_list_by_supplier"] = _STEPS + "select supplier_id, section, count(*) n, round(sum(final_value), 4) as \"value\" from listed group by 1, 2"


@_query("y10_firing_counts")
def y10_counts(spark, sf_dir):
    return purchasing.firing_counts(_list(spark, sf_dir))


ORACLE_SQL["y10_firing_counts"] = _STEPS + (
    "select r as \"rule\", case when s = 'built' then (select count(*) from (select unnest(flags) f from listed) where case when f like 'cash: %' then 'cash' else f end = r) end n, s status from (values "
    + ", ".join(f"('{r}', '{'not built' if r in purchasing.NOT_BUILT else 'built'}')" for r in purchasing.RULES) + ") t(r, s)"
)


@_query("g5_order_adjustments")
def g5(spark, sf_dir):
    """Why each order differs from what was wanted, a row per reason; suppliers that are closed have none."""
    _, said = purchasing.supplier_orders(written(purchasing.guarded(_decisions(spark, sf_dir), P.variation_factor)), P.as_of, P.most_packs)
    return _rounded(said, "delta_units")


ORACLE_SQL["g5_order_adjustments"] = _STEPS + (
    "select store_id, supplier_id, item_id, 'pack rounding' reason, round(q0 - qty, 6) delta_units from o2 where q0 <> qty union all select store_id, supplier_id, item_id, 'filled to minimum', round(added * pack, 6) from o2 where added > 0 "
    "union all select store_id, supplier_id, item_id, 'deferred', round(-(q0 + added * pack), 6) from o2 where outcome = 'deferred' and q0 + added * pack > 0"
)


@_query("g1_order_gate")
def g1(spark, sf_dir):
    """Orders of all suppliers: those that are closed at as_of have empty orders, their outcome and the next day on which they are open."""
    orders, _ = purchasing.supplier_orders(written(purchasing.guarded(_decisions(spark, sf_dir), P.variation_factor)), P.as_of, P.most_packs)
    return _rounded(orders.select("store_id", "supplier_id", "item_id", "outcome", "order", "next_order_day"), "order")


ORACLE_SQL["g1_order_gate"] = _STEPS + f"select store_id, supplier_id, item_id, coalesce(outcome, 'closed') outcome, round(coalesce(ord, 0), 6) as \"order\", date '{P.as_of}' + {_AHEAD} next_order_day from g left join (select store_id, item_id, outcome, ord from o2) using (store_id, item_id)"


@_query("g6_alignment")
def g6(spark, sf_dir):
    """Pairs that one of the inputs of orders lacks: pairs with demand lately, with a forecast, and with an order placed lately."""
    history = written(_panel(spark, sf_dir))
    before = F.col("date").between(F.date_sub(F.lit(P.as_of), P.review_days), F.date_sub(F.lit(P.as_of), 1))
    demand = history.filter(before & (F.col("units_sold") > 0))
    levels = forecast.naive_points(history, P.naive_weeks, P.horizon).filter((F.col("date") == F.lit(P.as_of)) & (F.col("point") > 0))
    orders = _ledger(spark, sf_dir).filter(before & F.col("order").isNotNull())
    return purchasing.alignment_findings({"demand": demand, "forecast": levels, "orders": orders}, _PAIR)


ORACLE_SQL["g6_alignment"] = _LEDGER + (
    f", {_POINTS}, h as (select distinct store_id, item_id, 'demand' s from panel where date between date '{P.as_of}' - {P.review_days} and date '{P.as_of}' - 1 and units_sold > 0 union select store_id, item_id, 'forecast' from pts where date = date '{P.as_of}' and point > 0 "
    f"union select store_id, item_id, 'orders' from ledger where date between date '{P.as_of}' - {P.review_days} and date '{P.as_of}' - 1 and \"order\" is not null) "
    "select k.store_id, k.item_id, s.s missing_from from (select distinct store_id, item_id from h) k cross join (values ('demand'), ('forecast'), ('orders')) s(s) where not exists (select 1 from h where h.store_id = k.store_id and h.item_id = k.item_id and h.s = s.s)"
)

