"""Registered queries of the data-quality report with examples, table differences with samples, and the comparison of methods, with DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.columns import is_fractional
from ..operators import features, forecast, panel, quality
from ..params import PARAMS as P
from ..sources.intermediate import shared_dir, written
from .replenishment import _LEDGER, _WEEKLY, ORACLE_SQL, _lines
from .reporting import _NO_SALE
from .retail import _panel, _query, _rounded

_PAIR = ["store_id", "item_id"]


def _units(history):
    """The unit of sale that each store's sales of an item show."""
    return history.groupBy(*_PAIR).agg(F.when(F.max(is_fractional(F.col("units_sold")).cast("int")) == 1, "kg").otherwise("unidade").alias("unit_of_sale"))


def _packs(history):
    """A registry without packs for every seventh item, and for one store's rows of every fifth."""
    n = F.col("item_id").cast("long")
    return history.select(*_PAIR).distinct().withColumn("pack_multiple", F.when(~((n % 7 == 0) | ((n % 5 == 0) & (F.col("store_id") == "1"))), 6.0))


_QUALITY = f"""{_LEDGER}, q1 as (select item_id, cast(null as date) date, string_agg(distinct u, ' | ' order by u) v from (select store_id, item_id, case when bool_or(units_sold <> round(units_sold)) then 'kg' else 'unidade' end u from panel group by 1, 2) group by 1 having count(distinct u) > 1),
q2 as (select item_id, shipped date, shipped || ' < ' || ordered v from lines where shipped < ordered),
q3 as (select item_id, date, cast(units_returned as varchar) v from (select *, {_NO_SALE} n from panel) where units_returned > 0 and n = 0),
reg as (select *, avg(cast(units_sold > 0 as double)) over (partition by store_id, item_id order by date range between interval {P.regular_days} day preceding and interval 1 day preceding) m, count(*) over (partition by store_id, item_id order by date range between interval {P.regular_days} day preceding and interval 1 day preceding) n from panel),
q4 as (select item_id, date, '0' v from reg where units_sold = 0 and n = {P.regular_days} and m >= {P.regular_share}),
act as (select distinct item_id from panel where date > (select max(date) from panel) - {P.regular_days} and units_sold > 0),
pk as (select item_id, bool_or(not (cast(item_id as bigint) % 7 = 0 or (cast(item_id as bigint) % 5 = 0 and store_id = '1'))) has from (select distinct store_id, item_id from panel) group by 1),
q5 as (select item_id from pk join act using (item_id) where not has)
select *, share > {P.critical_share} or coalesce(1 - share < least, false) critical from (
  select name "check", 'evaluated' status, cast(null as varchar) reason, base base_rows, n, round(case when base > 0 then n / base else 0 end, 6) share, cast(least(n, 5) as integer) n_examples, least from (
    select 'divergent unit' as name, (select count(*) from (select distinct store_id, item_id from panel)) base, (select count(*) from q1) n, cast(null as double) least
    union all select 'receipt before order', (select count(*) from lines), (select count(*) from q2), null union all select 'return without sale', (select count(*) from panel), (select count(*) from q3), null
    union all select 'zero day in regular item', (select count(*) from panel), (select count(*) from q4), null union all select 'no pack', (select count(*) from act), (select count(*) from q5), {P.least_complete}))
union all select 'divergent description', 'not evaluated', 'items have no descriptions', null, null, null, null, null, false"""


@_query("d7_report_with_examples")
def d7_report(spark, sf_dir):
    history, lines = written(_panel(spark, sf_dir)), written(_lines(spark, sf_dir))
    entries = lines.select("store_id", "item_id", F.col("shipped").alias("received_date"), F.col("q").alias("quantity"), F.col("ordered").alias("order_date"))
    units, packs = _units(history), _packs(history)
    known, gaps = quality.registry_gaps(packs, quality.active_items(history, P.regular_days))
    returns = quality.returns_without_sale(history, P.return_days).select("item_id", "date", F.col("units_returned").cast("string").alias("value"))
    zero = quality.regular_zero_days(history, P.regular_days, P.regular_share)
    checks = [
        quality.Check("divergent description", reason="items have no descriptions"), quality.Check("divergent unit", quality.divergent_units(units, "item_id", "unit_of_sale"), units),
        quality.Check("receipt before order", quality.receipts_before_orders(entries), entries), quality.Check("return without sale", returns, history), quality.Check("zero day in regular item", zero, history),
        quality.Check("no pack", gaps, known, least_sound=P.least_complete),
    ]
    path = f"{shared_dir(spark)}/quality-{uuid.uuid4().hex}"
    quality.write_report(spark, checks, P.critical_share, path)
    found = spark.read.parquet(f"{path}/summary")
    return _rounded(found.withColumn("n_examples", F.when(F.col("examples").isNotNull(), F.size("examples"))).drop("examples"), "share")


ORACLE_SQL["d7_report_with_examples"] = f"select * exclude (least) from ({_QUALITY})"


@_query("d8_diff_samples")
def d8_samples(spark, sf_dir):
    """The panel against itself with a column less and one more, other units in one store and a day less."""
    history = written(_panel(spark, sf_dir).select(*panel.KEYS, "units_sold", "on_promo", "is_anomaly"))
    other = history.filter(F.col("date") > F.lit(P.window_start)).withColumn("units_sold", F.when((F.col("store_id") == "2") & (F.col("units_sold") > 0), F.col("units_sold") + 1).otherwise(F.col("units_sold"))).drop("is_anomaly").withColumn("own", F.lit(1))
    found = quality.diff_samples(history, other, panel.KEYS)
    return found.select("what", "n", F.size("samples").alias("n_samples"))


ORACLE_SQL["d8_diff_samples"] = _LEDGER + (
    f"select what, n, cast(least(n, 5) as integer) n_samples from (select 'row only in expected' what, count(*) n from panel where date = date '{P.window_start}' union all select 'units_sold', count(*) from panel where date > date '{P.window_start}' and store_id = '2' and units_sold > 0) where n > 0 "
    "union all select 'column only in expected: is_anomaly', null, null union all select 'column only in actual: own', null, null"
)

_TEST_START = P.as_of - timedelta(P.test_days)
_CENSORED = f"""past as (select *, avg(units_sold) over w m, count(*) filter (where units_sold > 0) over w k from panel window w as (partition by store_id, item_id order by date range between interval {P.censor_window} day preceding and interval 1 day preceding)),
marked as (select store_id, item_id, date, units_sold, coalesce(units_sold = 0 and m >= {P.censor_mean} and k >= {P.censor_sale_days}, false) cens from past), hist as (select store_id, item_id, date, units_sold from marked where not cens)"""


@_query("q7_methods_by_demand_class")
def q7(spark, sf_dir):
    """Three methods at weekly origins of the test window, on the same uncensored history, scored by demand class where no day of the window is censored."""
    days = _panel(spark, sf_dir).select(*panel.KEYS, "units_sold")
    flags = panel.probable_stockouts(days, P.censor_window, P.censor_mean, P.censor_sale_days)
    marked = written(days.join(flags.select(*panel.KEYS, "is_censored"), panel.KEYS))
    history = marked.filter("not is_censored").drop("is_censored")
    classes = forecast.demand_classes(history, _TEST_START, P.class_interval, P.class_variation)
    dates = F.sequence(F.lit(_TEST_START), F.lit(P.as_of - timedelta(P.horizon)), F.expr(f"interval {P.origin_days} days"))
    asked = features.at_dates(classes.select(*_PAIR), dates).withColumn("horizon", F.lit(P.horizon))
    # the origin's own row stands for its decision, whether or not it is censored
    at = asked.select(*_PAIR, F.col("as_of").alias("date"))
    probed = written(history.join(at, panel.KEYS, "left_anti").unionByName(at.withColumn("units_sold", F.lit(None).cast("double"))))
    erp = forecast.naive_points(probed, P.naive_weeks, P.horizon).select(*panel.KEYS, F.col("point").alias("erp"))
    weekly = forecast.weekly_points(probed, P.season_weeks, P.level_weeks, P.horizon).select(*panel.KEYS, F.col("point").alias("weekly"))
    rival = forecast.seasonal_rival(probed, P.horizon).select(*panel.KEYS, F.col("rival").alias("seasonal"))
    points = at.join(erp, panel.KEYS).join(weekly, panel.KEYS).join(rival, panel.KEYS).withColumnRenamed("date", "as_of")
    masked = features.window_targets(marked.select(*panel.KEYS, F.col("is_censored").cast("double").alias("units_sold")), asked).select(*_PAIR, "as_of", (F.col("target") > 0).alias("masked"))
    rows = points.join(features.window_targets(marked.select(*panel.KEYS, "units_sold"), asked), [*_PAIR, "as_of"]).join(masked, [*_PAIR, "as_of"]).join(classes, _PAIR)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("point")) for m in ("erp", "weekly", "seasonal"))))
    long = rows.select(*_PAIR, "as_of", "demand_class", "masked", F.col("target").alias("actual"), (5 + F.col("item_id").cast("long") % 10).cast("double").alias("unit_value"), each.alias("e")).select("*", "e.*").drop("e")
    return _rounded(forecast.methods_compared(long, "seasonal"), "relative_mae", "wape", "bias")


_PROBED = f"""{_CENSORED}, cls as (select store_id, item_id, case when count(*) filter (where units_sold > 0) = 0 then 'none' when round(var_pop(units_sold) filter (where units_sold > 0) / pow(avg(units_sold) filter (where units_sold > 0), 2), 9) >= {P.class_variation} then 'erratic'
  when round(count(*) / count(*) filter (where units_sold > 0), 9) >= {P.class_interval} then 'intermittent' else 'regular' end demand_class from hist where date < date '{_TEST_START}' group by 1, 2),
ask as (select store_id, item_id, cast(d as date) date from cls cross join generate_series(date '{_TEST_START}', date '{P.as_of - timedelta(P.horizon)}', interval {P.origin_days} day) t(d)),
probed as (select * from hist h where not exists (select 1 from ask a where a.store_id = h.store_id and a.item_id = h.item_id and a.date = h.date) union all select store_id, item_id, date, null from ask)"""


ORACLE_SQL["q7_methods_by_demand_class"] = _LEDGER + (
    f", {_PROBED}, {_WEEKLY.replace('from panel', 'from probed')}, other as (select store_id, item_id, date, coalesce(avg(units_sold) over a, 0) * {P.horizon} erp, case when count(*) over b = {P.horizon} then sum(units_sold) over b end seasonal from probed "
    f"window a as (partition by store_id, item_id order by date range between interval {7 * P.naive_weeks} day preceding and interval 1 day preceding), b as (partition by store_id, item_id order by date range between interval 7 day preceding and interval {8 - P.horizon} day preceding)), "
    f"t as (select a.store_id, a.item_id, a.date, coalesce(sum(m.units_sold), 0) actual, coalesce(bool_or(cens), false) masked from ask a left join marked m on m.store_id = a.store_id and m.item_id = a.item_id and m.date between a.date and a.date + {P.horizon - 1} group by 1, 2, 3), "
    "r as (select t.*, demand_class, erp, w.point weekly, seasonal, cast(5 + cast(t.item_id as bigint) % 10 as double) v from t join cls using (store_id, item_id) join other using (store_id, item_id, date) join weekly w using (store_id, item_id, date) where not masked and seasonal is not null), "
    "l as (select demand_class, 'erp' as method, erp p, seasonal s, actual, v from r union all select demand_class, 'weekly', weekly, seasonal, actual, v from r union all select demand_class, 'seasonal', seasonal, seasonal, actual, v from r) "
    'select demand_class, method, count(*) n, round(sum(abs(p - actual)) / nullif(sum(abs(s - actual)), 0), 6) relative_mae, round(sum(abs(p - actual) * v) / nullif(sum(actual * v), 0), 6) wape, round(sum(p - actual) / nullif(sum(actual), 0), 6) bias from l group by 1, 2'
)
