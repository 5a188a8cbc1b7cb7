import datetime as dt

import pytest
from larder.operators import calendar, forecast, ordering
from larder.plans import replenishment
from pyspark.sql import functions as F

FIRST = dt.date(2020, 1, 6)


def test_every_query_has_sql():
    # what a model learns is beyond SQL: its trees are tested against a plain version in test_learning.py
    assert set(replenishment.QUERIES) - set(replenishment.ORACLE_SQL) <= {"m10_quantile_model", "m13_prediction_grid"} and set(replenishment.ORACLE_SQL) <= set(replenishment.QUERIES)


@pytest.mark.parametrize(("day", "expected"), [("2023-02-15", 0), ("2023-02-16", 12), ("2023-12-31", 0), ("2024-02-28", 1), ("2023-01-30", 1)])
def test_days_to_payday(spark, day, expected):
    assert spark.range(1).select(calendar.days_to_payday(F.lit(day).cast("date"), (15, -1)).alias("d")).first().d == expected


def test_payday_beyond_a_months_end_is_its_last_day(spark):
    assert spark.range(1).select(calendar.days_to_payday(F.lit("2023-02-20").cast("date"), (31,)).alias("d")).first().d == 8


def test_next_order_day_is_strictly_after(spark):
    got = [spark.range(1).select(calendar.next_order_day(F.lit(d).cast("date"), (1, 4)).alias("d")).first().d for d in ("2020-01-06", "2020-01-09", "2020-01-11")]
    assert got == [dt.date(2020, 1, 9), dt.date(2020, 1, 13), dt.date(2020, 1, 13)]


def test_weekly_pattern_is_forecast(spark):
    week = [5.0, 10.0, 15.0, 20.0, 25.0, 10.0, 5.0]
    rows = [("s", "i", FIRST + dt.timedelta(k), week[k % 7]) for k in range(57)]
    history = spark.createDataFrame(rows, "store_id string, item_id string, date date, units_sold double")
    points = {r.date: r for r in forecast.weekly_points(history, 4, 2, 7).collect()}
    assert points[FIRST + dt.timedelta(56)].point == pytest.approx(90.0)
    assert points[FIRST].level == 0 and points[FIRST].point == 0


def _orders(spark, *rows):
    return spark.createDataFrame([("s", "p", *r) for r in rows], "store_id string, supplier_id string, item_id string, quantity double, pack double, unit_cost double, daily double, position double")


def test_fill_to_minimum_takes_the_least_covered_first(spark):
    orders = _orders(spark, ("A", 0.0, 3.0, 1.0, 2.0, 0.0), ("B", 0.0, 1.0, 1.0, 1.0, 1.0))
    assert {r.item_id: (r.order, r.outcome) for r in ordering.fill_to_minimum(orders, 0, 4, 10).collect()} == {"A": (3.0, "filled"), "B": (1.0, "filled")}


def test_unreachable_minimum_defers_the_whole_order(spark):
    orders = _orders(spark, ("A", 3.0, 3.0, 1.0, 2.0, 0.0), ("B", 1.0, 1.0, 1.0, 0.0, 1.0))
    assert {(r.order, r.outcome) for r in ordering.fill_to_minimum(orders, 0, 100, 2).collect()} == {(0.0, "deferred")}
    assert {r.outcome for r in ordering.fill_to_minimum(orders, 4, 4, 2).collect()} == {"placed"}


def test_coverage_cap(spark):
    q = lambda *v: spark.range(1).select(*(c.alias(n) for c, n in zip(ordering.coverage_cap(F.lit(v[0]), F.lit(v[1]), 5, F.lit(v[2]), F.lit(v[3])), "qcx", strict=True))).first()
    assert tuple(q(100.0, 10.0, 2.0, 5.0)) == (15.0, True, False)
    assert tuple(q(8.0, 3.0, 2.0, 0.0)) == (8.0, False, True)
    assert tuple(q(8.0, 3.0, 0.0, 0.0)) == (8.0, False, False)
