import datetime as dt
import math

import pytest
from larder.operators import quality, reporting
from larder.plans import reporting as plans

FIRST = dt.date(2020, 1, 6)


def _history(spark, sold, returned):
    rows = [("s", "i", FIRST + dt.timedelta(k), float(a), float(b)) for k, (a, b) in enumerate(zip(sold, returned, strict=True))]
    return spark.createDataFrame(rows, "store_id string, item_id string, date date, units_sold double, units_returned double")


def test_every_query_has_sql():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) <= {"m10_quantile_model", "m13_prediction_grid"}


def test_returns_without_sale(spark):
    # day 0: nothing before; day 2: a sale on day 1; day 4: the sale of day 1 is 3 days ago, and its own day's sale does not count
    got = quality.returns_without_sale(_history(spark, [0, 5, 0, 0, 1], [1, 0, 1, 0, 2]), 2).collect()
    assert sorted((r.date - FIRST).days for r in got) == [0, 4]


def test_divergent_values(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None), ("c", "z")], "k string, v string")
    assert [tuple(r) for r in quality.divergent_values(rows, "k", "v").collect()] == [("a", 2, "x", "y")]


def test_table_diff(spark):
    kind = "k int, v double, w string"
    x = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, "c")], kind)
    y = spark.createDataFrame([(1, 1.0, None), (2, None, "b"), (4, 4.0, "d")], kind)
    assert {r.check: r.n_findings for r in quality.table_diff(x, y, ["k"]).collect()} == {"only in expected": 1, "only in actual": 1, "v": 0, "w": 1}
    assert all(r.n_findings == 0 for r in quality.table_diff(x, x, ["k"]).collect())


def test_no_rows_have_no_findings(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert {r.n_findings for r in quality.table_diff(none, none, ["k"]).collect()} == {0}


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([("s", 1.0, 1.0), ("s", 2.0, 2.0), ("s", 2.0, 2.0), ("s", 3.0, 9.0), ("s", None, 5.0)], "g string, x double, y double")
    got = reporting.spearman(rows, "g", "x", "y").first()
    assert got.n == 4 and got.spearman == pytest.approx(1.0)


def test_spearman_without_variance(spark):
    # every item sold on every day: one value alone, as corr() in the SQL has NaN; also of one row
    rows = [("s", 1.0, 1.0), ("s", 2.0, 1.0), ("t", 3.0, 1.0), ("t", 3.0, 2.0), ("u", 1.0, 1.0), ("v", 1.0, 2.0), ("v", 2.0, 1.0), ("v", None, 7.0), ("w", None, 1.0)]
    got = {r.g: (r.spearman, r.n) for r in reporting.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert {g: n for g, (_, n) in got.items()} == {"s": 2, "t": 2, "u": 1, "v": 2}
    assert all(math.isnan(got[g][0]) for g in "stu") and got["v"][0] == pytest.approx(-1.0)


def test_totals_of_a_month(spark):
    money = spark.createDataFrame([("s", "a", 60.0, 6.0, 3.0, 100.0, 60), ("s", "b", 30.0, 0.0, 0.0, 50.0, 60), ("t", "a", 5.0, 5.0, 0.0, 1.0, 30)], "store_id string, item_id string, margin double, stockout_cost double, loss double, mean_capital double, n_days long")
    got = {r.store_id: r for r in reporting.store_totals(money).collect()}
    assert (got["s"].margin, got["s"].monthly_margin, got["s"].monthly_stockout_cost, got["s"].monthly_loss, got["s"].capital) == (90.0, 45.0, 3.0, 1.5, 150.0)
    items = spark.createDataFrame([("a", "food", 10.0)], "item_id string, category string, price double")
    top = reporting.most_lost(money, items, 3).orderBy("store_id", "item_id").collect()
    assert [(r.store_id, r.item_id, r.category, round(r.lost_share, 6)) for r in top] == [("s", "a", "food", round(6 / 66, 6)), ("s", "b", None, 0.0), ("t", "a", "food", 0.5)]
    assert [(r.store_id, r.item_id) for r in reporting.most_lost(money, items, 1).collect()] == [("s", "a")]
    assert {r.factor: r.margin for r in reporting.margin_sensitivity(reporting.store_totals(money).filter("store_id = 's'"), (0.5, 1.0)).collect()} == {0.5: 45.0, 1.0: 90.0}


def test_order_variation(spark):
    rows = [("s", "i", FIRST + dt.timedelta(k), o) for k, o in enumerate([10.0, None, 0.0, 30.0, 25.0])]
    got = {(r.date - FIRST).days: (r.recent, r.flagged) for r in reporting.order_variation(spark.createDataFrame(rows, "store_id string, item_id string, date date, order double"), 28, 2.0).collect()}
    assert got == {0: (None, False), 3: (10.0, True), 4: (20.0, False)}
