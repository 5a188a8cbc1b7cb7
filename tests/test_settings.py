import datetime as dt

import pytest
from larder.operators import calendar, panel, quality
from larder.params import PARAMS, Params, from_values, validated

DAY = dt.date(2020, 3, 2)


def test_parameters_are_checked_at_once():
    with pytest.raises(ValueError, match="quantiles do not rise between 0 and 1; horizon is not positive; floor_share is not a share"):
        validated(Params(quantiles=(0.9, 0.5), horizon=0, floor_share=2.0))
    assert validated(PARAMS) is PARAMS


def test_parameters_from_plain_values():
    p = from_values({"as_of": "2000-06-05", "slice_end": "2000-05-31", "quantiles": [0.5, 0.9], "cash_budget": 7, "margins": [["A", 0.5]], "retrains": ["2000-01-03"]})
    assert (p.as_of, p.quantiles, p.cash_budget, p.margins, p.retrains) == (dt.date(2000, 6, 5), (0.5, 0.9), 7.0, (("A", 0.5),), (dt.date(2000, 1, 3),))
    with pytest.raises(ValueError, match="colour is no parameter; horizon cannot be 'five'; as_of cannot be 'soon'"):
        from_values({"colour": 1, "horizon": "five", "as_of": "soon"})


def test_store_locale(spark):
    stores = spark.createDataFrame([(1, "s1", "c1"), (2, "s2", "c2"), (2, "s2", "c2")], "store_nbr long, state string, city string")
    assert calendar.store_locale(stores, 1) == ("s1", "c1")
    for n, what in ((2, "several rows"), (3, "no row")):
        with pytest.raises(ValueError, match=what):
            calendar.store_locale(stores, n)
    days = spark.createDataFrame([(1, DAY), (2, DAY), (3, DAY)], "store_nbr long, date date")
    with pytest.raises(ValueError, match="2 of store 2, 0 of store 3"):
        calendar.located(days, stores)
    assert calendar.located(days.filter("store_nbr = 1"), stores).first().city == "c1"


def test_censoring_switch_and_receipts(spark):
    sales = spark.createDataFrame([("s", "i", DAY + dt.timedelta(k), u) for k, u in enumerate([5.0, 5.0, 0.0, 0.0])], "store_id string, item_id string, date date, units_sold double")
    assert panel.flags_if_active(sales, False, 14, None, None) is None
    with pytest.raises(ValueError, match="least_mean, least_days is not set"):
        panel.flags_if_active(sales, True, 14, None, None)
    got = lambda receipts, quiet=3: [(r.date - DAY).days for r in panel.flags_if_active(sales, True, 14, 1.0, 2, receipts, quiet).filter("is_censored").orderBy("date").collect()]
    came = spark.createDataFrame([("s", "i", DAY), ("s", "i", DAY), ("t", "i", DAY)], "store_id string, item_id string, received_date date")
    assert got(None) == [2, 3] and got(came) == [] and got(came, 2) == [3] and got(came, 0) == [2, 3]
    summary = {r.store_id: (r.n_censored, r.alert) for r in panel.censoring_summary(panel.probable_stockouts(sales, 14, 1.0, 2), 0.5).collect()}
    assert summary == {"s": (2, False), "TOTAL": (2, False)}
    assert {r.alert for r in panel.censoring_summary(panel.probable_stockouts(sales, 14, 1.0, 2), 0.4).collect()} == {True}


def test_quality_report_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("i", DAY, "x")], "item_id string, date date, value string")
    quality.write_report(spark, [quality.Check("a", rows, rows), quality.Check("b", reason="absent"), quality.Check("c", rows.limit(0), rows)], 0.5, f"file://{tmp_path}/r")
    assert {r.check: r.n for r in spark.read.parquet(f"file://{tmp_path}/r/summary").collect()} == {"a": 1, "b": None, "c": 0}
    assert [(r.check, r.item_id) for r in spark.read.parquet(f"file://{tmp_path}/r/occurrences").collect()] == [("a", "i")]
