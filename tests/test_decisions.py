import datetime as dt

import pytest
from larder.operators import calendar, contracts, forecast, guards, selection
from pyspark.sql import types as T

DAY = dt.date(2020, 3, 2)


def test_schema_findings_come_at_once(spark):
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType()), T.StructField("d", T.LongType())])
    df = spark.createDataFrame([(1, 2, 1.5, "x")], "a long, b long, d double, e string")
    assert contracts.schema_findings(df, want) == [("missing", "c", "string"), ("undeclared", "e", "string"), ("type", "d", "double where bigint is expected")]
    counts = contracts.column_findings(df, ["a"], {"b": 3.0}, {"e": ["y"]})
    with pytest.raises(ValueError, match="c: missing.*d: type.*b: bound.*e: values"):
        contracts.require("sales", contracts.schema_findings(df, want), counts)
    contracts.require("sales", [], contracts.column_findings(df, ["a"], {}, {}))


def test_cadence(spark):
    df = spark.createDataFrame([("a", [1, 4]), ("b", [1]), ("c", [7, 1, 1]), ("d", [1, 2, 3, 4, 5, 6, 7])], "id string, days array<long>")
    gaps = {r.id: r.g for r in df.select("id", contracts.largest_cyclic_gap(df.days).alias("g")).collect()}
    assert gaps == {"a": 4, "b": 7, "c": 6, "d": 1}
    assert [r.id for r in contracts.array_findings(df, "days", 2, 1, 5).selectExpr("concat(n_short, ' ', n_out_of_bounds) id").collect()] == ["1 2"]


def test_holidays(spark):
    rows = [(DAY, "Holiday", "National", "All", True), (DAY, "Event", "National", "All", False), (DAY, "Bridge", "Regional", "s1", False), (DAY, "Work Day", "Local", "c1", False), (DAY, "Transfer", "Local", "c2", False)]
    holidays = spark.createDataFrame(rows, "date date, type string, locale string, locale_name string, transferred boolean")
    days = spark.createDataFrame([(1, DAY, "s1", "c1"), (2, DAY, "s2", "c2"), (3, DAY + dt.timedelta(1), "s1", "c2")], "store_nbr long, date date, state string, city string")
    got = {r.store_nbr: tuple(r)[4:] for r in calendar.holiday_flags(days, holidays).collect()}
    assert got == {1: (False, True, False), 2: (False, False, True), 3: (False, False, False)}


def _candidates(spark, rows, budget):
    return spark.createDataFrame([(0, "1", *r, float(budget)) for r in rows], "scenario int, store_id string, item_id string, category string, value double, margin double, budget double")


def test_category_floor(spark):
    rows = [("M1", "MEATS", 200.0, 0.05), ("M2", "MEATS", 200.0, 0.08), ("M3", "MEATS", 100.0, 0.12), ("B1", "BEVERAGES", 300.0, 0.9), ("B2", "BEVERAGES", 300.0, 0.85), ("B3", "BEVERAGES", 300.0, 0.8)]
    got = {r.item_id: (r.kept, r.case_) for r in guards.cash_rule(_candidates(spark, rows, 950), 0.6).collect()}
    assert got["M2"] == got["M3"] == (True, "floor") and not got["M1"][0]
    # 300 of 900 are headroom: the worst of B; 600 of B and 300 of M are protected, and what is left holds neither
    assert {k: got[k][0] for k in ("B1", "B2", "B3")} == {"B1": True, "B2": True, "B3": False}
    flags = {r.item_id: (r.cash_flag, r.shortfall) for r in guards.cash_rule(_candidates(spark, rows, 950), 0.6).collect()}
    assert flags == {"M1": ("reduced", None), "M2": ("protected by the floor", None), "M3": ("protected by the floor", None), "B1": (None, None), "B2": (None, None), "B3": ("reduced", None)}


def test_floor_shortfall_grants_whole_categories(spark):
    got = {r.item_id: (r.kept, r.case_) for r in guards.cash_rule(_candidates(spark, [("a", "A", 600.0, 0.2), ("b", "B", 500.0, 0.1)], 800), 1.0).collect()}
    assert got == {"a": (True, "shortfall"), "b": (False, "shortfall")}
    assert {r.shortfall for r in guards.cash_rule(_candidates(spark, [("a", "A", 600.0, 0.2), ("b", "B", 500.0, 0.1)], 800), 1.0).collect()} == {300.0}
    # a category that does not fit is passed over
    got = {r.item_id: r.kept for r in guards.cash_rule(_candidates(spark, [("a", "A", 900.0, 0.3), ("b", "B", 500.0, 0.2), ("c", "C", 200.0, 0.1)], 800), 1.0).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_relative_mae(spark):
    def mae(forecasts, masked=None):
        rows = [("1", 10.0, f, r, 1.0, m) for f, r, m in zip(forecasts, (10.0, 0.0, 20.0, 30.0), masked or [None] * 4, strict=True)]
        return forecast.error_metrics(spark.createDataFrame(rows, "store_id string, actual double, point double, rival double, unit_value double, masked boolean")).first().relative_mae

    assert mae([12.0, 8.0, 13.0, 14.0]) == pytest.approx(0.275)
    assert mae([12.0, 8.0, 13.0, 14.0], [False, None, True, False]) == pytest.approx(8 / 30)
    assert mae([12.0, None, 13.0, 14.0]) == pytest.approx(0.3)


def test_selection_looks_no_further_than_its_slice():
    with pytest.raises(ValueError):
        selection.no_leakage(DAY, DAY)


def test_seasonal_rival_and_crossing(spark):
    rows = [("1", "a", DAY + dt.timedelta(k), float(k)) for k in range(14) if k != 3]
    got = {(r.date - DAY).days: r.rival for r in forecast.seasonal_rival(spark.createDataFrame(rows, "store_id string, item_id string, date date, units_sold double"), 3).collect()}
    assert got[7] == 0 + 1 + 2 and got[8] is None and got[11] == 4 + 5 + 6
    q = spark.createDataFrame([("1", "a", 0.1, 5.0), ("1", "a", 0.5, 3.0), ("1", "b", 0.1, 1.0), ("1", "b", 0.5, 1.0)], "store_id string, item_id string, quantile double, value double")
    assert sorted(map(tuple, forecast.non_crossing(q).collect())) == [("1", "a", 0.1, 3.0, True), ("1", "a", 0.5, 5.0, True), ("1", "b", 0.1, 1.0, False), ("1", "b", 0.5, 1.0, False)]
