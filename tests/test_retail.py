import datetime as dt

import duckdb
import pytest
from larder.functions.columns import round_up_to_pack
from larder.operators import contracts, forecast, guards, panel, profiling
from larder.plans import learning, purchasing, quality, replenishment, reporting, retail, tables  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(retail.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = retail.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(retail.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert found == sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in cursor.fetchall())


def test_pair_density(spark):
    d = lambda m, day, y=2021: dt.date(y, m, day)
    rows = [(1, 9, d(1, 1, 2020), 1.0)] + [(1, 5, d(1, k), 1.0) for k in (1, 3, 5)]
    sales = spark.createDataFrame(rows, "store_nbr long, item_nbr long, date date, unit_sales double")
    r = profiling.pair_coverage(sales, d(1, 1), d(1, 10)).filter("item_nbr = 5").first()
    assert (r.n_days_with_sale, r.span_days, r.density_pair_span, r.density_window, r.store_covers_full_window) == (3, 5, 0.6, 0.3, True)


def test_delisted_pairs_are_cut(spark):
    rows = [(1, 1, dt.date(2021, 1, 1), 1.0), (1, 2, dt.date(2021, 5, 1), 1.0)]
    sales = spark.createDataFrame(rows, "store_nbr long, item_nbr long, date date, unit_sales double")
    got = {r.item_nbr: r.exit_date for r in panel.lifespans(sales, dt.date(2021, 1, 1), dt.date(2021, 6, 1), 90).collect()}
    assert got == {1: dt.date(2021, 4, 1), 2: dt.date(2021, 6, 1)}


def test_seasonal_naive(spark):
    values = [*range(1, 8), *range(10, 80, 10), *range(100, 800, 100)]
    first = dt.date(2020, 1, 6)
    history = spark.createDataFrame([("s", "i", first + dt.timedelta(k), float(v)) for k, v in enumerate(values)], "store_id string, item_id string, date date, units_sold double")
    as_of = first + dt.timedelta(21)
    assert [forecast.seasonal_naive(history, as_of, h).first().value for h in (3, 7, 14)] == [600, 2800, 5600]


def test_forecasts_do_not_look_ahead(spark):
    first = dt.date(2020, 1, 6)
    rows = [("s", "i", first + dt.timedelta(k), float(k % 5), None) for k in range(40)]
    schema = "store_id string, item_id string, date date, units_sold double, on_promo boolean"
    before = spark.createDataFrame(rows[:31], schema)
    after = spark.createDataFrame(rows[:30] + [(*r[:3], 999.0, True) for r in rows[30:]], schema)
    day = F.col("date") == F.lit(first + dt.timedelta(30))
    assert forecast.window_features(before, 14).filter(day).collect() == forecast.window_features(after, 14).filter(day).collect()


def test_pack_rounding(spark):
    df = spark.createDataFrame([(0.0, 6.0), (-1.0, 6.0), (12.000000000001, 6.0), (12.1, 6.0)], "q double, p double")
    assert [r.x for r in df.select(round_up_to_pack(F.col("q"), F.col("p")).alias("x")).collect()] == [0, 0, 12, 18]


def test_margin_cutoff_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("s", i, "c", v, m) for i, v, m in (("a", 50.0, 0.9), ("b", 80.0, 0.8), ("c", 10.0, 0.7))], "store_id string, item_id string, category string, value double, margin double")
    assert {r.item_id: r.kept for r in guards.margin_cutoff(df, 100.0).collect()} == {"a": True, "b": False, "c": False}


def test_findings(spark):
    df = spark.createDataFrame([(1, -1.0, "x"), (1, None, "y"), (2, 3.0, None)], "k int, v double, s string")
    got = {(r.rule, r.column_name): r.n for r in contracts.column_findings(df, ["v"], {"v": 0.0}, {"s": ["x"]}).collect()}
    assert got == {("null", "v"): 1, ("bound", "v"): 1, ("values", "s"): 1}
    assert tuple(contracts.duplicate_keys(df, ["k"]).first()) == (1, 2)
