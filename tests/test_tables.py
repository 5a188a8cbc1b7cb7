import datetime as dt
import json

import pytest
from larder.operators import panel, tables
from larder.params import Params
from larder.sources import canonical, raw_files, results

DAY = dt.date(2020, 1, 6)
SUPPLIERS = "supplier_id string, lead_time_days long, order_days array<long>, review_period_days long, min_order_value double, min_order_units double"


def _found(df, contract, others=None):
    return {(r.rule, r.column_name): (r.n, [json.loads(s) for s in r.samples or []]) for r in tables.findings(df, contract, others).collect()}


def test_contracts_compile_to_schemas():
    assert tables.SUPPLIERS.schema().simpleString() == "struct<supplier_id:string,lead_time_days:bigint,order_days:array<bigint>,review_period_days:bigint,min_order_value:double,min_order_units:double>"
    assert tables.SALES.schema()["date"].dataType.simpleString() == "date" and all(f.nullable for f in tables.SALES.schema())
    assert [f.name for f in tables.ENTRIES.fields if f.required] == ["store_id", "item_id", "received_date", "quantity"] and tables.ENTRIES.key == ()


def test_a_sound_table_has_no_findings(spark):
    rows = spark.createDataFrame([("s", 1, [1, 4], 7, 0.0, 0.0), ("t", 2, [7], 7, 10.0, 0.0)], SUPPLIERS)
    assert _found(rows, tables.SUPPLIERS) == {}
    tables.require(tables.findings(rows, tables.SUPPLIERS))
    assert _found(rows.limit(0), tables.SUPPLIERS) == {}


def test_all_findings_at_once(spark):
    rows = spark.createDataFrame([("s", 0, [], 7, -1.0, 0.0), ("s", 1, [0, 8], None, 0.0, 0.0), (None, 3, None, 7, 0.0, 0.0)], SUPPLIERS)
    got = _found(rows, tables.SUPPLIERS)
    assert {k: n for k, (n, _) in got.items()} == {
        ("> 0", "lead_time_days"): 1, ("size >= 1", "order_days"): 1, ("element >= 1", "order_days"): 1, ("element <= 7", "order_days"): 1, (">= 0", "min_order_value"): 1,
        ("null", "review_period_days"): 1, ("null", "order_days"): 1, ("null", "supplier_id"): 1, ("duplicate key", "supplier_id"): 2,
    }
    assert got["> 0", "lead_time_days"][1] == [{"supplier_id": "s", "lead_time_days": "0", "order_days": "[]", "review_period_days": "7", "min_order_value": "-1.0", "min_order_units": "0.0"}]
    with pytest.raises(ValueError, match="suppliers.lead_time_days: > 0 .*suppliers.supplier_id: null"):
        tables.require(tables.findings(rows, tables.SUPPLIERS))


def test_missing_undeclared_and_wrong_columns(spark):
    rows = spark.createDataFrame([("s", 1.5, 3, None, 0.0, 9)], "supplier_id string, lead_time_days double, min_order_units long, review_period_days void, min_order_value double, own int")
    got = _found(rows, tables.SUPPLIERS)
    assert {k: n for k, (n, _) in got.items()} == {("missing", "order_days"): None, ("undeclared", "own"): None, ("type: double where bigint is expected", "lead_time_days"): None, ("null", "review_period_days"): 1}


def test_samples_are_five_and_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(None, "i", DAY, -float(k), None) for k in range(1, 30)], "store_id string, item_id string, date date, on_hand double, in_transit double")
    got = _found(rows, tables.STOCK, {"items": spark.createDataFrame([("j",)], "item_id string")})
    assert {k: (n, len(s)) for k, (n, s) in got.items()} == {("null", "store_id"): (29, 5), (">= 0", "on_hand"): (29, 5), ("duplicate key", "store_id, item_id, date"): (29, 5), ("not in items", "item_id"): (29, 5)}


def test_more_columns_can_be_required(spark):
    more = tables.ITEMS.with_required("cost")
    assert [f.required for f in more.fields if f.name == "cost"] == [True] and more.references == tables.ITEMS.references
    with pytest.raises(ValueError, match="no such columns: nothing"):
        tables.ITEMS.with_required("nothing")


def test_conversion(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2020-01-01,1.5\n2020-01-02,\n,3\nx,4\n2020-01-03,abc\n")
    done = raw_files.convert(spark, "oil", f"{path}/oil.csv", f"{path}/out/oil.parquet")
    assert (done.read, done.kept, done.misfits, done.null_dates) == (5, 3, 2, 1) and done.problems() == ["2 rows do not fit the schema", "1 dates are null"]
    assert sorted(r._misfit for r in spark.read.parquet(f"{path}/out/oil.parquet_misfits").collect()) == ["2020-01-03,abc", "x,4"]
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2020-01-01,1.5\n")
    assert raw_files.convert(spark, "oil", f"{path}/oil.csv", f"{path}/out/oil.parquet").skipped
    assert raw_files.scan_raw(spark, "oil", f"{path}/out").count() == 3
    again = raw_files.convert(spark, "oil", f"{path}/oil.csv", f"{path}/out/oil.parquet", overwrite=True)
    assert (again.kept, again.problems()) == (1, [])
    for name, kind, text in (("gas", ValueError, "no raw table"), ("items", FileNotFoundError, "convert it first")):
        with pytest.raises(kind, match=text):
            raw_files.scan_raw(spark, name, f"{path}/out")
    with pytest.raises(FileNotFoundError, match="items"):
        raw_files.convert(spark, "items", f"{path}/items.csv", f"{path}/out/items.parquet")


def test_all_raw_tables_in_one_error(spark, tmp_path):
    rows = {"train": "1,2020-01-01,1,5,2.0,", "items": "5,FOOD,3,1", "stores": "1,a,b,c,4", "transactions": "2020-01-01,1,x", "oil": ",1", "holidays_events": "2020-01-01,Holiday,National,All,New,False"}
    for name, row in rows.items():
        header = ",".join(c.split()[0] for c in raw_files.RAW_SCHEMAS[name].split(", "))
        (tmp_path / f"{name}.csv").write_text(f"{header}\n{row}\n")
    with pytest.raises(ValueError, match="transactions: 1 rows do not fit the schema; oil: 1 dates are null"):
        raw_files.convert_all(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")


def test_known_totals(spark):
    rows = spark.createDataFrame([(k, None if k < 3 else True) for k in range(2, 10)], "id long, onpromotion boolean")
    r = raw_files.known_totals(rows, 8).first()
    assert (r.rows_ok, r.ids_ok, r.promo_ok) == (True, True, True)
    r = raw_files.known_totals(rows.filter("id <> 5"), 8).first()
    assert (r.rows_ok, r.ids_ok) == (False, False)
    assert tuple(raw_files.known_totals(rows.limit(0), 1).first())[-3:] == (False, False, False)


def _raw(spark, extra=()):
    rows = [(1, k % 3 + 1, dt.date(1999, 1, 1) + dt.timedelta(k), float(k % 5), None) for k in range(60)] + list(extra)
    sales = spark.createDataFrame(rows, "store_nbr long, item_nbr long, date date, unit_sales double, onpromotion boolean")
    items = spark.createDataFrame([(k, f"FAMILY {k % 2}", k, k % 2) for k in range(1, 4)], "item_nbr long, family string, class long, perishable long")
    return sales, items


def test_canonical_build_is_made_once(spark, tmp_path):
    out, p = f"file://{tmp_path}/canonical", Params(review_days=7, order_days=(1, 4))
    sales, items = _raw(spark)
    first = canonical.build(spark, sales, items, out, p)
    assert first["built"] and first["outputs"]["items"]["rows"] == 3 and first["outputs"]["stock"]["rows"] == 0
    stamp = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    again = canonical.build(spark, sales.orderBy("date"), items, out, p)
    assert not again["built"] and again["outputs"] == first["outputs"] and {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")} == stamp
    with pytest.raises(ValueError, match="from other inputs"):
        canonical.build(spark, _raw(spark, [(1, 1, dt.date(2000, 1, 1), 1.0, True)])[0], items, out, p)
    with pytest.raises(ValueError, match="from other params_hash"):
        canonical.build(spark, sales, items, out, Params(review_days=14))
    anew = canonical.build(spark, *_raw(spark, [(1, 1, dt.date(2000, 1, 1), 1.0, True)]), out, p, overwrite=True)
    assert anew["built"] and anew["outputs"]["sales"]["content"] != first["outputs"]["sales"]["content"]
    made = canonical.load(spark, out)
    assert made["sales"].schema.simpleString() == tables.SALES.schema().simpleString() and made["sales"].count() == anew["outputs"]["sales"]["rows"]
    assert {r.economics_origin for r in made["items"].collect()} == {"assumed margin 0.15 of the category, price 10 for all; not observed", "assumed margin 0.25 of the category, price 10 for all; not observed"}


def test_a_build_that_breaks_a_contract_leaves_no_manifest(spark, tmp_path):
    out = f"file://{tmp_path}/canonical"
    sales, items = _raw(spark)
    with pytest.raises(ValueError, match="sales.item_id: not in items"):
        canonical.build(spark, sales, items.filter("item_nbr < 3"), out, Params())
    assert canonical.manifest(spark, out) is None
    with pytest.raises(ValueError, match="days between order days"):
        canonical.build(spark, sales, items, out, Params(review_days=3))
    clash = items.union(spark.createDataFrame([(9, "family-1", 1, 1)], items.schema))
    with pytest.raises(ValueError, match="families share the supplier SUP-FAMILY_1"):
        canonical.build(spark, sales, clash, out, Params())
    assert panel.slug_collisions(items).count() == 0


def test_results_are_kept_by_their_parameters(spark, tmp_path):
    path, made = f"file://{tmp_path}/result", []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", 1), ("b", 2)], "cell string, v int")

    one = {"b": 1, "a": (0.5, 0.9)}
    assert results.load_or_make(spark, path, one, make).count() == 2 and results.load_or_make(spark, path, {"a": (0.5, 0.9), "b": 1}, make).columns == ["cell", "v"] and len(made) == 1
    with pytest.raises(ValueError, match="other parameters"):
        results.load_or_make(spark, path, {"b": 2}, make)
    with pytest.raises(FileExistsError):
        results.save(make(), path, one)
    results.save(make().filter("v = 2"), path, {"b": 2}, force=True)
    assert results.load(spark, path, {"b": 2}).count() == 1


def test_open_cells(spark, tmp_path):
    path, grid = f"file://{tmp_path}/cells", spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    results.append(grid.filter("cell = 'a'"), path, 1)
    results.append(grid.filter("cell = 'b'"), path, 2)
    done = spark.read.parquet(path)
    assert {r.cell for r in results.open_cells(grid, done, ["cell"], 1).collect()} == {"b", "c"}
    results.append(results.open_cells(grid, done, ["cell"], 1), path, 1)
    assert results.open_cells(grid, spark.read.parquet(path), ["cell"], 1).count() == 0


def test_points_and_csv(spark, tmp_path):
    paths = []
    for alpha in (0.9, 0.5, 0.7):
        (tmp_path / f"p{alpha}.json").write_text(json.dumps({"alpha": alpha, "service": alpha / 2}))
        paths.append(f"file://{tmp_path}/p{alpha}.json")
    points = results.union_by_order(spark, paths, "alpha")
    assert [r.alpha for r in points.collect()] == [0.5, 0.7, 0.9]
    results.write_csv(points, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True, inferSchema=True).count() == 3


def test_parts_are_not_broadcast_and_lines_are_read_once(spark, monkeypatch):
    from larder.plans import retail
    from larder.plans import tables as plans
    from larder.sources.retail import raw_sales

    data = "/root/testdata/sf0.001"
    plan = raw_sales(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "p_partkey" in line and "BroadcastHashJoin" in line] == []
    # what reads the sales several times reads them written, not the lines each time
    assert [f for f in retail.QUERIES["c5_panel"](spark, data).inputFiles() if "lineitem" in f] == []
    seen, build = [], canonical.build

    def watched(spark, sales, *rest):
        seen.extend(sales.inputFiles())
        return build(spark, sales, *rest)

    monkeypatch.setattr(plans.canonical, "build", watched)
    rows = plans.s67(spark, data).collect()
    assert len(rows) == 4 and not any(r.built_again for r in rows) and seen and not any("lineitem" in f for f in seen)
