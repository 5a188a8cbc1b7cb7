"""Registered queries of table contracts, raw conversion, the canonical build and kept results, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..operators.tables import Contract, Field
from ..params import PARAMS as P
from ..sources import canonical, raw_files, results
from ..sources.intermediate import dropped, shared_dir
from ..sources.retail import kept_sales, raw_items, raw_sales
from .retail import _MARGIN, ORACLE_SQL, _query

#: Order lines as a table that is held to more than it keeps, so that each rule has its findings.
_LINES = Contract(
    "lineitem",
    (Field("l_orderkey", "long", at_least=1), Field("l_linenumber", "long", at_least=1, at_most=6), Field("l_partkey", "long"), Field("l_suppkey", "long"), Field("l_quantity", "double", above=1, at_most=45), Field("l_discount", "double", at_most=0.09), Field("l_returnflag", "string", one_of=("A", "N")), Field("known_discount", "double"), Field("l_comment", "string"), Field("l_tax", "long")),
    ("l_orderkey", "l_linenumber"), {"l_orderkey": ("open orders", "o_orderkey"), "l_suppkey": ("supplier", "s_suppkey")},
)


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = F.col
    lines = read("lineitem").select(
        c("l_orderkey").cast("long"), c("l_linenumber").cast("long"), c("l_partkey").cast("long"), c("l_suppkey").cast("long"), c("l_quantity").cast("double"), c("l_discount").cast("double"), "l_returnflag",
        F.when(c("l_discount") > 0, c("l_discount").cast("double")).alias("known_discount"), c("l_tax").cast("double"), c("l_shipdate").cast("date").alias("l_shipdate"),
    )
    return lines, {"open orders": read("orders").filter("o_orderstatus <> 'P'").select(c("o_orderkey").cast("long")), "supplier": read("supplier").select(c("s_suppkey").cast("long"))}


_CHECKS = [
    ("null", "known_discount", "l_discount = 0 or l_discount is null"), (">= 1", "l_orderkey", "l_orderkey < 1"), (">= 1", "l_linenumber", "l_linenumber < 1"), ("<= 6", "l_linenumber", "l_linenumber > 6"), ("> 1", "l_quantity", "l_quantity <= 1"), ("<= 45", "l_quantity", "l_quantity > 45"),
    ("<= 0.09", "l_discount", "cast(l_discount as double) > 0.09"), ("one of A, N", "l_returnflag", "l_returnflag not in ('A', 'N')"), ("not in open orders", "l_orderkey", "l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')"), ("not in supplier", "l_suppkey", "l_suppkey not in (select s_suppkey from supplier)"),
    ("duplicate key", "l_orderkey, l_linenumber", "(l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having count(*) > 1)"),
    *(("null", c, f"{c} is null") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")),
]


@_query("v1_all_findings")
def v1(spark, sf_dir):
    """All findings of the order lines at once: columns, types, nulls, bounds, values, key and references."""
    lines, others = _lines(spark, sf_dir)
    found = tables.findings(lines, _LINES, others)
    return found.select("table_name", "rule", "column_name", "n", F.size("samples").alias("n_samples"))


ORACLE_SQL["v1_all_findings"] = (
    "with c as (" + " union all ".join(f"select '{rule.replace(chr(39), chr(39) * 2)}' rule, '{c}' column_name, count(*) n from lineitem where {where}" for rule, c, where in _CHECKS) + ") "
    "select 'lineitem' table_name, rule, column_name, n, cast(least(n, 5) as integer) n_samples from c where n > 0 union all select 'lineitem', 'missing', 'l_comment', null, null "
    "union all select 'lineitem', 'undeclared', 'l_shipdate', null, null union all select 'lineitem', 'type: double where bigint is expected', 'l_tax', null, null"
)


@_query("v8_duplicate_rows", None)
def v8_rows(spark, sf_dir):
    """Sales lines whose order, part and supplier come more than once, counted with a sample of rows."""
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), F.col("l_shipdate").cast("date").alias("l_shipdate"))
    kind = Contract("shipments", (Field("l_partkey", "long"), Field("l_suppkey", "long"), Field("l_shipdate", "date")), ("l_partkey", "l_suppkey", "l_shipdate"))
    return tables.findings(read, kind).select("table_name", "rule", "column_name", "n", F.size("samples").alias("n_samples"))


ORACLE_SQL["v8_duplicate_rows"] = (
    "select 'shipments' table_name, 'duplicate key' as rule, 'l_partkey, l_suppkey, l_shipdate' column_name, cast(sum(n) as bigint) n, cast(least(sum(n), 5) as integer) n_samples from "
    "(select count(*) n from lineitem group by l_partkey, l_suppkey, cast(l_shipdate as date) having count(*) > 1) having sum(n) > 0"
)


@_query("s4_known_order_totals")
def s4_orders(spark, sf_dir):
    """The orders' keys and number against what is known of them; dates before 1996 have no promotion known."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), F.when(F.col("o_orderdate") >= F.lit("1996-01-01").cast("date"), F.lit(True)).alias("onpromotion"))
    return raw_files.known_totals(orders, P.known_orders).withColumn("promo_null_share", F.round("promo_null_share", 6))


ORACLE_SQL["s4_known_order_totals"] = (
    f"select n n_rows, a first_id, z last_id, round(s, 6) promo_null_share, n = {P.known_orders} rows_ok, z - a + 1 = n ids_ok, s between {raw_files.PROMO_NULL_SHARE[0]} and {raw_files.PROMO_NULL_SHARE[1]} promo_ok "
    "from (select count(*) n, cast(min(o_orderkey) as bigint) a, cast(max(o_orderkey) as bigint) z, avg(cast(o_orderdate < date '1996-01-01' as double)) s from orders)"
)


@_query(
    "s1_s3_conversion",
    "select 'sales' as name, count(*) \"read\", count(*) filter (where item_nbr % 7 <> 0) kept, count(*) filter (where item_nbr % 7 = 0) misfits, count(*) filter (where item_nbr % 7 <> 0 and date is null) null_dates, false skipped, true again_skipped from raw",
)
def s13(spark, sf_dir):
    """Raw sales written as text, some with units that are no number, and converted twice: the second time there is nothing to do."""
    folder = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    sales = raw_sales(spark, sf_dir)
    text = F.when(F.col("item_nbr") % 7 == 0, "n/a").otherwise(F.col("unit_sales").cast("string"))
    results.write_csv(sales.select("date", "store_nbr", "item_nbr", text.alias("unit_sales"), "onpromotion"), f"{folder}/sales.csv")
    schema = "date date, store_nbr long, item_nbr long, unit_sales double, onpromotion boolean"
    first, again = (raw_files.convert(spark, "sales", f"{folder}/sales.csv", f"{folder}/sales.parquet", schema) for _ in range(2))
    return spark.createDataFrame([(*(v for k, v in asdict(first).items() if k != "path"), again.skipped)], "name string, read long, kept long, misfits long, null_dates long, skipped boolean, again_skipped boolean")


def _built(spark: SparkSession, sales: DataFrame) -> tuple[str, dict]:
    """The canonical tables of these sales and parameters in the shared folder, and their manifest; built where they are not there yet."""
    items = raw_items(sales)
    key = canonical.params_key({"params": canonical.params_key(P), "sales": canonical.fingerprint(sales)})
    out = f"{shared_dir(spark)}/canonical-{key}"
    return out, canonical.build(spark, sales, items, out, P)


def _built_once(spark: SparkSession, sf_dir: str) -> str:
    sales = kept_sales(spark, sf_dir)
    out, _ = _built(spark, sales)
    dropped(sales)
    return out


@_query(
    "s6_s7_canonical_build",
    "select 'sales' table_name, count(*) n_rows, false built_again from panel union all select 'items', count(*), false from items union all select 'suppliers', count(distinct family), false from items union all select 'stock', 0, false",
)
def s67(spark, sf_dir):
    """The canonical tables' rows by their manifest; a second build of the same inputs writes nothing."""
    sales = kept_sales(spark, sf_dir)
    out, _ = _built(spark, sales)
    again = canonical.build(spark, sales, raw_items(sales), out, P)
    dropped(sales)
    return spark.createDataFrame([(name, marks["rows"], again["built"]) for name, marks in again["outputs"].items()], "table_name string, n_rows long, built_again boolean")


@_query("s8_canonical_sales", "select store_id, item_id, date, units_sold, units_returned, on_promo, cast(null as double) price, is_operating_day, is_anomaly, anomaly_reason from panel")
def s8(spark, sf_dir):
    out = _built_once(spark, sf_dir)
    return canonical.load(spark, out, ("sales",))["sales"]


@_query(
    "c6_canonical_items",
    f"""frac as (select item_nbr, avg(cast(unit_sales <> round(unit_sales) as double)) r from win group by 1)
select cast(item_nbr as varchar) item_id, cast(null as varchar) ean, cast(null as varchar) description, family category, cast(class as varchar) item_class, 'SUP-' || trim(regexp_replace(upper(trim(family)), '[^A-Z0-9]+', '_', 'g'), '_') supplier_id, case when coalesce(r, 0) > {P.fractional_threshold} then 'kg' else 'unidade' end unit_of_sale,
       cast(1 as double) pack_multiple, perishable = 1 is_perishable, cast(null as boolean) is_anchor, round(cast({P.price_ref} as double) * (1 - cast({_MARGIN} as double)), 6) "cost", cast({P.price_ref} as double) price_ref,
       'assumed margin ' || cast(cast({_MARGIN} as double) as varchar) || ' of the ' || case when family in ({", ".join(f"'{f}'" for f, _ in P.margins)}) then 'category' else 'default' end || ', price {P.price_ref:g} for all; not observed' economics_origin from items left join frac using (item_nbr)""",
)
def c6_items(spark, sf_dir):
    out = _built_once(spark, sf_dir)
    return canonical.load(spark, out, ("items",))["items"].withColumn("cost", F.round("cost", 6))


@_query(
    "s12_h12_open_cells",
    "select cast(store_nbr as varchar) store_id, factor from (select distinct store_nbr from raw) cross join (values (cast(0.7 as double)), (1.0), (1.3)) f(factor) where not (store_nbr <= 2 and factor <= 1.0)",
)
def s12(spark, sf_dir):
    """Cells of a grid that are still to be run: some were run with these parameters, some with others, which do not count."""
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    stores = raw_sales(spark, sf_dir).select("store_nbr").distinct()
    grid = stores.select(F.col("store_nbr").cast("string").alias("store_id"), F.explode(F.array(*map(F.lit, P.margin_factors))).alias("factor"))
    of = lambda condition: grid.filter(condition).withColumn("result", F.col("factor") * 2)
    results.append(of("cast(store_id as int) <= 2 and factor <= 1"), path, {"quantiles": P.quantiles})
    results.append(of("cast(store_id as int) >= 4"), path, {"quantiles": (0.5,)})
    return results.open_cells(grid, spark.read.parquet(path), ["store_id", "factor"], {"quantiles": P.quantiles})
