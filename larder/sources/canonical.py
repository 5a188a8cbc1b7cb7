"""The canonical tables: built from raw sales once, with a manifest that tells from what; a build that is there is read, not repeated."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, panel, profiling, tables
from ..params import Params
from .intermediate import hadoop_path
from .raw_files import exists

SCHEMA_VERSION = 1
CONTRACTS = {c.name: c for c in (tables.SALES, tables.ITEMS, tables.SUPPLIERS, tables.STOCK)}


def params_key(params: Any) -> str:
    """A hash of parameters: equal values, equal key, whatever the order of names."""
    plain = dataclasses.asdict(params) if dataclasses.is_dataclass(params) else params
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def _marks(df: DataFrame) -> list:
    """Aggregates for the number of rows, and for their content whatever their order and files: sums of 64-bit fingerprints."""
    return [F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content")]


def fingerprint(df: DataFrame) -> dict[str, Any]:
    return df.agg(*_marks(df)).first().asDict()


def empty_stock(spark: SparkSession) -> DataFrame:
    """The stock table of a source without stock: no rows, the contract's columns."""
    return spark.createDataFrame([], tables.STOCK.schema())


def canonical_tables(sales: DataFrame, items: DataFrame, p: Params) -> dict[str, DataFrame]:
    """sales, items, suppliers and stock with the columns of their contracts, from raw sales and items."""
    days = panel.panel(sales, p.window_start, p.window_end, p.delisting_gap_days, p.anomalies)
    made = panel.items(items, profiling.in_window(sales, p.window_start, p.window_end), p.margins, p.default_margin, p.fractional_threshold, p.price_ref)
    by_number = items.select(F.col("item_nbr").cast("string").alias("item_id"), F.col("class").cast("string").alias("item_class"))
    margin = F.coalesce(*(F.when(F.col("category") == f, F.lit(m)) for f, m in p.margins), F.lit(p.default_margin))
    known = F.coalesce(*(F.when(F.col("category") == f, F.lit("category")) for f, _ in p.margins), F.lit("default"))
    origin = F.concat(F.lit("assumed margin "), margin.cast("string"), F.lit(" of the "), known, F.lit(f", price {p.price_ref:g} for all; not observed"))
    out = {
        "sales": days.withColumn("price", F.lit(None).cast("double")),
        "items": made.join(by_number, "item_id").withColumns({"pack_multiple": F.lit(1.0), "economics_origin": origin}),
        "suppliers": panel.suppliers(items, p.lead_days, p.review_days, p.order_days, p.least_value, p.least_units),
        "stock": empty_stock(sales.sparkSession),
    }
    # columns that the source lacks are null
    return {name: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACTS[name].schema())) for name, df in out.items()}


def build(spark: SparkSession, sales: DataFrame, items: DataFrame, out: str, p: Params, overwrite: bool = False) -> dict[str, Any]:
    """Write the canonical tables under `out` and return their manifest.

    Where a manifest is there, nothing is written: it is returned, with `built` false, if inputs and parameters are those that
    it tells; else what changed is an error, unless overwrite is set. Tables are counted and fingerprinted as they are written,
    then checked against their contracts, all findings in one error; the manifest comes last, so a build that broke off is
    built again. Sales are parted by store.
    """
    clash = panel.slug_collisions(items).limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0].n_families} families share the supplier {clash[0].supplier_id}")
    inputs = {"sales": fingerprint(sales), "items": fingerprint(items)}
    want = {"schema_version": SCHEMA_VERSION, "window_start": str(p.window_start), "window_end": str(p.window_end), "params_hash": params_key(p), "inputs": inputs}
    have = manifest(spark, out)
    if have and not overwrite:
        changed = [k for k, v in want.items() if have[k] != v]
        if changed:
            raise ValueError(f"{out} was built from other {', '.join(changed)}; build it anew with overwrite")
        return {**have, "built": False}
    fs, at = hadoop_path(spark, f"{out}/manifest")
    fs.delete(at, True)
    outputs = {}
    for name, df in canonical_tables(sales, items, p).items():
        passing = Observation(f"canonical {name}")
        rows = df.observe(passing, *_marks(df)).write.mode("overwrite")
        (rows.partitionBy("store_id") if name == "sales" else rows).parquet(f"{out}/{name}")
        outputs[name] = passing.get
    made = load(spark, out)
    said = [tables.findings(made[name], c.with_required("cost", "price_ref") if name == "items" else c, made) for name, c in CONTRACTS.items()]
    found = said[0]
    for more in said[1:]:
        found = found.unionByName(more)
    tables.require(found)
    late = contracts.cadence_findings(made["suppliers"], "supplier_id", "order_days", F.col("review_period_days")).limit(1).collect()
    if late:
        raise ValueError(f"supplier {late[0].supplier_id}: {late[0].gap} days between order days, reviewed every {late[0].review_days}")
    params = json.loads(json.dumps(dataclasses.asdict(p), default=str))
    record = {**want, "outputs": outputs, "params": params}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return {**record, "built": True}


def manifest(spark: SparkSession, out: str) -> dict[str, Any] | None:
    """The manifest of a finished build, None where there is none."""
    if not exists(spark, f"{out}/manifest/_SUCCESS"):
        return None
    return json.loads(spark.read.text(f"{out}/manifest").first().value)


def load(spark: SparkSession, out: str, names: tuple[str, ...] = tuple(CONTRACTS)) -> dict[str, DataFrame]:
    """Canonical tables by name, with the contracts' columns in their order."""
    kinds = {name: CONTRACTS[name].schema() for name in names}
    return {name: spark.read.schema(kind).parquet(f"{out}/{name}").select(*kind.names) for name, kind in kinds.items()}
