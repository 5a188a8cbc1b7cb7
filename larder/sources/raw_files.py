"""Raw CSV files with fixed schemas, converted to Parquet once and checked on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .intermediate import hadoop_path

# Columns of the six raw tables.
RAW_SCHEMAS = {
    "train": "id long, date date, store_nbr long, item_nbr long, unit_sales double, onpromotion boolean",
    "items": "item_nbr long, family string, class long, perishable long",
    "stores": "store_nbr long, city string, state string, type string, cluster long",
    "transactions": "date date, store_nbr long, transactions long",
    "oil": "date date, dcoilwtico double",
    "holidays_events": "date date, type string, locale string, locale_name string, description string, transferred boolean",
}
#: The share of sales rows whose promotion is unknown lies between these.
PROMO_NULL_SHARE = (0.10, 0.25)


@dataclass(frozen=True)
class Conversion:
    """What came of one file: rows read, rows kept, rows that do not fit the schema, null dates among those kept; skipped where the Parquet was there."""

    name: str
    path: str
    read: int = 0
    kept: int = 0
    misfits: int = 0
    null_dates: int = 0
    skipped: bool = False

    def problems(self) -> list[str]:
        out = [f"{self.misfits} rows do not fit the schema"] if self.misfits else []
        out += [f"{self.null_dates} dates are null"] if self.null_dates else []
        return out + ([f"{self.read} rows read, {self.kept} kept"] if self.read != self.kept + self.misfits else [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def convert(spark: SparkSession, name: str, csv: str, parquet: str, schema: str | None = None, overwrite: bool = False) -> Conversion:
    """The CSV of a known table as Parquet with declared types. What is there already stays, unless told otherwise, and is not read again.

    Rows that do not fit go to `parquet`_misfits with their text, and are counted with all others as the rows pass by.
    """
    kind = StructType.fromDDL(schema or RAW_SCHEMAS[_known(name)])
    if not exists(spark, csv):
        raise FileNotFoundError(f"{name}: there is no {csv}")
    if not overwrite and exists(spark, f"{parquet}/_SUCCESS"):
        return Conversion(name, parquet, skipped=True)
    misfit = "_misfit"
    whole = StructType([*kind.fields, StructField(misfit, StringType())])
    read = spark.read.csv(csv, schema=whole, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=misfit, enforceSchema=False)
    passing = Observation(f"{name} conversion")
    dates = F.count_if(F.col("date").isNull() & F.col(misfit).isNull()) if "date" in kind.names else F.lit(0).cast("long")
    seen = read.observe(passing, F.count("*").alias("read"), F.count(misfit).alias("misfits"), dates.alias("null_dates"))
    # one scan: rows that fit and misfits part by a folder
    seen.withColumn("fits", F.col(misfit).isNull()).write.mode("overwrite").partitionBy("fits").parquet(f"{parquet}_parted")
    found = passing.get
    parted = spark.read.schema(whole).parquet
    for fits, to in ((True, parquet), (False, f"{parquet}_misfits")):
        at = f"{parquet}_parted/fits={str(fits).lower()}"
        rows = parted(at) if exists(spark, at) else spark.createDataFrame([], whole)
        (rows.drop(misfit) if fits else rows).write.mode("overwrite").parquet(to)
    fs, at = hadoop_path(spark, f"{parquet}_parted")
    fs.delete(at, True)
    return Conversion(name, parquet, found["read"], spark.read.schema(kind).parquet(parquet).count(), found["misfits"], found["null_dates"])


def convert_all(spark: SparkSession, raw_dir: str, out_dir: str, overwrite: bool = False) -> dict[str, Conversion]:
    """All known tables of a folder; raises once, with the problems of all."""
    done = {name: convert(spark, name, f"{raw_dir}/{name}.csv", f"{out_dir}/{name}.parquet", overwrite=overwrite) for name in RAW_SCHEMAS}
    said = [f"{name}: {problem}" for name, c in done.items() for problem in c.problems()]
    if said:
        raise ValueError("; ".join(said))
    return done


def _known(name: str) -> str:
    if name not in RAW_SCHEMAS:
        raise ValueError(f"{name} is no raw table; there are {', '.join(sorted(RAW_SCHEMAS))}")
    return name


def scan_raw(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A converted raw table by name."""
    path = f"{folder}/{_known(name)}.parquet"
    if not exists(spark, path):
        raise FileNotFoundError(f"{name}: there is no {path}; convert it first")
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(path)


def known_totals(sales: DataFrame, rows: int, promo: tuple[float, float] = PROMO_NULL_SHARE) -> DataFrame:
    """One row: whether sales (id, onpromotion) has exactly so many rows, ids without a gap, and a share of unknown promotions within bounds; and the figures."""
    found = sales.agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.avg(F.col("onpromotion").isNull().cast("double")).alias("promo_null_share"))
    return found.select(
        "*", (F.col("n_rows") == rows).alias("rows_ok"), F.coalesce(F.col("last_id") - F.col("first_id") + 1 == F.col("n_rows"), F.lit(False)).alias("ids_ok"), F.coalesce(F.col("promo_null_share").between(*promo), F.lit(False)).alias("promo_ok")
    )
