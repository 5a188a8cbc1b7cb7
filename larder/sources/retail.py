"""Raw sales, items and suppliers from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .intermediate import written


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store_nbr, item_nbr, date, unit_sales, onpromotion): regions are stores and brands items; dates before 1996 have no promotion known.

    Parts grow with the lines, so they are never broadcast.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = (
        read("lineitem")
        .join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(F.broadcast(read("nation")), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(read("part").hint("merge"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            (F.col("n_regionkey") + 1).cast("long").alias("store_nbr"), F.expr("cast(substr(p_brand, 7) as bigint)").alias("item_nbr"),
            F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").cast("double").alias("q"), F.col("l_tax").cast("double").alias("tax"),
            F.col("l_discount").cast("double").alias("discount"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("back"),
        )
    )
    units = F.when(F.col("back"), -1).otherwise(1) * F.col("q") * F.when(F.col("item_nbr") % 5 == 0, 1 - F.col("tax")).otherwise(1)
    return lines.groupBy("store_nbr", "item_nbr", "date").agg(
        F.round(F.sum(units), 4).alias("unit_sales"), F.when(F.col("date") >= F.lit("1996-01-01").cast("date"), F.max("discount") >= 0.08).alias("onpromotion")
    )


def kept_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_sales(), written: for whatever reads them more than once, as the lines are then read and joined once."""
    return written(raw_sales(spark, sf_dir))


def raw_items(sales: DataFrame) -> DataFrame:
    """(item_nbr, family, class, perishable) of the items sold."""
    n = F.col("item_nbr")
    return sales.select("item_nbr").distinct().select("item_nbr", F.concat(F.lit("FAMILY "), (n % 6).cast("string")).alias("family"), (n % 10).alias("class"), (n % 2).alias("perishable"))
