"""Results of runs, kept under the key of the parameters that made them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import params_key
from .raw_files import exists

KEY = "params_hash"


def save(df: DataFrame, path: str, params: Any, force: bool = False) -> None:
    """Write a result with its key; one that is there is an error, unless force is set."""
    if not force and exists(df.sparkSession, f"{path}/_SUCCESS"):
        raise FileExistsError(f"there is a result in {path}")
    df.withColumn(KEY, F.lit(params_key(params))).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, params: Any) -> DataFrame:
    """A saved result without its key; one of other parameters is stale, which is an error."""
    found = spark.read.parquet(path)
    other = found.filter(F.col(KEY) != params_key(params)).limit(1).collect()
    if other:
        raise ValueError(f"{path} was made with other parameters ({other[0][KEY][:12]} instead of {params_key(params)[:12]})")
    return found.drop(KEY)


def load_or_make(spark: SparkSession, path: str, params: Any, make: Callable[[], DataFrame]) -> DataFrame:
    """The saved result of these parameters, made and saved first where there is none; a stale one is an error."""
    if not exists(spark, f"{path}/_SUCCESS"):
        save(make(), path, params)
    return load(spark, path, params)


def open_cells(grid: DataFrame, done: DataFrame, cell: list[str], params: Any) -> DataFrame:
    """Cells of a grid that have no result under the key of these parameters; results of other parameters do not count."""
    return grid.join(done.filter(F.col(KEY) == params_key(params)).select(*cell), cell, "left_anti")


def append(df: DataFrame, path: str, params: Any) -> None:
    """Add the results of more cells."""
    df.withColumn(KEY, F.lit(params_key(params))).write.mode("append").parquet(path)


def union_by_order(spark: SparkSession, paths: list[str], order: str) -> DataFrame:
    """Result points of many JSON files, in order."""
    return spark.read.json(paths).orderBy(order)


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    """A result table as CSV with a header, in several parts where it is large."""
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)
