"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, in a local session alone, a new one that this session then uses."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("larder.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-larder-")
        spark.conf.set("larder.checkpoint.dir", known)
    return known.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms, for any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there. `written_to` of the result is its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/retail-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote for df."""
    fs, at = hadoop_path(df.sparkSession, df.written_to)
    fs.delete(at, True)
