"""A training corpus from raw documents: toxicity, quality, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever they are
called. Decisions are made and carried out row by row: a row never falls because another row has its doc_id. Rows without a
doc_id are judged like others. Null and empty texts are not toxic and hold no secrets, fail the quality rules, are copies of
nothing, and are packed as an end mark alone. Very long texts are read whole. An empty table passes every stage as an empty one.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import ngram_join, packing, quality_rules, secret_scan, toxicity
from larder.llm.common import cleanup, materialize, numbered, table, written

#: Near copies, unless told otherwise: shingles of five words, a similarity of four fifths.
WIDTH, SIMILARITY = 5, Fraction(4, 5)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a column of whole numbers that no two rows share: doc_id where it is one, else a number that is written beside each row."""
    if docs.schema["doc_id"].dataType.simpleString() == "bigint":
        clash = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
        if clash.isEmpty():
            return docs, "doc_id"
    return numbered(docs)


def _without(docs: DataFrame, rows: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """rows less those whose key is in the one column of rejected, with the columns of docs. The keys are written first: few,
    they are broadcast with a known size; else both sides are dealt out."""
    return rows.join(materialize(rejected.toDF(row)), row, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    rows, row = _keyed(docs)
    judged = toxicity.judge(rows, table(spark, sf_dir, "labels"), key_col=None if row == "doc_id" else row)
    return _without(docs, rows, row, judged.filter("predicted = 1").select(row))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows, row = _keyed(docs)
    return _without(docs, rows, row, quality_rules.judge(rows, id_col=row).filter("not kept").select(row))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest doc_id, the first of equal ones; one without a doc_id only where no other is there."""
    rows, row = _keyed(docs)
    found = materialize(ngram_join.near_duplicates(rows, SIMILARITY, WIDTH, id_col=row).select(F.col(row).alias("r"), F.col("component_id").alias("c")))
    if row == "doc_id":
        return _without(docs, rows, row, found.filter("r <> c").select("r"))
    several = materialize(found.filter("r <> c").select("c").distinct())
    grouped = found.join(several, "c", "left_semi").join(rows.select(F.col(row).alias("r"), F.col("doc_id").alias("d")), "r")
    grouped = materialize(grouped.select("r", "c", "d"))
    stays = grouped.groupBy("c").agg(F.min(F.struct(F.col("d").isNull(), "d", "r")).getField("r").alias("r")).select("r")
    return _without(docs, rows, row, grouped.select("r").join(stays, "r", "left_anti"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the texts is replaced; n_chars follows where the table has it."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences of the permitted lengths."""
    return packing.pack(packing.token_counts(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: Models and robust estimates are beyond SQL; tests/llm/test_pipeline.py tests each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next; what a stage wrote on its way goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            cleanup(spark, before, (docs,))
    return docs
