"""Checks of the data that become a report, and the difference of two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR = ["store_id", "item_id"]


def divergent_values(rows: DataFrame, code: str, value: str) -> DataFrame:
    """Codes with more than one value: code, n_values, and the first and last of them. Nulls are no values."""
    out = rows.groupBy(F.col(code).alias("code")).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("first_value"), F.max(value).alias("last_value"))
    return out.filter("n_values > 1")


def returns_without_sale(history: DataFrame, days: int) -> DataFrame:
    """Rows of a panel with a return, where the pair sold nothing on the days before, the row's own day left out."""
    before = Window.partitionBy(*PAIR).orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    sold = F.coalesce(F.count_if(F.col("units_sold") > 0).over(before), F.lit(0))
    return history.withColumn("n_sold", sold).filter("units_returned > 0 and n_sold = 0").select(*PAIR, "date", "units_returned")


def regular_zero_days(history: DataFrame, days: int, least_share: float) -> DataFrame:
    """Occurrences of days without a sale where the pair sold something on at least that share of the days before, all of which are there."""
    before = Window.partitionBy(*PAIR).orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    share, n = F.avg((F.col("units_sold") > 0).cast("double")).over(before), F.count("*").over(before)
    return history.select("item_id", "date", "units_sold", share.alias("s"), n.alias("n")).filter((F.col("units_sold") == 0) & (F.col("n") == days) & (F.col("s") >= least_share)).select("item_id", "date", F.lit("0").alias("value"))


def check_summary(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Per check, zero findings included: its findings and their share of all rows, from one pass."""
    counts = rows.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(name) for name, c in checks.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("n_findings")) for name in checks)))
    return counts.select("n_rows", each.alias("e")).select("e.check", "e.n_findings", F.try_divide("n_findings", "n_rows").alias("share"))


def divergent_units(rows: DataFrame, code: str, value: str) -> DataFrame:
    """Occurrences (item_id, date, value) of codes that have several values, which are listed in order; a code's values are few."""
    out = rows.groupBy(F.col(code).alias("item_id")).agg(F.array_sort(F.collect_set(value)).alias("v")).filter(F.size("v") > 1)
    return out.select("item_id", F.lit(None).cast("date").alias("date"), F.array_join("v", " | ").alias("value"))


def receipts_before_orders(entries: DataFrame) -> DataFrame:
    """Occurrences of goods that came before they were ordered; entries without an order date are none."""
    bad = entries.filter(F.col("received_date") < F.col("order_date"))
    return bad.select("item_id", F.col("received_date").alias("date"), F.concat_ws(" < ", F.col("received_date").cast("string"), F.col("order_date").cast("string")).alias("value"))


def active_items(sales: DataFrame, days: int) -> DataFrame:
    """Items that sold something on the last `days` days of sales."""
    last = sales.agg(F.max("date").alias("last_day"))  # one row
    return sales.join(F.broadcast(last), F.col("date") > F.date_sub("last_day", days)).filter("units_sold > 0").select("item_id").distinct()


def registry_gaps(items: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active codes of the registry, occurrences of those among them without a pack): a code has one if any of its rows does."""
    known = items.join(active, "item_id", "left_semi").groupBy("item_id").agg(F.bool_or(F.col("pack_multiple").isNotNull()).alias("has_pack"))
    return known, known.filter("not has_pack").select("item_id", F.lit(None).cast("date").alias("date"), F.lit("no pack").alias("value"))


@dataclass(frozen=True)
class Check:
    """A check of the report: its occurrences (item_id, date, value) and the rows that it looked at; or why it was not evaluated."""

    name: str
    occurrences: DataFrame | None = None
    base: DataFrame | None = None
    reason: str | None = None
    #: the check is critical too where less than this share of its base is without findings
    least_sound: float | None = None


EXAMPLES = 5


def report(spark: SparkSession, checks: list[Check], limit: float) -> DataFrame:
    """(check, status, reason, base_rows, n, share, critical, examples): a row per check. One that was not evaluated has its reason and no counts, which is not the same as no findings.

    examples: the first five by item, date and value; they are cut before the exchange. critical: the share of findings is above the limit.
    """
    kind = "check string, status string, reason string, least_sound double"
    names = spark.createDataFrame([(c.name, "not evaluated" if c.reason else "evaluated", c.reason, c.least_sound) for c in checks], kind)
    held = [c for c in checks if c.reason is None]
    none = spark.createDataFrame([], "check string, item_id string, date date, value string")
    found, bases = none, spark.createDataFrame([], "check string, base_rows long")
    for c in held:
        found = found.unionByName(c.occurrences.select(F.lit(c.name).alias("check"), F.col("item_id").cast("string").alias("item_id"), "date", "value"))
        bases = bases.unionByName(c.base.agg(F.count("*").alias("base_rows")).select(F.lit(c.name).alias("check"), "base_rows"))
    counts = found.groupBy("check").agg(F.count("*").alias("n"))
    first = found.withColumn("i", F.row_number().over(Window.partitionBy("check").orderBy("item_id", "date", "value"))).filter(F.col("i") <= EXAMPLES)
    shown = first.groupBy("check").agg(F.array_sort(F.collect_list(F.struct("i", "item_id", "date", "value"))).alias("e"))
    rows = names.join(bases, "check", "left").join(counts, "check", "left").join(shown, "check", "left")
    evaluated = F.col("status") == "evaluated"
    n = F.when(evaluated, F.coalesce("n", F.lit(0).cast("long")))
    share = F.when(evaluated, F.coalesce(F.try_divide(n, F.col("base_rows")), F.lit(0.0)))
    critical = evaluated & ((share > limit) | F.coalesce(1 - share < F.col("least_sound"), F.lit(False)))
    examples = F.when(evaluated, F.coalesce(F.transform("e", lambda x: F.struct(x["item_id"].alias("item_id"), x["date"].alias("date"), x["value"].alias("value"))), F.array().cast("array<struct<item_id:string,date:date,value:string>>")))
    return rows.select("check", "status", "reason", "base_rows", n.alias("n"), share.alias("share"), critical.alias("critical"), examples.alias("examples"))


def write_report(spark: SparkSession, checks: list[Check], limit: float, path: str) -> None:
    """The report as two tables: `summary`, a row per check, and `occurrences` of those evaluated, a folder per check."""
    report(spark, checks, limit).write.mode("overwrite").parquet(f"{path}/summary")
    none = spark.createDataFrame([], "check string, item_id string, date date, value string")
    for c in checks:
        if c.reason is None:
            none = none.unionByName(c.occurrences.select(F.lit(c.name).alias("check"), F.col("item_id").cast("string").alias("item_id"), "date", "value"))
    none.write.mode("overwrite").partitionBy("check").parquet(f"{path}/occurrences")


def diff_samples(expected: DataFrame, actual: DataFrame, keys: list[str], samples: int = EXAMPLES) -> DataFrame:
    """(what, n, samples): columns that only one table has, rows that only one has, and per shared column the rows that differ, with the first keys of each and both values as text. What does not differ has no row.

    Keys are unique; nulls equal nulls, in keys too. Samples are cut before the exchange.
    """
    shared = [c for c in expected.columns if c in actual.columns and c not in keys]
    only = [("column only in expected", c) for c in expected.columns if c not in actual.columns] + [("column only in actual", c) for c in actual.columns if c not in expected.columns]
    out = expected.sparkSession.createDataFrame([(f"{why}: {c}",) for why, c in only], "what string").select("what", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("samples"))
    side = lambda df, p: df.select(F.struct(*keys).alias(f"{p}_key"), F.struct(F.lit(1).alias("_"), *shared).alias(p))
    both = side(expected, "x").join(side(actual, "y"), F.col("x_key").eqNullSafe(F.col("y_key")), "full")
    said = [F.when(F.col("y").isNull(), F.struct(F.lit("row only in expected").alias("what"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"))), F.when(F.col("x").isNull(), F.struct(F.lit("row only in actual").alias("what"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y")))]
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    said += [F.when(there & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.struct(F.lit(c).alias("what"), F.col(f"x.{c}").cast("string").alias("x"), F.col(f"y.{c}").cast("string").alias("y"))) for c in shared]
    rows = both.select(F.coalesce("x_key", "y_key").alias("key"), F.explode(F.array_compact(F.array(*said))).alias("d")).select("d.what", F.to_json(F.struct("key", "d.x", "d.y"), {"ignoreNullFields": "false"}).alias("sample"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("what").orderBy("sample"))).filter(F.col("i") <= samples)
    shown = first.groupBy("what").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return out.unionByName(rows.groupBy("what").agg(F.count("*").alias("n")).join(shown, "what").select("what", "n", "samples"))


def table_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one table has, and per column the rows of equal keys that differ, nulls equal to each other.

    Keys are unique and not null in either table. Columns that only one table has are not compared.
    """
    both = [c for c in expected.columns if c in actual.columns and c not in keys]
    left = expected.select(*keys, *(F.col(c).alias(f"x_{c}") for c in both), F.lit(True).alias("in_x"))
    right = actual.select(*keys, *(F.col(c).alias(f"y_{c}") for c in both), F.lit(True).alias("in_y"))
    shared = F.col("in_x").isNotNull() & F.col("in_y").isNotNull()
    checks = {"only in expected": F.col("in_y").isNull(), "only in actual": F.col("in_x").isNull()}
    checks |= {c: shared & ~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")) for c in both}
    return check_summary(left.join(right, keys, "full"), checks).drop("share")
