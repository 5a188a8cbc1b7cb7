"""Findings over a table: keys, nulls, bounds and references. Callers decide whether a finding is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, NullType, StructType


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """How many keys stand in several rows, and how many rows these are."""
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return twice.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_rows"))


def column_findings(df: DataFrame, required: list[str], at_least: dict[str, float], one_of: dict[str, list[str]]) -> DataFrame:
    """(rule, column, n): nulls in required columns, values under a bound, values outside a set; null passes the latter two. One pass."""
    rules = [("null", c, F.col(c).isNull()) for c in required]
    rules += [("bound", c, F.col(c) < b) for c, b in at_least.items()] + [("values", c, ~F.col(c).isin(v)) for c, v in one_of.items()]
    counts = df.agg(*(F.count_if(flag).alias(f"n{i}") for i, (_, _, flag) in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, (rule, c, _) in enumerate(rules)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of column that the parent lacks, with their rows."""
    missing = child.filter(F.col(column).isNotNull()).join(parent, F.col(column) == F.col(parent_column), "left_anti")
    return missing.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rows"))


def schema_findings(df: DataFrame, expected: StructType) -> list[tuple[str, str, str]]:
    """(rule, column, what) for missing and undeclared columns and types that do not fit. A column of nulls fits any type, and whole numbers fit where
    fractions are expected, not the other way round. Nothing is read."""
    found, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    out = [("missing", c, want[c].simpleString()) for c in want if c not in found] + [("undeclared", c, found[c].simpleString()) for c in found if c not in want]
    for c, kind in want.items():
        have = found.get(c, kind)
        if have != kind and not isinstance(have, NullType) and not (isinstance(have, LongType) and isinstance(kind, DoubleType)):
            out.append(("type", c, f"{have.simpleString()} where {kind.simpleString()} is expected"))
    return out


def require(name: str, schema: list[tuple[str, str, str]], counted: DataFrame | None = None) -> None:
    """Raise once, with all findings of a table; counted: the result of column_findings(), a row per rule."""
    found = [f"{c}: {rule} ({what})" for rule, c, what in schema]
    found += [f"{r['column_name']}: {r['rule']} ({r['n']} rows)" for r in (counted.filter("n > 0").collect() if counted is not None else ())]
    if found:
        raise ValueError(f"{name}: " + "; ".join(found))


def array_findings(df: DataFrame, column: str, least: int, low: int, high: int) -> DataFrame:
    """Rows whose array is too short, and rows with an element out of bounds."""
    out = F.exists(column, lambda x: (x < low) | (x > high))
    return df.agg(F.count_if(F.size(column) < least).alias("n_short"), F.count_if(out).alias("n_out_of_bounds"), F.count("*").alias("n_rows"))


def largest_cyclic_gap(days: Column) -> Column:
    """The most days between two order days (ISO weekdays) that follow each other, over the week's end too."""
    sorted_ = F.array_sort(F.array_distinct(days))
    shifted = F.concat(F.slice(sorted_, 2, 7), F.array(F.element_at(sorted_, 1) + 7))
    return F.array_max(F.zip_with(sorted_, shifted, lambda a, b: b - a))


def cadence_findings(suppliers: DataFrame, key: str, days: str, review: Column) -> DataFrame:
    """Suppliers whose review period is shorter than the largest gap of their order days."""
    return suppliers.select(key, largest_cyclic_gap(F.col(days)).cast("long").alias("gap"), review.cast("long").alias("review_days")).filter("gap > review_days")
