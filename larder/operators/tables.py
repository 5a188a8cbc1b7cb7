"""Contracts of tables: their fields compiled into a schema, and all findings of a table in one result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType

from .contracts import schema_findings

_TYPES: dict[str, DataType] = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "longs": ArrayType(LongType())}
#: Rows shown of each finding.
SAMPLES = 5


@dataclass(frozen=True)
class Field:
    """A column: its kind, whether it must have values, and what these must be. Of an array, the bounds hold for its elements."""

    name: str
    kind: str
    required: bool = True
    at_least: float | None = None
    above: float | None = None
    at_most: float | None = None
    one_of: tuple[str, ...] = ()
    least_size: int = 0

    def rules(self) -> list[tuple[str, Column]]:
        """(rule, whether a row breaks it) of the values; null breaks none."""
        c, out = F.col(self.name), []
        bounds = [(f">= {self.at_least:g}", lambda x: x < self.at_least)] if self.at_least is not None else []
        bounds += [(f"> {self.above:g}", lambda x: x <= self.above)] if self.above is not None else []
        bounds += [(f"<= {self.at_most:g}", lambda x: x > self.at_most)] if self.at_most is not None else []
        for text, breaks in bounds:
            out.append((f"element {text}", F.exists(c, breaks)) if self.kind == "longs" else (text, breaks(c)))
        if self.one_of:
            out.append((f"one of {', '.join(self.one_of)}", ~c.isin(*self.one_of)))
        if self.least_size:
            out.append((f"size >= {self.least_size}", F.when(c.isNotNull(), F.size(c) < self.least_size)))
        return out


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = ()
    #: column -> (table, its column) that must hold every value
    references: dict[str, tuple[str, str]] = field(default_factory=dict)

    def schema(self) -> StructType:
        """All columns can hold nulls: nulls are counted, not refused by a reader."""
        return StructType([StructField(f.name, _TYPES[f.kind], True) for f in self.fields])

    def with_required(self, *names: str) -> Contract:
        """The contract with more columns that must have values, as when a source is known to have them."""
        unknown = set(names) - {f.name for f in self.fields}
        if unknown:
            raise ValueError(f"{self.name} has no such columns: {', '.join(sorted(unknown))}")
        return Contract(self.name, tuple(Field(**{**f.__dict__, "required": f.required or f.name in names}) for f in self.fields), self.key, self.references)


def _sample(columns: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"})


def findings(df: DataFrame, contract: Contract, tables: dict[str, DataFrame] | None = None, samples: int = SAMPLES) -> DataFrame:
    """(table_name, rule, column_name, n, samples): everything that is wrong with df, in one result; empty where nothing is.

    n counts rows: for duplicate keys all rows of such keys, for references all rows whose value the other table lacks; it is
    null for missing and undeclared columns and wrong types, whose columns are not looked at further. samples: at most so many
    rows as JSON, the first by that text. References to tables that are not given are not evaluated.

    One scan counts all rules of values, one the samples of rows that break some; keys and references take an exchange each.
    Samples are cut before the exchange, so a rule that all rows break costs no more.
    """
    structural = schema_findings(df, contract.schema())
    bad = {c for _, c, _ in structural}
    good = [f for f in contract.fields if f.name not in bad]
    spark, columns = df.sparkSession, [f.name for f in good]
    out = spark.createDataFrame([(contract.name, f"{rule}: {what}" if rule == "type" else rule, c) for rule, c, what in structural], "table_name string, rule string, column_name string").select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("samples"))
    rules = [(f.name, "null", F.col(f.name).isNull()) for f in good if f.required] + [(f.name, rule, breaks) for f in good for rule, breaks in f.rules()]
    if rules:
        broken = F.array_compact(F.array(*(F.when(breaks, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name"))) for c, rule, breaks in rules)))
        rows = df.select(F.explode(broken).alias("r"), _sample(columns).alias("sample")).select("r.*", "sample")
        out = out.unionByName(_counted(rows, contract.name, samples))
    if contract.key and set(contract.key) <= set(columns):
        key = list(contract.key)
        twice = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        same = None
        for c in key:
            each = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
            same = each if same is None else same & each
        rows = df.alias("l").join(twice.alias("r"), same, "left_semi").select(F.lit("duplicate key").alias("rule"), F.lit(", ".join(key)).alias("column_name"), _sample(columns).alias("sample"))
        out = out.unionByName(_counted(rows, contract.name, samples))
    for c, (other, its) in contract.references.items():
        if c in columns and tables and other in tables:
            rows = df.filter(F.col(c).isNotNull()).join(tables[other].select(F.col(its).alias("_")), F.col(c) == F.col("_"), "left_anti")
            rows = rows.select(F.lit(f"not in {other}").alias("rule"), F.lit(c).alias("column_name"), _sample(columns).alias("sample"))
            out = out.unionByName(_counted(rows, contract.name, samples))
    return out


def _counted(rows: DataFrame, name: str, samples: int) -> DataFrame:
    by = ["rule", "column_name"]
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("sample"))).filter(F.col("i") <= samples)
    shown = first.groupBy(*by).agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return rows.groupBy(*by).agg(F.count("*").alias("n")).join(shown, by).select(F.lit(name).alias("table_name"), *by, "n", "samples")


def require(found: DataFrame) -> None:
    """Raise once, with everything that findings() tells."""
    said = [f"{r.table_name}.{r.column_name}: {r.rule}" + (f" ({r.n} rows, as {r.samples[0]})" if r.n else "") for r in found.collect()]
    if said:
        raise ValueError("; ".join(sorted(said)))


# Names, kinds and bounds of the canonical tables.
_PAIR = (Field("store_id", "string"), Field("item_id", "string"))
SALES = Contract(
    "sales",
    (*_PAIR, Field("date", "date"), Field("units_sold", "double", at_least=0), Field("units_returned", "double", False, at_least=0), Field("on_promo", "boolean", False), Field("price", "double", False, at_least=0), Field("is_operating_day", "boolean"), Field("is_anomaly", "boolean"), Field("anomaly_reason", "string", False)),
    ("store_id", "item_id", "date"), {"item_id": ("items", "item_id")},
)
STOCK = Contract("stock", (*_PAIR, Field("date", "date"), Field("on_hand", "double", at_least=0), Field("in_transit", "double", False, at_least=0)), ("store_id", "item_id", "date"), {"item_id": ("items", "item_id")})
ENTRIES = Contract("entries", (*_PAIR, Field("received_date", "date"), Field("quantity", "double", above=0), Field("order_date", "date", False), Field("supplier_id", "string", False)))
ITEMS = Contract(
    "items",
    (Field("item_id", "string"), Field("ean", "string", False), Field("description", "string", False), Field("category", "string"), Field("item_class", "string", False), Field("supplier_id", "string"), Field("unit_of_sale", "string", one_of=("unidade", "kg")), Field("pack_multiple", "double", False, above=0), Field("is_perishable", "boolean"), Field("is_anchor", "boolean", False), Field("cost", "double", False, at_least=0), Field("price_ref", "double", False, at_least=0), Field("economics_origin", "string")),
    ("item_id",), {"supplier_id": ("suppliers", "supplier_id")},
)
SUPPLIERS = Contract(
    "suppliers",
    (Field("supplier_id", "string"), Field("lead_time_days", "long", above=0), Field("order_days", "longs", at_least=1, at_most=7, least_size=1), Field("review_period_days", "long", above=0), Field("min_order_value", "double", at_least=0), Field("min_order_units", "double", at_least=0)),
    ("supplier_id",),
)
