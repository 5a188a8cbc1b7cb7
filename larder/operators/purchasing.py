"""The purchase list: decisions through guards, supplier rules and the cash rule, in this order, to a main section and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_up_to_pack
from ..sources.intermediate import written
from . import guards, ordering

_PAIR = ["store_id", "item_id"]
#: Rules of the list in their order; the last two are named and not built, as nothing in the data tells of planned promotions or baskets.
RULES = ("coverage cap", "order variation", "new item", "cash", "planned promotion", "anchor item")
NOT_BUILT = RULES[4:]


def alignment_findings(sides: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """key and `missing_from`: for every key that some table has, each table that lacks it. Tables that name the same keys give no rows; what is repeated counts once."""
    rows = None
    for name, df in sides.items():
        part = df.select(*key, F.lit(name).alias("side"))
        rows = part if rows is None else rows.unionByName(part)
    have = rows.groupBy(*key).agg(F.collect_set("side").alias("have"))
    return have.select(*key, F.explode(F.array_except(F.array(*map(F.lit, sides)), F.col("have"))).alias("missing_from"))


def aligned(sides: dict[str, DataFrame], key: list[str]) -> None:
    """Raise where the tables do not name the same keys, with some of them."""
    found = alignment_findings(sides, key).orderBy(*key, "missing_from").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{', '.join(str(r[k]) for k in key)} is not in {r.missing_from}" for r in found))


def cycle_budget(weekly: float | Column, review_days: int | Column) -> Column:
    """The budget of one cycle, from that of a week."""
    return F.lit(weekly) * F.lit(review_days) / 7


def recent_purchases(ledger: DataFrame, as_of, days: int) -> DataFrame:
    """(store_id, item_id, recent_purchase): the mean of the orders placed on the days before as_of, 0 without any."""
    before = ledger.filter(F.col("date").between(F.date_sub(F.lit(as_of), days), F.date_sub(F.lit(as_of), 1)))
    return before.groupBy(*_PAIR).agg(F.coalesce(F.avg(F.when(F.col("order") > 0, F.col("order"))), F.lit(0.0)).alias("recent_purchase"))


def with_category_terms(decisions: DataFrame, terms: DataFrame) -> DataFrame:
    """decisions with their category's terms (category, pack, least_value, shelf_life); a category without terms is an error."""
    lost = [r.category for r in decisions.select("category").distinct().join(terms, "category", "left_anti").orderBy("category").limit(5).collect()]
    if lost:
        raise ValueError(f"no terms for {', '.join(map(str, lost))}")
    return decisions.join(terms, "category")


def mixed_suppliers(decisions: DataFrame) -> DataFrame:
    """Suppliers with items of several categories, whose terms would not be one."""
    return decisions.groupBy("supplier_id").agg(F.countDistinct("category").alias("n_categories")).filter("n_categories > 1")


def guarded(decisions: DataFrame, variation_factor: float) -> DataFrame:
    """decisions (desired, position, daily, shelf_life, risk_window, recent_purchase, is_new, ...) with `quantity` after the item rules, and `guard_flags`.

    The cap holds the orders of known items to what their shelf life or risk window sells; an order far above the recent ones is
    told of, never cut; a new item takes the median of its category's known items after their cap.
    """
    quantity, cut, conflict = ordering.coverage_cap(F.col("desired"), F.col("shelf_life"), F.col("risk_window"), F.col("daily"), F.col("position"))
    rows = decisions.withColumns({"capped": F.round(quantity, 6), "is_capped": ~F.col("is_new") & (cut | conflict)})
    varies = ~F.col("is_new") & (F.col("recent_purchase") > 0) & (F.col("capped") > variation_factor * F.col("recent_purchase"))
    rows = rows.withColumns({"varies": varies, "quantity": F.col("capped")})
    out = ordering.new_item_quantity(rows).withColumn("quantity", F.round("quantity", 6))
    flags = F.array_compact(F.array(F.when(F.col("is_capped"), RULES[0]), F.when(F.col("varies"), RULES[1]), F.when(F.col("is_new"), RULES[2])))
    return out.withColumn("guard_flags", flags).drop("capped", "is_capped", "varies")


def gated(rows: DataFrame, as_of) -> DataFrame:
    """rows (order_days) with `is_open`, whether their supplier takes orders on as_of, and the next day on which it does."""
    ahead = F.transform("order_days", lambda w: F.pmod(w - F.lit(as_of.isoweekday()), F.lit(7)))
    following = F.date_add(F.lit(as_of), F.array_min(F.transform(ahead, lambda k: F.when(k <= 0, k + 7).otherwise(k))).cast("int"))
    return rows.withColumns({"is_open": F.array_contains("order_days", F.lit(as_of.isoweekday()).cast("long")), "next_order_day": following})


def supplier_orders(rows: DataFrame, as_of, most_packs: int) -> tuple[DataFrame, DataFrame]:
    """(orders, adjustments) of guarded rows (supplier_id, order_days, pack, unit_cost, least_value, least_units, ...).

    A supplier that is closed on as_of has empty orders, outcome closed. Of the others quantities are rounded up to packs, then
    filled to the minimum or deferred whole. adjustments: (store_id, supplier_id, item_id, reason, delta_units), a row per reason.
    """
    gate = gated(rows, as_of)
    asked = gate.filter("is_open").withColumn("wanted", F.col("quantity")).withColumn("quantity", round_up_to_pack(F.col("wanted"), F.col("pack")))
    done = written(ordering.filled(written(asked), most_packs))
    closed = gate.filter("not is_open").withColumns({"wanted": F.col("quantity"), "added_packs": F.lit(0).cast("long"), "outcome": F.lit("closed"), "order": F.lit(0.0)})
    orders = done.unionByName(closed)
    key = ["store_id", "supplier_id", "item_id"]
    reached = F.col("quantity") + F.col("added_packs") * F.col("pack")
    said = F.array_compact(F.array(
        F.when(F.col("quantity") != F.col("wanted"), F.struct(F.lit("pack rounding").alias("reason"), F.round(F.col("quantity") - F.col("wanted"), 6).alias("delta_units"))),
        F.when(F.col("added_packs") > 0, F.struct(F.lit("filled to minimum").alias("reason"), (F.col("added_packs") * F.col("pack")).alias("delta_units"))),
        F.when((F.col("outcome") == "deferred") & (reached > 0), F.struct(F.lit("deferred").alias("reason"), (-reached).alias("delta_units"))),
    ))
    return orders, done.select(*key, F.explode(said).alias("a")).select(*key, "a.*")


def purchase_list(decisions: DataFrame, as_of, variation_factor: float, most_packs: int, budget: DataFrame, floor_share: float) -> DataFrame:
    """A row per item of every supplier that is open on as_of: order, value, coverage, all flags, and its section.

    The order of the rules is fixed: item guards, supplier calendar, packs and minimum, then the cash rule over all suppliers of
    a store with its budget (store_id, budget). The cash rule comes last and can take an order below a minimum that it met:
    below_minimum tells where. An order is an exception if a guard or the cash rule has something to say or its supplier's order
    was filled or deferred; rounding to packs alone makes none.
    """
    mixed = mixed_suppliers(decisions).limit(1).collect()
    if mixed:
        raise ValueError(f"supplier {mixed[0].supplier_id} has items of {mixed[0].n_categories} categories")
    orders, _ = supplier_orders(written(guarded(decisions, variation_factor)), as_of, most_packs)
    rows = written(orders.filter("outcome <> 'closed'").withColumn("value", F.round(F.col("order") * F.col("unit_cost"), 6)))
    asked = rows.filter("order > 0").join(budget, "store_id").select("store_id", F.lit(0).alias("scenario"), "item_id", "category", "value", "margin", "budget")
    cash = guards.cash_rule(asked, floor_share).select(*_PAIR, "kept", "cash_flag")
    joined = rows.join(written(cash), _PAIR, "left")
    cut = ~F.coalesce("kept", F.lit(True))
    out = joined.withColumns({"final_order": F.when(cut, 0.0).otherwise(F.col("order")), "final_value": F.when(cut, 0.0).otherwise(F.col("value"))})
    notes = F.array_compact(F.array(F.when(F.col("added_packs") > 0, "filled to minimum"), F.when((F.col("outcome") == "deferred") & (F.col("quantity") + F.col("added_packs") > 0), "deferred")))
    flags = F.concat("guard_flags", notes, F.when(F.col("cash_flag").isNotNull(), F.array(F.concat(F.lit("cash: "), F.col("cash_flag")))).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({"flags": flags, "section": F.when(F.size(flags) > 0, "exceptions").otherwise("main"), "packs": F.col("final_order") / F.col("pack"), "coverage_days": F.when(F.col("daily") > 0, (F.col("position") + F.col("final_order")) / F.col("daily"))})
    totals = out.groupBy("store_id", "supplier_id").agg(F.sum("final_value").alias("v"), F.sum("final_order").alias("u"))
    below = (F.col("outcome") != "deferred") & (((F.col("least_value") > 0) & (F.round("v", 6) < F.col("least_value"))) | ((F.col("least_units") > 0) & (F.round("u", 6) < F.col("least_units"))))
    return out.join(totals, ["store_id", "supplier_id"]).withColumn("below_minimum", below).select(
        "store_id", "supplier_id", "item_id", "category", "section", "outcome", "final_order", "packs", "position", "coverage_days", "final_value", "margin", "flags", "below_minimum", "next_order_day"
    )


def firing_counts(listed: DataFrame) -> DataFrame:
    """(rule, n, status): how many orders each rule has spoken on, 0 included; null for rules that are named and not built."""
    spoken = listed.select(F.explode("flags").alias("f")).select(F.when(F.col("f").startswith("cash: "), "cash").otherwise(F.col("f")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    rules = listed.sparkSession.createDataFrame([(r, "not built" if r in NOT_BUILT else "built") for r in RULES], "rule string, status string")
    return rules.join(spoken, "rule", "left").select("rule", F.when(F.col("status") == "built", F.coalesce("n", F.lit(0).cast("long"))).alias("n"), "status")


def write_list(listed: DataFrame, path: str) -> None:
    """The list as one folder per supplier and section."""
    listed.write.mode("overwrite").partitionBy("supplier_id", "section").parquet(path)
