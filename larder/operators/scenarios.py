"""Choices among scenarios and comparisons of their results, from tables with a row per scenario."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .reporting import DAYS_A_MONTH


def choose(grid: DataFrame, by: list[str], target: float) -> DataFrame:
    """Of each group of grid points (fill_rate, mean_on_hand, place) the one to run: the least stock of those that reach the target, else the highest fill rate; ties go to the first place.

    meets tells which of the two it was.
    """
    meets = F.coalesce(F.col("fill_rate") >= target, F.lit(False))
    order = F.struct(~meets, F.when(meets, F.col("mean_on_hand")).otherwise(-F.coalesce("fill_rate", F.lit(0.0))), "place")
    rows = grid.withColumn("meets", meets)
    return rows.groupBy(*by).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in by)), order).alias("p")).select(*by, "p.*")


def closest(points: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the point (alpha, service_level) whose service is nearest to that of the group's baseline, and how far it is in percentage points; ties go to the smaller alpha."""
    rows = points.join(baseline.select(*by, F.col("service_level").alias("goal")), by).filter("service_level is not null and goal is not null")
    order = F.struct(F.round(F.abs(F.col("service_level") - F.col("goal")), 12), "alpha")
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in by)), order).alias("p")).select(*by, "p.*")
    return best.withColumn("distance_pp", (F.col("service_level") - F.col("goal")) * 100).drop("goal")


def compared(rows: DataFrame, by: list[str], baseline: str, target: float, risk_window: int) -> DataFrame:
    """Each scenario (service_level, decision_metric, mean_capital, coverage_days) beside its group's baseline: gaps in percentage points to the target and the baseline, capital and decision metric in per cent of the baseline's, coverage by the risk window.

    coverage_days is null for a scenario that orders by a forecast. A group without the baseline has nulls.
    """
    base = rows.filter(F.col("scenario") == baseline).select(*by, F.col("service_level").alias("b_service"), F.col("decision_metric").alias("b_metric"), F.col("mean_capital").alias("b_capital"))
    of = lambda a, b: (F.try_divide(a, b) - 1) * 100
    return rows.join(base, by, "left").select(
        *by, "scenario", "service_level", ((F.lit(target) - F.col("service_level")) * 100).alias("gap_to_target_pp"), ((F.col("b_service") - F.col("service_level")) * 100).alias("gap_to_baseline_pp"),
        "decision_metric", of("decision_metric", "b_metric").alias("decision_vs_baseline_pct"), "mean_capital", of("mean_capital", "b_capital").alias("capital_vs_baseline_pct"), (F.col("coverage_days") / risk_window).alias("coverage_by_window"),
    )


def _beside(rows: DataFrame, by: list[str], names: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """A row per group with columns such as stale_margin for each scenario and column."""
    pick = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c))).alias(f"{s}_{c}")
    return rows.groupBy(*by).agg(*(pick(s, c) for s in names for c in columns))


def gain_split(rows: DataFrame, by: list[str], stale: str, recalibrated: str, model: str) -> DataFrame:
    """What recalibrating brings and what the model brings after it: by decision metric, which is not comparable across service levels, and by the service gap that each closes, in percentage points."""
    r = _beside(rows, by, (stale, recalibrated, model), ("decision_metric", "service_level"))
    minus = lambda a, b, c: F.col(f"{a}_{c}") - F.col(f"{b}_{c}")
    gap, more = minus(recalibrated, stale, "service_level") * 100, minus(model, recalibrated, "service_level") * 100
    return r.select(
        *by, minus(model, stale, "decision_metric").alias("gain"), minus(recalibrated, stale, "decision_metric").alias("gain_by_recalibration"), minus(model, recalibrated, "decision_metric").alias("gain_by_model"),
        gap.alias("gap_pp"), gap.alias("closed_by_recalibration_pp"), more.alias("closed_by_model_pp"), F.when(gap != 0, F.lit(100.0)).alias("closed_by_recalibration_pct"),
    )


def gains(rows: DataFrame, by: list[str], worse: str, better: str) -> DataFrame:
    """What one scenario saves against another: stockout cost and loss avoided, capital freed (negative where more is held)."""
    r = _beside(rows, by, (worse, better), ("stockout_cost", "mean_capital", "loss"))
    minus = lambda c: F.col(f"{worse}_{c}") - F.col(f"{better}_{c}")
    return r.select(*by, minus("stockout_cost").alias("stockout_avoided"), minus("mean_capital").alias("capital_freed"), minus("loss").alias("loss_avoided"))


def monthly_report(rows: DataFrame, by: list[str], stale: str, recalibrated: str, model: str) -> DataFrame:
    """The month's report as one long table (by, section, indicator, scenario, value): the scenarios' figures, what recalibrating brings and asks for, and what the model brings on top. Money that adds up over days is that of a month of 30 days."""
    month = F.lit(float(DAYS_A_MONTH)) / F.col("n_days")
    indicators = {"margin": F.col("margin") * month, "stockout_cost": F.col("stockout_cost") * month, "loss": F.col("loss") * month, "mean_capital": F.col("mean_capital"), "service_level": F.col("service_level"), "decision_metric": F.col("decision_metric")}
    long = lambda df, section, scenario, values: df.select(*by, F.lit(section).alias("section"), scenario.alias("scenario"), F.explode(F.array(*(F.struct(F.lit(k).alias("indicator"), v.cast("double").alias("value")) for k, v in values.items()))).alias("e")).select(*by, "section", "e.indicator", "scenario", "e.value")
    of_month = rows.withColumns({"stockout_cost": F.col("stockout_cost") * month, "loss": F.col("loss") * month})
    first, second = gains(of_month, by, stale, recalibrated), gains(of_month, by, recalibrated, model)
    out = long(rows, "scenarios", F.col("scenario"), indicators)
    out = out.unionByName(long(first, "recalibration", F.lit(f"{stale} to {recalibrated}"), {"stockout_avoided": F.col("stockout_avoided"), "capital_added": -F.col("capital_freed"), "loss_avoided": F.col("loss_avoided")}))
    return out.unionByName(long(second, "model", F.lit(f"{recalibrated} to {model}"), {c: F.col(c) for c in ("stockout_avoided", "capital_freed", "loss_avoided")}))


def spread(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Least, largest, median, and nearest-rank 10th and 90th percentile of a column per group; nulls are left out."""
    known = rows.filter(F.col(column).isNotNull())
    order = Window.partitionBy(*by).orderBy(column)
    ranked = known.select(*by, column, F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    at = lambda q: F.max(F.when(F.col("r") == F.floor(q * (F.col("n") - 1) + 0.5) + 1, F.col(column)))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("largest"), F.median(column).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"))


def cells(base: DataFrame, grid: DataFrame) -> DataFrame:
    """base, once for each row of a grid of parameters, whose columns take the place of base's; the grid is a table of parameters, of a few rows."""
    return base.drop(*grid.columns).crossJoin(F.broadcast(grid))


def check_alphas(alphas: tuple[float, ...], quantiles: tuple[float, ...]) -> None:
    """An alpha that is not among the forecast's quantiles is an error: nothing is interpolated."""
    lost = [a for a in alphas if a not in quantiles]
    if lost:
        raise ValueError(f"no forecasts for alpha {', '.join(map(str, lost))}; quantiles are {', '.join(map(str, quantiles))}")


def assumptions(spark: SparkSession, params: Any, origins: dict[str, str], run: str) -> DataFrame:
    """(run, name, value, origin): every parameter of a run as JSON, and whether it was measured, assumed or is the data's default; a parameter without a known origin is assumed."""
    unknown = sorted(set(origins) - {f.name for f in dataclasses.fields(params)})
    if unknown:
        raise ValueError(f"no such parameters: {', '.join(unknown)}")
    rows = [(run, k, json.dumps(v, default=str), origins.get(k, "assumed")) for k, v in dataclasses.asdict(params).items()]
    return spark.createDataFrame(rows, "run string, name string, value string, origin string")
