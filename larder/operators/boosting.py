"""Gradient boosting with the pinball loss: one model per quantile and key, all of them grown together by aggregations over the whole panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.intermediate import dropped, written


@dataclass(frozen=True)
class Boosting:
    quantiles: tuple[float, ...]
    rounds: int = 50
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    #: rows that each side of a split must have
    least_rows: int = 20
    #: targets and residuals are told apart by so many decimals when a leaf's quantile is sought
    places: int = 3


#: A split that gains less is none; gains are compared to so many decimals, as sums of doubles end in other last bits.
_GAIN, _PLACES = 1e-7, 7


def cut_points(rows: DataFrame, features: tuple[str, ...], bins: int) -> list[list[float]]:
    """Of each feature the values that part its bins: evenly spaced quantiles of all rows, one mergeable sketch each. Bounded by features times bins."""
    at = F.array(*(F.lit((k + 1) / bins) for k in range(bins - 1)))
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), at, 10 * bins * bins).alias(f"c{i}") for i, c in enumerate(features))).first()
    return [sorted(set(found[i] or [])) for i in range(len(features))]


def _binned(features: tuple[str, ...], cuts: list[list[float]]) -> Column:
    """The number of each feature's bin, as an array: how many cuts lie below it; 0 for null, which is less than any value."""
    below = lambda c, points: F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p < F.col(c).cast("double"))) + 1 if points else F.lit(1)
    return F.array(*(F.when(F.col(c).isNull(), 0).otherwise(below(c, points)).cast("int") for c, points in zip(features, cuts, strict=True)))


def _quantile(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, and the least value up to which the weights make up the share `q` of all; values are counted before they are ordered."""
    counted = rows.groupBy(*by, "q", value).agg(F.sum(weight).alias("w"))
    key = Window.partitionBy(*by)
    run = counted.withColumns({"below": F.sum("w").over(key.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(key)})
    return run.filter(F.col("below") >= F.col("q") * F.col("all") - 1e-9).groupBy(*by).agg(F.min(value).alias("value"))


def best_splits(histogram: DataFrame, least_rows: int) -> DataFrame:
    """(model, k, node, feature, cut): of each node the split that lowers the squared gradients' sum most, where one does; ties go to the first feature, then the least cut.

    histogram: (model, k, node, feature, bin, g, w, n), the sums of a bin's gradients, weights and rows. Bins up to `cut` go left.
    """
    node = ["model", "k", "node"]
    run = Window.partitionBy(*node, "feature")
    left = run.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram.select(*node, "feature", "bin", *(F.sum(c).over(left).alias(f"{c}l") for c in "gwn"), *(F.sum(c).over(run).alias(c) for c in "gwn"))
    part = lambda g, w: F.when(w > 0, g * g / w).otherwise(0.0)
    gain = part(F.col("gl"), F.col("wl")) + part(F.col("g") - F.col("gl"), F.col("w") - F.col("wl")) - part(F.col("g"), F.col("w"))
    fit = sums.filter((F.col("nl") >= least_rows) & (F.col("n") - F.col("nl") >= least_rows)).withColumn("gain", F.round(gain, _PLACES)).filter(F.col("gain") > _GAIN)
    best = fit.groupBy(*node).agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("s"))
    return best.select(*node, (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("cut"))


def train(rows: DataFrame, key: str, features: tuple[str, ...], target: str, weight: str, how: Boosting) -> DataFrame:
    """(key, quantile, round, node, feature, cut, value): the nodes of all trees, round 0 with the quantile of all targets alone.

    Each round adds to every model a tree grown level by level on the gradients of the pinball loss; what a leaf adds is the
    quantile of its rows' residuals, times the rate. Per level there is one aggregation of gradients by model, node, feature and
    bin, combined before the exchange, and per round one of residuals by leaf; the rows with their forecasts are written once a
    round. Only splits and leaf values, bounded by models times nodes, reach the driver. Features are numbers; null lies below
    every value. Rows without a target or key take no part. Nodes are numbered from 1, those below node i are 2i and 2i + 1;
    a node of feature null is a leaf. An inner node sends values up to `cut`, and null, to the left.
    """
    spark = rows.sparkSession
    sound = rows.filter(F.col(key).isNotNull() & F.col(target).isNotNull())
    cuts = cut_points(sound, features, how.bins)
    qs = F.array(*map(F.lit, how.quantiles))
    flat = sound.select(F.col(key).alias("model"), F.col(target).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), _binned(features, cuts).alias("x"))
    each = flat.select("model", "w", F.round("y", how.places).alias("v"), F.posexplode(qs).alias("k", "q"))
    start = _quantile(each, ["model", "k"], "v", "w").collect()
    out = [(r.model, how.quantiles[r.k], 0, 1, None, None, r.value) for r in start]
    kinds = f"model {sound.schema[key].dataType.simpleString()}"
    first = spark.createDataFrame([(m, [next(r.value for r in start if r.model == m and r.k == k) for k in range(len(how.quantiles))]) for m in sorted({r.model for r in start})], f"{kinds}, f array<double>")
    state = written(flat.join(F.broadcast(first), "model"))
    for turn in range(1, how.rounds + 1):
        # a row stands once for each quantile, with the node that it has reached
        grown = state.select("model", "w", "y", "x", F.posexplode(F.arrays_zip(F.col("f"), qs.alias("q"))).alias("k", "z")).select("model", "w", "y", "x", "k", F.col("z.f").alias("f"), F.col("z.q").alias("q"))
        grown = grown.withColumns({"g": F.col("w") * (F.when(F.col("y") < F.col("f"), 1.0).otherwise(0.0) - F.col("q")), "node": F.lit(1)})
        splits: list[tuple] = []
        for level in range(how.depth):
            at = _descend(grown, splits, kinds, level)
            sums = at.filter(F.col("node") >= 1 << level).select("model", "k", "node", "g", "w", F.posexplode("x").alias("feature", "bin")).groupBy("model", "k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("w").alias("w"), F.count("*").alias("n"))
            found = [tuple(r) for r in best_splits(sums, how.least_rows).collect()]
            if not found:
                break
            splits += found
        at = _descend(grown, splits, kinds, how.depth)
        leaves = _quantile(at.withColumn("v", F.round(F.col("y") - F.col("f"), how.places)), ["model", "k", "node"], "v", "w").collect()
        values = {(r.model, r.k, r.node): r.value * how.rate for r in leaves}
        for model, k, node, feature, cut in splits:
            points = cuts[feature]
            out.append((model, how.quantiles[k], turn, node, features[feature], points[cut - 1] if cut else None, None))
        out += [(model, how.quantiles[k], turn, node, None, None, value) for (model, k, node), value in values.items()]
        if turn < how.rounds:
            trees = _as_trees(spark, kinds, splits, values, len(how.quantiles))
            moved = state.join(F.broadcast(trees), "model").withColumn("f", F.expr(_MOVE.format(walk=_walk(how.depth, 'trees[j].splits')))).select("model", "y", "w", "x", "f")
            after = written(moved)
            dropped(state)
            state = after
    dropped(state)
    return spark.createDataFrame(out, f"{key} {sound.schema[key].dataType.simpleString()}, quantile double, round int, node int, feature string, cut double, value double")


def _descend(rows: DataFrame, splits: list[tuple], kinds: str, levels: int) -> DataFrame:
    """rows with the node that they reach by the splits found so far, a table bounded by models times nodes."""
    if not splits:
        return rows
    by: dict[tuple, dict] = {}
    for model, k, node, feature, cut in splits:
        by.setdefault((model, k), {})[node] = (feature, cut)
    table = rows.sparkSession.createDataFrame([(m, k, s) for (m, k), s in by.items()], f"{kinds}, k int, splits map<int, struct<feature:int,cut:int>>")
    return rows.join(F.broadcast(table), ["model", "k"], "left").withColumn("node", F.expr(_walk(levels, "splits"))).drop("splits")


def _walk(levels: int, splits: str) -> str:
    """SQL for the node that a row `x` (bins or values, null on the left) reaches by a map of splits."""
    left = f"x[{splits}[i].feature] is null or x[{splits}[i].feature] <= {splits}[i].cut"
    return f"aggregate(sequence(1, {levels}), 1, (i, d) -> case when {splits}[i] is null then i when {left} then 2 * i else 2 * i + 1 end)" if levels else "1"


#: The forecasts of all quantiles, each moved by its tree.
_MOVE = "transform(f, (v, j) -> v + coalesce(trees[j].values[{walk}], 0.0D))"


def _as_trees(spark, kinds: str, splits: list[tuple], values: dict[tuple, float], quantiles: int) -> DataFrame:
    models: dict = {}
    for model, k, node in values:
        models.setdefault(model, [({}, {}) for _ in range(quantiles)])[k][1][node] = values[model, k, node]
    for model, k, node, feature, cut in splits:
        models[model][k][0][node] = (feature, cut)
    return spark.createDataFrame(list(models.items()), f"{kinds}, trees array<struct<splits:map<int,struct<feature:int,cut:int>>,values:map<int,double>>>")


def predict(rows: DataFrame, key: str, trees: DataFrame, features: tuple[str, ...], depth: int, quantiles: tuple[float, ...]) -> DataFrame:
    """rows with `forecast`, an array of (quantile, value) in the order of quantiles: the sums of what each tree's leaf adds. A row whose key has no model has null.

    The trees of a key are one row, of a size that the training's parameters bound; they are joined, not sent along with each task.
    """
    number = F.array_position(F.array(*map(F.lit, features)), F.col("feature")).cast("int") - 1
    node = F.struct(F.col("node"), F.struct(number.alias("feature"), F.col("cut")).alias("s"))
    per = trees.groupBy(key, "quantile", "round").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), node))).alias("splits"),
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("node", "value")))).alias("values"),
    )
    in_turn = F.array_sort(F.collect_list(F.struct("round", "splits", "values")), lambda a, b: a["round"] - b["round"])
    models = per.groupBy(key, "quantile").agg(in_turn.alias("t")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("quantile", "t"))).alias("trees"))
    qs = ", ".join(f"{q}D" for q in quantiles)
    value = f"transform(array({qs}), q -> named_struct('quantile', q, 'value', aggregate(trees[q], 0.0D, (a, t) -> a + coalesce(t.values[{_walk(depth, 't.splits')}], 0.0D))))"
    joined = rows.withColumn("x", F.array(*(F.col(c).cast("double") for c in features))).join(models, key, "left")
    return joined.withColumn("forecast", F.expr(value)).withColumn("forecast", F.when(F.col("trees").isNotNull(), F.col("forecast"))).drop("x", "trees")
