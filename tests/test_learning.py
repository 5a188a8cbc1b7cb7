import datetime as dt

import numpy as np
import pytest
from larder.operators import boosting, features
from pyspark.sql import functions as F

DAY = dt.date(2020, 3, 2)
HISTORY = "store_id string, item_id string, date date, units_sold double, on_promo boolean"


def _history(spark, rows):
    return spark.createDataFrame([("s", i, DAY + dt.timedelta(k), u, p) for i, k, u, p in rows], HISTORY)


def _asked(spark, *rows):
    return spark.createDataFrame([("s", i, DAY + dt.timedelta(k)) for i, k in rows], "store_id string, item_id string, as_of date")


def test_feature_rows_of_items_without_history(spark):
    history = _history(spark, [("a", -1, 4.0, True), ("a", -3, 2.0, None), ("a", -7, 0.0, False), ("a", 0, 99.0, True), ("a", 1, 99.0, True), ("b", 5, 1.0, None)])
    got = {r.item_id: r for r in features.history_features(history, _asked(spark, ("a", 0), ("b", 0), ("c", 0)), (1, 2), (3, 7)).collect()}
    a = got["a"]
    assert (a.lag_units_1, a.lag_units_2, a.rolling_mean_units_3d, a.rolling_sum_units_7d, a.days_since_last_sale, a.days_since_last_promo) == (4.0, None, 3.0, 6.0, 1, 1)
    assert a.share_days_with_sale_7d == pytest.approx(2 / 3) and a.promo_share_7d == pytest.approx(1 / 3) and a.promo_known_share_7d == pytest.approx(2 / 3)
    for item in "bc":
        assert all(v is None for k, v in got[item].asDict().items() if k not in ("store_id", "item_id", "as_of"))


def test_features_do_not_see_what_follows(spark):
    rows = [("a", k, float(k % 4), k % 3 == 0) for k in range(-40, 0)]
    bait = [("a", k, 999.0, True) for k in range(20)]
    asked = _asked(spark, ("a", 0), ("a", -10), ("b", 0))
    make = lambda rows: sorted(map(str, features.history_features(_history(spark, rows), asked, (1, 7), (7, 28)).collect()))
    assert make(rows) == make(rows + bait)


def test_dates_of_a_stack_do_not_touch_each_other(spark):
    rows = [("a", k, float(k % 4), None) for k in range(-40, 0)]
    history = _history(spark, rows)
    one = lambda *ks: {r.as_of: r for k in ks for r in features.history_features(history, _asked(spark, ("a", k)), (1,), (7,)).collect()}
    assert {r.as_of: r for r in features.history_features(history, _asked(spark, ("a", -5), ("a", -6), ("a", 0)), (1,), (7,)).collect()} == one(-5, -6, 0)


def test_censored_days_are_no_history(spark):
    history = _history(spark, [("a", -1, 0.0, None), ("a", -2, 6.0, None)])
    flags = spark.createDataFrame([("s", "a", DAY - dt.timedelta(1), True), ("s", "a", DAY - dt.timedelta(2), False)], "store_id string, item_id string, date date, is_censored boolean")
    row = features.history_features(history, _asked(spark, ("a", 0)), (1,), (7,), flags).first()
    assert row.lag_units_1 is None and row.rolling_mean_units_7d == 6.0


def test_unknown_features_are_named(spark):
    with pytest.raises(ValueError, match="no such features: b, z"):
        features.active_columns(spark.createDataFrame([("s", "i", DAY, 1)], "store_id string, item_id string, as_of date, a int"), ("a", "b", "z"))


def test_absent_days_count_as_nothing_sold(spark):
    history = _history(spark, [("a", 0, 1.0, None), ("a", 2, 5.0, None), ("a", 3, 7.0, None), ("b", 9, 1.0, None)])
    asked = _asked(spark, ("a", 0), ("a", 1), ("b", 0), ("c", 0)).withColumn("horizon", F.when(F.col("item_id") == "a", 3).otherwise(2))
    got = {(r.item_id, r.as_of): r.target for r in features.window_targets(history, asked).collect()}
    assert got == {("a", DAY): 6.0, ("a", DAY + dt.timedelta(1)): 12.0, ("b", DAY): 0.0, ("c", DAY): 0.0}


def test_codes_come_from_the_whole_registry(spark):
    items = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("10",), ("9",)], "category string")
    assert {r.category: r.code for r in features.category_codes(items, "category").collect()} == {"10": 0, "9": 1, "a": 2, "b": 3}


def test_too_few_origins_are_an_error(spark):
    asked = _asked(spark, *(("a", -7 * k) for k in range(5))).withColumn("horizon", F.lit(10))
    retrains = spark.createDataFrame([(DAY,)], "retrain date")
    assert {r.as_of for r in features.usable_origins(asked, retrains, 3).collect()} == {DAY - dt.timedelta(7 * k) for k in (2, 3, 4)}
    with pytest.raises(ValueError, match="2020-03-02: 3"):
        features.usable_origins(asked, retrains, 4)


def plain_quantile(values, weights, q, places=3):
    order = np.argsort(values, kind="stable")
    run = np.cumsum(weights[order])
    return np.round(values, places)[order][np.flatnonzero(run >= q * run[-1] - 1e-9)[0]]


def plain_train(x, y, w, q, how):
    """The same trees row by row: every cut of every feature is tried at every node."""
    f = np.full(len(y), plain_quantile(y, w, q, how.places))
    trees = []
    for turn in range(1, how.rounds + 1):
        g, node = w * ((y < f) - q), np.ones(len(y), int)
        splits = {}
        for level in range(how.depth):
            for at in sorted(set(node[node >= 1 << level].tolist())):
                rows = node == at
                best = None
                for j in range(x.shape[1]):
                    for cut in sorted(set(x[rows, j].tolist())):
                        left, right = rows & (x[:, j] <= cut), rows & (x[:, j] > cut)
                        if left.sum() < how.least_rows or right.sum() < how.least_rows:
                            continue
                        gain = round(g[left].sum() ** 2 / w[left].sum() + g[right].sum() ** 2 / w[right].sum() - g[rows].sum() ** 2 / w[rows].sum(), 7)
                        if gain > 1e-7 and (best is None or gain > best[0]):
                            best = gain, j, cut
                if best:
                    splits[at] = best[1:]
            for at, (j, cut) in splits.items():
                rows = node == at
                node[rows] = np.where(x[rows, j] <= cut, 2 * at, 2 * at + 1)
        leaves = {at: plain_quantile((y - f)[node == at], w[node == at], q, how.places) * how.rate for at in sorted(set(node.tolist()))}
        f = f + np.array([leaves[at] for at in node.tolist()])
        trees.append((splits, leaves))
    return trees, f


def test_trees_by_brute_force(spark):
    rng = np.random.default_rng(3)
    n, how = 240, boosting.Boosting((0.5, 0.9), rounds=4, depth=2, rate=0.5, bins=64, least_rows=10)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 3, n)], 1).astype(float)
    y = np.round(3 * x[:, 0] + np.where(x[:, 1] > 2, 20, 0) + rng.gamma(2, 3, n), 2)
    w = rng.choice([1.0, 0.5, 0.25], n)
    missing = x.copy()
    missing[x[:, 2] == 0, 2] = np.nan
    rows = spark.createDataFrame([("m", *(None if v != v else v for v in r), float(a), float(b)) for r, a, b in zip(missing.tolist(), y, w, strict=True)], "model string, a double, b double, c double, y double, w double")
    trees = boosting.train(rows, "model", ("a", "b", "c"), "y", "w", how)
    nodes = trees.collect()
    fits = [{(r.a, r.b, r.c): [v.value for v in r.forecast] for r in boosting.predict(rows, "model", trees, ("a", "b", "c"), how.depth, how.quantiles).collect()}]
    for k, q in enumerate(how.quantiles):
        want, f = plain_train(x, y, w, q, how)
        for turn, (splits, leaves) in enumerate(want, 1):
            own = {r.node: r for r in nodes if r.quantile == q and r.round == turn}
            for at, (j, cut) in splits.items():
                assert own[at].feature == "abc"[j]
                assert own[at].cut == (cut or None) if j == 2 else own[at].cut == cut
            assert {at: r.value for at, r in own.items() if r.feature is None} == pytest.approx(leaves)
        for row, value in zip(missing.tolist(), f.tolist(), strict=True):
            assert fits[0][tuple(None if v != v else v for v in row)][k] == pytest.approx(value)


def test_boosting_beats_one_quantile_for_all(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 1500)
    rows = spark.createDataFrame([(int(k % 2), float(v), float(100 * v * (1 + k % 2) + rng.exponential(10)), 1.0) for k, v in enumerate(x)] + [(None, 0.5, 1.0, 1.0), (0, 0.5, None, 1.0)], "model int, x double, y double, w double")
    how = boosting.Boosting((0.5, 0.9), rounds=12, depth=2, rate=0.4, least_rows=20)
    trees = boosting.train(rows, "model", ("x",), "y", "w", how)
    got = boosting.predict(rows.filter("model is not null and y is not null"), "model", trees, ("x",), how.depth, how.quantiles).collect()
    flat = {(r.model, r.quantile): r.value for r in trees.filter("round = 0").collect()}
    for k, q in enumerate(how.quantiles):
        loss = lambda e, q=q: max(q * e, (q - 1) * e)
        assert sum(loss(r.y - r.forecast[k].value) for r in got) < 0.5 * sum(loss(r.y - flat[r.model, q]) for r in got)
        assert np.mean([r.y <= r.forecast[k].value for r in got]) == pytest.approx(q, abs=0.04)
    assert boosting.predict(rows.filter("model is null"), "model", trees, ("x",), how.depth, how.quantiles).first().forecast is None


def test_the_model_reads_the_lines_once(spark, monkeypatch):
    from larder.plans import learning

    seen = []
    monkeypatch.setattr(learning, "_grid", lambda spark, *tables: seen.extend(f for t in tables for f in t.inputFiles()) or spark.createDataFrame([(1.0,)], "value double"))
    assert learning.m13(spark, "/root/testdata/sf0.001").count() == 1
    # items and history come from the written sales
    assert seen and not any("lineitem" in f for f in seen)
