import datetime as dt
from itertools import product

import numpy as np
import pytest
from larder.operators import forecast, guards, ledger, ordering, purchasing, quality, scenarios
from larder.params import Params
from pyspark.sql import functions as F

MONDAY = dt.date(2020, 3, 2)
PAIR = "store_id string, item_id string"


def test_misaligned_inputs_are_named(spark):
    make = lambda *items: spark.createDataFrame([("s", i) for i in items], PAIR)
    sides = {"wanted": make("a", "b"), "position": make("a", "a", "c"), "demand": make("a", "b", "c")}
    assert {(r.item_id, r.missing_from) for r in purchasing.alignment_findings(sides, ["store_id", "item_id"]).collect()} == {("b", "position"), ("c", "wanted")}
    with pytest.raises(ValueError, match="s, b is not in position; s, c is not in wanted"):
        purchasing.aligned(sides, ["store_id", "item_id"])
    purchasing.aligned({"x": make("a"), "y": make("a")}, ["store_id", "item_id"])


def test_order_gate(spark):
    rows = spark.createDataFrame([("a", [1, 4]), ("b", [2]), ("c", [1]), ("d", [7, 6])], "item_id string, order_days array<long>")
    got = {r.item_id: (r.is_open, (r.next_order_day - MONDAY).days) for r in purchasing.gated(rows, MONDAY).collect()}
    assert got == {"a": (True, 3), "b": (False, 1), "c": (True, 7), "d": (False, 5)}


ORDER = "store_id string, supplier_id string, item_id string, quantity double, pack double, unit_cost double, daily double, position double, least_value double, least_units double, order_days array<long>"


def plain_fill(items, least_value, least_units, most):
    """The same, one pack at a time."""
    now, added = {i["id"]: i["q"] for i in items}, []
    by = {i["id"]: i for i in items}
    met = lambda: (least_value <= 0 or sum(now[k] * by[k]["cost"] for k in now) >= least_value) and (least_units <= 0 or sum(now.values()) >= least_units)
    while not met():
        open_ = [k for k in now if by[k]["daily"] > 0]
        if not open_ or len(added) >= most:
            return now, added, False
        k = min(open_, key=lambda k: ((by[k]["pos"] + now[k]) / by[k]["daily"], k))
        now[k] += by[k]["pack"]
        added.append(k)
    return now, added, True


def test_filling_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for s in range(40):
        items = [{"id": f"i{k}", "q": float(rng.integers(0, 6)), "pack": float(rng.integers(1, 4)), "cost": float(rng.integers(1, 9)), "daily": float(rng.integers(0, 4)), "pos": float(rng.integers(0, 20))} for k in range(rng.integers(1, 6))]
        value, units = float(rng.integers(0, 120)), float(rng.integers(0, 30))
        now, added, met = plain_fill(items, value, units, 8)
        for i in items:
            rows.append(("s", f"p{s}", i["id"], i["q"], i["pack"], i["cost"], i["daily"], i["pos"], value, units, [1]))
            want[f"p{s}", i["id"]] = (added.count(i["id"]), "deferred" if not met else "filled" if added else "placed", now[i["id"]] if met else 0.0)
    got = {(r.supplier_id, r.item_id): (r.added_packs, r.outcome, r.order) for r in ordering.filled(spark.createDataFrame(rows, ORDER), 8).collect()}
    assert got == want and {o for _, o, _ in want.values()} == {"deferred", "filled", "placed"}


def test_adjustments(spark):
    rows = [("s", "p", "a", 3.5, 3.0, 1.0, 1.0, 0.0, 0.0, 0.0, [1]), ("s", "q", "b", 2.0, 2.0, 1.0, 1.0, 0.0, 9.0, 0.0, [1]), ("s", "r", "c", 2.0, 2.0, 1.0, 1.0, 0.0, 900.0, 0.0, [1]), ("s", "t", "d", 2.5, 2.0, 1.0, 1.0, 0.0, 0.0, 0.0, [2])]
    orders, said = purchasing.supplier_orders(spark.createDataFrame(rows, ORDER), MONDAY, 5)
    assert {(r.item_id, r.reason, r.delta_units) for r in said.collect()} == {("a", "pack rounding", 2.5), ("b", "filled to minimum", 8.0), ("c", "filled to minimum", 10.0), ("c", "deferred", -12.0)}
    assert {r.item_id: (r.outcome, r.order) for r in orders.collect()} == {"a": ("placed", 6.0), "b": ("filled", 10.0), "c": ("deferred", 0.0), "d": ("closed", 0.0)}


DECISION = "store_id string, supplier_id string, item_id string, category string, desired double, position double, daily double, shelf_life double, risk_window int, recent_purchase double, is_new boolean, pack double, unit_cost double, margin double, least_value double, least_units double, order_days array<long>"


def _decision(item, desired, category="A", position=0.0, daily=1.0, shelf=100.0, recent=0.0, new=False, pack=1.0, margin=0.2, supplier=None, days=(1,), least=0.0):
    return ("s", supplier or f"sup {category}", item, category, desired, position, daily, shelf, 10, recent, new, pack, 1.0, margin, least, 0.0, list(days))


def test_item_guards(spark):
    rows = [_decision("cut", 300.0), _decision("short", 9.0, shelf=5.0), _decision("jump", 30.0, recent=10.0), _decision("calm", 20.0, recent=10.0), _decision("new", 999.0, new=True, recent=1.0), _decision("lone", 50.0, "B", new=True), _decision("idle", 500.0, daily=0.0)]
    got = {r.item_id: (r.quantity, r.guard_flags) for r in purchasing.guarded(spark.createDataFrame(rows, DECISION), 2.0).collect()}
    assert got == {
        "cut": (100.0, ["coverage cap"]), "short": (9.0, ["coverage cap"]), "jump": (30.0, ["order variation"]), "calm": (20.0, []), "new": (30.0, ["new item"]), "lone": (30.0, ["new item"]), "idle": (500.0, []),
    }
    alone = purchasing.guarded(spark.createDataFrame([_decision("n", 9.0, new=True)], DECISION), 2.0).first()
    assert alone.quantity == 0.0


def test_purchase_list(spark):
    rows = [
        _decision("a", 10.0, margin=0.9, pack=4.0), _decision("b", 30.0, margin=0.1), _decision("c", 20.0, margin=0.5, recent=1.0), _decision("d", 5.0, "B", least=900.0), _decision("e", 0.0, "B", least=900.0, daily=0.0),
        _decision("f", 3.0, "C", days=(2,)), _decision("g", 1.0, "D", least=3.0, margin=0.4),
    ]
    decisions = spark.createDataFrame(rows, DECISION)
    budget = spark.createDataFrame([("s", 40.0)], "store_id string, budget double")
    listed = purchasing.purchase_list(decisions, MONDAY, 2.0, 5, budget, 0.5)
    got = {r.item_id: (r.section, r.final_order, r.packs, r.flags, r.outcome) for r in listed.collect()}
    assert got == {
        "a": ("main", 12.0, 3.0, [], "placed"), "b": ("exceptions", 0.0, 0.0, ["cash: reduced"], "placed"), "c": ("exceptions", 20.0, 20.0, ["order variation"], "placed"),
        "d": ("exceptions", 0.0, 0.0, ["filled to minimum", "deferred"], "deferred"), "e": ("main", 0.0, 0.0, [], "deferred"), "g": ("exceptions", 3.0, 3.0, ["filled to minimum"], "filled"),
    }
    assert {r.rule: r.n for r in purchasing.firing_counts(listed).collect()} == {"coverage cap": 0, "order variation": 1, "new item": 0, "cash": 1, "planned promotion": None, "anchor item": None}
    assert {r.coverage_days for r in listed.filter("item_id = 'e'").collect()} == {None}
    mixed = spark.createDataFrame([_decision("a", 1.0, supplier="x"), _decision("b", 1.0, "B", supplier="x")], DECISION)
    with pytest.raises(ValueError, match="supplier x has items of 2 categories"):
        purchasing.purchase_list(mixed, MONDAY, 2.0, 5, budget, 0.5)


def test_the_cash_rule_can_undo_a_minimum(spark):
    rows = [_decision("a", 30.0, least=30.0, margin=0.1), _decision("b", 30.0, "B", margin=0.9)]
    listed = purchasing.purchase_list(spark.createDataFrame(rows, DECISION), MONDAY, 2.0, 5, spark.createDataFrame([("s", 40.0)], "store_id string, budget double"), 0.0)
    assert {r.item_id: (r.final_order, r.below_minimum) for r in listed.collect()} == {"a": (0.0, True), "b": (30.0, False)}


def plain_cash(items, budget, floor):
    """The cash rule in loops: item -> (kept, flag)."""
    cut_at, run, base = False, 0.0, {}
    for k in sorted(items, key=lambda k: (-items[k][2], k)):
        cut_at = cut_at or run + items[k][1] > budget
        base[k] = not cut_at
        run += 0 if cut_at else items[k][1]
    protected, headroom = {}, {}
    for c in {v[0] for v in items.values()}:
        own, acc, n = sorted((k for k in items if items[k][0] == c), key=lambda k: (items[k][2], k)), 0.0, 0
        room = (1 - floor) * sum(items[k][1] for k in own)
        for k in own:
            if acc + items[k][1] > room:
                break
            acc, n = acc + items[k][1], n + 1
        headroom[c], protected[c] = own[:n], own[n:]
    need = sum(items[k][1] for ks in protected.values() for k in ks)
    out = {}
    if need > budget:
        left = budget
        mean = lambda c: sum(items[k][1] * items[k][2] for k in protected[c] + headroom[c]) / sum(items[k][1] for k in protected[c] + headroom[c])
        for c in sorted(protected, key=lambda c: (-mean(c), c)):
            cost = sum(items[k][1] for k in protected[c])
            granted = cost <= left
            left -= cost if granted else 0
            out |= {k: (granted, None if granted and base[k] else "protected by the floor" if granted else "reduced") for k in protected[c]} | {k: (False, "reduced") for k in headroom[c]}
        return out
    left, stop = budget - need, False
    for k in sorted((k for ks in headroom.values() for k in ks), key=lambda k: (-items[k][2], k)):
        stop = stop or items[k][1] > left
        left -= 0 if stop else items[k][1]
        out[k] = (not stop, "reduced" if stop else None)
    return out | {k: (True, None if base[k] else "protected by the floor") for ks in protected.values() for k in ks}


def test_cash_rule_equals_the_loops(spark):
    rng = np.random.default_rng(14)
    rows, want = [], {}
    for case in range(60):
        items = {f"i{k:02}": (f"c{rng.integers(0, 4)}", float(rng.integers(1, 40)), float(rng.integers(0, 9)) / 10) for k in range(rng.integers(1, 14))}
        budget = float(round(sum(v[1] for v in items.values()) * rng.choice([0.2, 0.5, 0.8, 1.0])))
        want |= {(case, k): v for k, v in plain_cash(items, budget, 0.5).items()}
        rows += [(case, "s", k, c, v, m, budget) for k, (c, v, m) in items.items()]
    df = spark.createDataFrame(rows, "scenario int, store_id string, item_id string, category string, value double, margin double, budget double")
    assert {(r.scenario, r.item_id): (r.kept, r.cash_flag) for r in guards.cash_rule(df, 0.5).collect()} == want


def test_terms_budget_and_recent_purchases(spark):
    terms = spark.createDataFrame([("A", 6.0)], "category string, pack double")
    decisions = spark.createDataFrame([("A",), ("B",), ("A",)], "category string")
    assert purchasing.with_category_terms(decisions.filter("category = 'A'"), terms).count() == 2
    with pytest.raises(ValueError, match="no terms for B"):
        purchasing.with_category_terms(decisions, terms)
    assert spark.range(1).select(purchasing.cycle_budget(200.0, 14).alias("b")).first().b == 400.0
    events = spark.createDataFrame([("s", "a", MONDAY - dt.timedelta(k), o) for k, o in ((0, 99.0), (1, 4.0), (2, None), (3, 0.0), (7, 8.0), (8, 50.0))] + [("s", "b", MONDAY - dt.timedelta(1), None)], f"{PAIR}, date date, order double")
    assert {r.item_id: r.recent_purchase for r in purchasing.recent_purchases(events, MONDAY, 7).collect()} == {"a": 6.0, "b": 0.0}


EVENTS = f"{PAIR}, date date, demand double, sold double, unmet double, expired double, on_hand double"


def _events(spark):
    rows = [("s", "a", k, 10.0, 8.0, 2.0, 1.0, 20.0) for k in range(10)] + [("s", "b", k, 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(10)] + [("s", "a", -1, 99.0, 99.0, 0.0, 99.0, 99.0)]
    return spark.createDataFrame([(s, i, MONDAY + dt.timedelta(k), *v) for s, i, k, *v in rows], EVENTS)


def test_money_after_the_warm_up(spark):
    economics = ledger.item_economics(spark.createDataFrame([("a", "food"), ("b", "drink")], "item_id string, category string"), (("food", 0.4),), 0.2, 10.0)
    assert {r.item_id: (r.price, round(r.cost, 9), r.margin) for r in economics.collect()} == {"a": (10.0, 6.0, 0.4), "b": (10.0, 8.0, 0.2)}
    rows = ledger.priced(_events(spark), economics, MONDAY)
    got = {r.item_id: r for r in ledger.item_money(rows, 0.24).collect()}
    a = got["a"]
    assert (a.margin, a.stockout_cost, a.loss, a.mean_capital, a.n_days) == pytest.approx((320.0, 80.0, 60.0, 120.0, 10))
    assert (a.service_level, a.turn, a.carrying_cost, a.decision_metric) == pytest.approx((0.8, 480 / 120 * 36.5, 120 * 10 * 0.24 / 365, 260 / 120))
    assert (got["b"].service_level, got["b"].turn, got["b"].decision_metric) == (None, None, None)
    whole = ledger.portfolio_money(rows, 0.24).first()
    assert (whole.margin, whole.mean_capital, whole.service_level, whole.decision_metric) == pytest.approx((320.0, 120.0, 0.8, 260 / 120))
    days = ledger.daily_margin(rows).orderBy("date").collect()
    assert [(r.net_margin, r.running) for r in days[:2]] == [(26.0, 26.0), (26.0, 52.0)]
    with pytest.raises(ValueError, match="no price or cost of items b"):
        ledger.priced(_events(spark), economics.filter("item_id = 'a'"), MONDAY)


def test_price_scale_cancels(spark):
    items = spark.createDataFrame([("a", "food"), ("b", "drink")], "item_id string, category string")
    one, two = (ledger.item_money(ledger.priced(_events(spark), ledger.item_economics(items, (), 0.3, p), MONDAY), 0.2).filter("item_id = 'a'").first() for p in (10.0, 20.0))
    assert (one.service_level, one.turn, one.decision_metric) == pytest.approx((two.service_level, two.turn, two.decision_metric)) and two.margin == pytest.approx(2 * one.margin)


def test_observed_ledger(spark):
    day = lambda k: MONDAY + dt.timedelta(k)
    days = spark.createDataFrame([("s", "a", day(k)) for k in range(4)], f"{PAIR}, date date")
    moves = spark.createDataFrame([("s", "a", day(1), 5.0, 2.0, 1.0), ("s", "a", day(3), 7.0, 0.0, 0.0), ("s", "z", day(1), 1.0, 0.0, 0.0)], f"{PAIR}, date date, demand double, unmet double, expired double")
    orders = spark.createDataFrame([("s", "a", day(0), 9.0)], f"{PAIR}, date date, order double")
    got = [tuple(r)[4:] for r in ledger.observed(days, moves, orders, 2, 1).orderBy("date").collect()]
    assert got == [(0.0, 0.0, 0.0, 9.0, 5.0, 0.0), (3.0, 2.0, 1.0, None, 12.0, 9.0), (0.0, 0.0, 0.0, None, 7.0, 0.0), (7.0, 0.0, 0.0, None, 7.0, 0.0)]


def test_all_doubles_are_rounded(spark):
    assert tuple(ledger.rounded(spark.createDataFrame([(1 / 3, "x", 2)], "a double, b string, c int"), 4).first()) == (0.3333, "x", 2)


def test_grid_choice(spark):
    rows = [("x", 0, 0.9, 50.0), ("x", 1, 0.95, 40.0), ("x", 2, 0.97, 40.0), ("x", 3, 0.5, 1.0), ("y", 0, 0.5, 9.0), ("y", 1, 0.6, 99.0), ("y", 2, 0.6, 1.0), ("y", 3, None, 0.0)]
    got = {r.g: (r.place, r.meets) for r in scenarios.choose(spark.createDataFrame(rows, "g string, place int, fill_rate double, mean_on_hand double"), ["g"], 0.9).collect()}
    assert got == {"x": (1, True), "y": (1, False)}


SCENARIO = "g string, scenario string, service_level double, decision_metric double, mean_capital double, stockout_cost double, loss double, margin double, n_days long, coverage_days double"


def _scenarios(spark):
    return spark.createDataFrame([("x", "stale", 0.60, 3.0, 50.0, 90.0, 9.0, 10.0, 60, 7.0), ("x", "fresh", 0.95, 2.0, 100.0, 20.0, 4.0, 40.0, 60, 21.0), ("x", "model", 0.94, 2.5, 80.0, 30.0, 1.0, 44.0, 60, None), ("y", "model", 0.5, 1.0, 1.0, 1.0, 1.0, 1.0, 30, None)], SCENARIO)


def test_scenario_comparison(spark):
    got = {(r.g, r.scenario): r for r in scenarios.compared(_scenarios(spark), ["g"], "fresh", 0.97, 21).collect()}
    r = got["x", "stale"]
    assert (r.gap_to_target_pp, r.gap_to_baseline_pp, r.capital_vs_baseline_pct, r.decision_vs_baseline_pct, r.coverage_by_window) == pytest.approx((37.0, 35.0, -50.0, 50.0, 1 / 3))
    assert got["x", "model"].coverage_by_window is None and got["y", "model"].gap_to_baseline_pp is None
    split = {r.g: r for r in scenarios.gain_split(_scenarios(spark), ["g"], "stale", "fresh", "model").collect()}
    assert (split["x"].gain, split["x"].gain_by_recalibration, split["x"].gain_by_model, split["x"].gap_pp, split["x"].closed_by_model_pp) == pytest.approx((-0.5, -1.0, 0.5, 35.0, -1.0))
    assert split["y"].gain is None
    gain = {r.g: tuple(r)[1:] for r in scenarios.gains(_scenarios(spark), ["g"], "fresh", "model").collect()}
    assert gain["x"] == (-10.0, 20.0, 3.0)


def test_monthly_report(spark):
    got = {(r.section, r.indicator, r.scenario): r.value for r in scenarios.monthly_report(_scenarios(spark).filter("g = 'x'"), ["g"], "stale", "fresh", "model").collect()}
    assert got["scenarios", "margin", "fresh"] == 20.0 and got["recalibration", "stockout_avoided", "stale to fresh"] == 35.0 and got["recalibration", "capital_added", "stale to fresh"] == 50.0
    assert got["model", "capital_freed", "fresh to model"] == 20.0 and len(got) == 6 * 3 + 3 + 3


def test_equal_service_point(spark):
    points = spark.createDataFrame([("x", a, s) for a, s in ((0.5, 0.90), (0.6, 0.93), (0.7, 0.97), (0.8, None))] + [("z", 0.5, 0.5)], "g string, alpha double, service_level double")
    got = scenarios.closest(points, _scenarios(spark).filter("scenario = 'fresh'"), ["g"]).collect()
    assert [(r.g, r.alpha) for r in got] == [("x", 0.6)] and got[0].distance_pp == pytest.approx(-2.0)


def test_spread_cells_and_assumptions(spark):
    rows = spark.createDataFrame([("x", float(k)) for k in range(11)] + [("x", None)], "g string, v double")
    assert tuple(scenarios.spread(rows, ["g"], "v").first()) == ("x", 11, 0.0, 10.0, 5.0, 1.0, 9.0)
    grid = spark.createDataFrame([(7, 14), (3, 7)], "lead int, review int")
    assert {tuple(r) for r in scenarios.cells(spark.createDataFrame([("p", 1), ("q", 1)], "s string, lead int"), grid).collect()} == {(s, a, b) for s, (a, b) in product("pq", ((7, 14), (3, 7)))}
    with pytest.raises(ValueError, match="no forecasts for alpha 0.66"):
        scenarios.check_alphas((0.5, 0.66), (0.5, 0.9))
    got = {r.name: (r.value, r.origin) for r in scenarios.assumptions(spark, Params(), {"horizon": "measured"}, "run").collect()}
    assert got["horizon"] == ("5", "measured") and got["paydays"] == ("[15, -1]", "assumed")
    with pytest.raises(ValueError, match="no such parameters: nothing"):
        scenarios.assumptions(spark, Params(), {"nothing": "measured"}, "run")


def test_report_with_examples(spark):
    sales = spark.createDataFrame([("s", f"i{k}", MONDAY, 1.0) for k in range(8)] + [("s", "old", MONDAY - dt.timedelta(40), 1.0), ("s", "idle", MONDAY, 0.0)], f"{PAIR}, date date, units_sold double")
    items = spark.createDataFrame([(f"i{k}", None if k < 6 else 2.0) for k in range(8)] + [("i0", 3.0), ("old", None), ("idle", None)], "item_id string, pack_multiple double")
    known, gaps = quality.registry_gaps(items, quality.active_items(sales, 28))
    entries = spark.createDataFrame([("i1", MONDAY, MONDAY + dt.timedelta(2)), ("i2", MONDAY, None), ("i3", MONDAY, MONDAY)], "item_id string, received_date date, order_date date")
    units = spark.createDataFrame([("i1", "kg"), ("i1", "unidade"), ("i2", "kg"), ("i2", "kg")], "item_id string, u string")
    checks = [
        quality.Check("no pack", gaps, known, least_sound=0.9), quality.Check("early", quality.receipts_before_orders(entries), entries), quality.Check("units", quality.divergent_units(units, "item_id", "u"), units),
        quality.Check("returns", reason="no returns are told"), quality.Check("nothing", gaps.limit(0), known.limit(0)),
    ]
    got = {r.check: r for r in quality.report(spark, checks, 0.3).collect()}
    r = got["no pack"]
    assert (r.base_rows, r.n, r.share, r.critical, [e.item_id for e in r.examples]) == (8, 5, 0.625, True, ["i1", "i2", "i3", "i4", "i5"])
    assert tuple(got["early"].examples[0]) == ("i1", MONDAY, "2020-03-02 < 2020-03-04") and got["units"].examples[0].value == "kg | unidade"
    assert (got["returns"].status, got["returns"].n, got["returns"].examples, got["returns"].critical) == ("not evaluated", None, None, False)
    assert (got["nothing"].n, got["nothing"].share, got["nothing"].examples) == (0, 0.0, [])


def test_diff_samples(spark):
    kind = "k int, v double, w string"
    x = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (None, 3.0, "c")] + [(k, 1.0, "z") for k in range(10, 30)], kind)
    y = spark.createDataFrame([(1, 1.0, None), (2, None, "b"), (None, 3.5, "c")] + [(k, 2.0, "z") for k in range(10, 29)], kind).withColumn("own", F.lit(1))
    got = {r.what: (r.n, r.samples) for r in quality.diff_samples(x, y, ["k"]).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"column only in actual: own": None, "row only in expected": 1, "v": 20, "w": 1}
    assert len(got["v"][1]) == 5 and got["w"][1] == ['{"key":{"k":1},"x":"a","y":null}'] and got["row only in expected"][1] == ['{"key":{"k":29},"x":null,"y":null}']
    assert quality.diff_samples(x, x, ["k"]).count() == 0


STORE = f"{PAIR}, as_of date, horizon int, quantile double, value double"


def test_forecasts_are_looked_up_exactly(spark):
    store = spark.createDataFrame([("s", "a", MONDAY, 5, q, v) for q, v in ((0.5, 3.0), (0.9, 7.0))], STORE)
    asked = [("s", "a", MONDAY, 5, 0.9), ("s", "a", MONDAY, 5, 0.8), ("s", "a", MONDAY, 6, 0.9), ("s", "a", MONDAY + dt.timedelta(1), 5, 0.9), ("s", "b", MONDAY, 5, 0.9)]
    got = [(r.value, r.finding) for r in forecast.look_up(spark.createDataFrame(asked, f"{PAIR}, as_of date, horizon int, quantile double"), store).orderBy("item_id", "as_of", "horizon", F.desc("quantile")).collect()]
    assert got == [(7.0, None), (None, "quantile"), (None, "horizon"), (None, "as_of"), (None, "pair")]
    days = spark.createDataFrame([("s", "a", MONDAY + dt.timedelta(k)) for k in (-1, 0, 9)] + [("s", "b", MONDAY)], f"{PAIR}, date date")
    later = forecast.latest_before(days, store.unionByName(store.withColumns({"as_of": F.date_add("as_of", 7), "value": F.col("value") + 1})))
    assert [(r.item_id, r.as_of, r.forecast and [tuple(x) for x in r.forecast]) for r in later.orderBy("item_id", "date").collect()] == [
        ("a", None, None), ("a", MONDAY, [(0.5, 3.0), (0.9, 7.0)]), ("a", MONDAY + dt.timedelta(7), [(0.5, 4.0), (0.9, 8.0)]), ("b", None, None)
    ]


def test_forecast_findings(spark):
    rows = [("s", "a", MONDAY, 5, 0.5, 3.0), ("s", "a", MONDAY, 5, 0.9, 2.0), ("s", "b", MONDAY, 0, 0.9, 2.0), ("s", "c", MONDAY, 5, 1.0, 2.0), ("s", "d", MONDAY, 5, 0.5, 2.0), ("s", "d", MONDAY, 5, 0.9, 2.0)]
    got = {(r.item_id, r.finding) for r in forecast.forecast_findings(spark.createDataFrame(rows, STORE), 0.9).collect()}
    assert got == {("a", "falling"), ("b", "window"), ("c", "quantile"), ("c", "alpha")}
    for alpha in (1.0, 0.0):
        with pytest.raises(ValueError):
            forecast.forecast_findings(spark.createDataFrame(rows, STORE), alpha)


def test_demand_classes_and_methods(spark):
    day = lambda k: MONDAY + dt.timedelta(k)
    sold = {"steady": [5.0] * 8, "rare": [0, 0, 4.0, 0, 0, 0, 4.0, 0], "wild": [1.0, 40.0, 1.0, 1.0, 50.0, 1.0, 2.0, 1.0], "dead": [0.0] * 8}
    history = spark.createDataFrame([("s", i, day(k), float(u)) for i, us in sold.items() for k, u in enumerate(us)] + [("s", "steady", day(9), 999.0)], f"{PAIR}, date date, units_sold double")
    assert {r.item_id: r.demand_class for r in forecast.demand_classes(history, day(8), 1.32, 0.49).collect()} == {"steady": "regular", "rare": "intermittent", "wild": "erratic", "dead": "none"}
    kind = f"{PAIR}, as_of date, demand_class string, method string, point double, actual double, unit_value double, masked boolean"
    rows = [("s", "a", day(k), "regular", m, p, a, 1.0, masked) for k, a, points, masked in ((0, 10.0, (12.0, 14.0), False), (1, 10.0, (9.0, 8.0), None), (2, 10.0, (99.0, 9.0), True), (3, 10.0, (99.0, None), False)) for m, p in zip(("erp", "seasonal"), points, strict=True)]
    got = {r.method: (r.n, r.relative_mae, r.wape, r.bias) for r in forecast.methods_compared(spark.createDataFrame(rows, kind), "seasonal").collect()}
    assert got["erp"] == pytest.approx((2, 0.5, 3 / 20, 1 / 20)) and got["seasonal"] == pytest.approx((2, 1.0, 6 / 20, 2 / 20))
