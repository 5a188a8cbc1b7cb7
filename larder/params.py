"""Parameters that the operators, the registered queries and their SQL share."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from typing import Any


@dataclass(frozen=True)
class Params:
    window_start: date = date(1999, 1, 1)
    window_end: date = date(2000, 12, 31)
    delisting_gap_days: int = 90
    anomalies: tuple[tuple[date, date, str], ...] = ((date(1999, 4, 16), date(1999, 5, 16), "quake"), (date(1999, 5, 10), date(1999, 6, 1), "strike"))
    density_cuts: tuple[float, ...] = (0.05, 0.15, 0.5, 0.9)
    fractional_threshold: float = 0.05
    margins: tuple[tuple[str, float], ...] = (("FAMILY 0", 0.15), ("FAMILY 1", 0.25), ("FAMILY 2", 0.30))
    default_margin: float = 0.20
    price_ref: float = 10.0
    censor_window: int = 14
    censor_mean: float = 1.0
    censor_sale_days: int = 2
    quiet_days: int = 3
    min_family_items: int = 2
    family_cap: int = 3
    density_floor: float = 0.10
    promo_ceiling: float = 0.6
    naive_weeks: int = 8
    horizon: int = 5
    min_residuals: int = 3
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    as_of: date = date(2000, 7, 3)
    slice_end: date = date(2000, 6, 30)
    demand_days: int = 28
    # date, type, locale, its name, whether it was moved
    holidays: tuple[tuple[date, str, str, str, bool], ...] = (
        (date(1999, 1, 1), "Holiday", "National", "All", False), (date(2000, 1, 1), "Holiday", "National", "All", True), (date(2000, 1, 3), "Transfer", "National", "All", False),
        (date(1999, 5, 24), "Holiday", "Regional", "STATE 1", False), (date(1999, 6, 25), "Additional", "Regional", "STATE 0", False), (date(2000, 4, 21), "Event", "National", "All", False),
        (date(1999, 12, 6), "Holiday", "Local", "CITY 2", False), (date(2000, 7, 24), "Bridge", "Local", "CITY 4", False), (date(2000, 10, 9), "Work Day", "National", "All", False),
    )
    cash_shares: tuple[float, ...] = (0.3, 0.8, 1.2)
    cadence_days: int = 3
    cash_budget: float = 4000.0
    floor_share: float = 0.6
    paydays: tuple[int, ...] = (15, -1)
    order_days: tuple[int, ...] = (1, 4)
    review_days: int = 7
    lead_days: int = 3
    warm_up_days: int = 28
    season_weeks: int = 8
    level_weeks: int = 2
    retrains: tuple[date, ...] = (date(2000, 1, 3), date(2000, 7, 3))
    half_life: float = 180.0
    erp_factor: float = 0.32
    erp_least: float = 2.0
    new_history_days: int = 365
    new_sale_days: int = 20
    least_value: float = 300.0
    least_units: float = 40.0
    most_packs: int = 30
    return_days: int = 14
    margin_factors: tuple[float, ...] = (0.7, 1.0, 1.3)
    most_lost: int = 20
    variation_days: int = 28
    variation_factor: float = 2.0
    lags: tuple[int, ...] = (7, 28)
    feature_windows: tuple[int, ...] = (14, 28)
    active_features: tuple[str, ...] = (
        "lag_units_7", "lag_units_28", "rolling_mean_units_14d", "rolling_mean_units_28d", "rolling_sum_units_28d", "share_days_with_sale_28d", "promo_share_28d", "promo_known_share_28d",
        "days_since_last_sale", "days_since_last_promo", "category", "item_class", "is_perishable", "iso_weekday", "days_to_payday",
    )
    # the model also sees longer windows
    learned_windows: tuple[int, ...] = (14, 28, 56, 112)
    learned_features: tuple[str, ...] = ("rolling_mean_units_56d", "rolling_mean_units_112d", "share_days_with_sale_112d")
    feature_dates: tuple[date, ...] = (date(1999, 1, 1), date(1999, 7, 5), date(2000, 7, 3))
    origin_days: int = 7
    least_origins: int = 8
    boost_rounds: int = 8
    boost_depth: int = 2
    boost_rate: float = 0.3
    boost_bins: int = 32
    boost_least_rows: int = 500
    evaluation_days: int = 28
    evaluation_end: date = date(2000, 12, 1)
    ask_alpha: float = 0.9
    known_orders: int = 15000
    # category, units of a pack, least order value, days of shelf life
    category_terms: tuple[tuple[str, float, float, float], ...] = (
        ("FAMILY 0", 6.0, 200.0, 3.0), ("FAMILY 1", 4.0, 0.0, 14.0), ("FAMILY 2", 1.0, 500.0, 30.0), ("FAMILY 3", 12.0, 50.0, 7.0), ("FAMILY 4", 2.0, 5000.0, 30.0), ("FAMILY 5", 3.0, 100.0, 4.0),
    )
    # suppliers that take orders on other days than order_days
    supplier_days: tuple[tuple[str, tuple[int, ...]], ...] = (("SUP-FAMILY_5", (2, 5)),)
    weekly_budget: float = 420.0
    critical_share: float = 0.02
    least_complete: float = 0.90
    regular_days: int = 28
    regular_share: float = 0.80
    test_days: int = 84
    # the mean days between sales and the squared variation of their units from which demand is intermittent or erratic
    class_interval: float = 1.32
    class_variation: float = 0.49
    held_days: int = 6
    capital_cost: float = 0.24
    # what a scenario is called until its day; the last one has no end
    scenarios: tuple[tuple[str, date], ...] = (("stale", date(1999, 9, 1)), ("recalibrated", date(2000, 5, 1)), ("model", date(2001, 1, 1)))
    coverage: tuple[tuple[str, float], ...] = (("stale", 8.96), ("recalibrated", 20.0))
    service_target: float = 0.7


def validated(params: Params) -> Params:
    """params, or one error with everything that is wrong with them."""
    p, said = params, []
    quantiles = (*p.quantiles,)
    for what, wrong in (
        ("window_start is after window_end", p.window_start > p.window_end), ("slice_end is not before as_of", p.slice_end >= p.as_of), ("as_of is not in the window", not p.window_start < p.as_of <= p.window_end),
        ("quantiles do not rise between 0 and 1", not quantiles or any(not 0 < q < 1 for q in quantiles) or list(quantiles) != sorted(set(quantiles))), ("order_days are not ISO weekdays", not p.order_days or any(not 1 <= d <= 7 for d in p.order_days)),
        ("horizon is not positive", p.horizon <= 0), ("lead_days or review_days is not positive", p.lead_days <= 0 or p.review_days <= 0), ("floor_share is not a share", not 0 <= p.floor_share <= 1), ("a margin is not a share", any(not 0 <= m < 1 for _, m in p.margins) or not 0 <= p.default_margin < 1),
        ("retrains do not rise", list(p.retrains) != sorted(set(p.retrains))), ("an anomaly ends before it starts", any(a > b for a, b, _ in p.anomalies)), ("half_life is not positive", p.half_life <= 0),
    ):
        if wrong:
            said.append(what)
    if said:
        raise ValueError("; ".join(said))
    return params


def from_values(values: dict[str, Any]) -> Params:
    """Parameters from plain values, as of a JSON or YAML file: unknown names and values of another kind are one error; dates are texts in ISO form, lists become tuples."""
    kinds, said, out = {f.name: f.default for f in fields(Params)}, [], {}

    def like(value: Any, sample: Any) -> Any:
        if isinstance(sample, date):
            return value if isinstance(value, date) else date.fromisoformat(value)
        if isinstance(sample, tuple):
            return tuple(like(v, sample[min(i, len(sample) - 1)]) for i, v in enumerate(value))
        if isinstance(sample, float) and type(value) is int:
            return float(value)
        if type(value) is not type(sample):
            raise TypeError(value)
        return value

    for name, value in values.items():
        if name not in kinds:
            said.append(f"{name} is no parameter")
            continue
        try:
            out[name] = like(value, kinds[name])
        except (TypeError, ValueError):
            said.append(f"{name} cannot be {value!r}")
    if said:
        raise ValueError("; ".join(said))
    return validated(Params(**out))


PARAMS = validated(Params())
