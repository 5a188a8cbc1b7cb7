"""Day features and review calendars as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def days_to_payday(day: Column, paydays: tuple[int, ...]) -> Column:
    """Days until the next payday, 0 on one; -1 is the last day of a month, and a day that a month lacks is its last."""
    found = []
    for month in (0, 1):
        first = F.add_months(F.trunc(day, "MM"), month)
        for spec in paydays:
            at = F.last_day(first) if spec == -1 else F.least(F.date_add(first, spec - 1), F.last_day(first))
            found.append(F.when(at >= day, F.datediff(at, day)))
    return F.array_min(F.array(*found))


def every_n_days(day: Column, start: date, n: int) -> Column:
    """Whether a day is in the grid of every n days through start."""
    return F.pmod(F.datediff(day, F.lit(start)), F.lit(n)) == 0


def next_order_day(day: Column, weekdays: tuple[int, ...]) -> Column:
    """The first day strictly after `day` that falls on one of the ISO weekdays."""
    ahead = F.array(*(F.pmod(F.lit(w - 1) - iso_weekday(day), F.lit(7)) + 1 for w in weekdays))
    return F.date_add(day, F.array_min(ahead))


#: Types of holidays that close or change a day, a fixed list.
EFFECTIVE = ("Holiday", "Additional", "Transfer", "Bridge")


def effective_holidays(holidays: DataFrame) -> DataFrame:
    """Holidays that take place: of the effective types, and not a holiday that was moved elsewhere."""
    return holidays.filter(F.col("type").isin(*EFFECTIVE) & ~((F.col("type") == "Holiday") & F.col("transferred")))


def holiday_flags(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """days (store_nbr, date, state, city) with flags of national, regional and local holidays. Holidays are joined by day, once."""
    kinds = effective_holidays(holidays)
    place = lambda locale: F.collect_set(F.when(F.col("locale") == locale, F.col("locale_name"))).alias(locale)
    by_day = kinds.groupBy("date").agg(F.bool_or(F.col("locale") == "National").alias("national"), place("Regional"), place("Local"))
    joined = days.join(by_day, "date", "left")
    false = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        *days.columns, false(F.col("national")).alias("is_holiday_national"), false(F.array_contains("Regional", F.col("state"))).alias("is_holiday_regional"), false(F.array_contains("Local", F.col("city"))).alias("is_holiday_local")
    )


def store_locale(stores: DataFrame, store_nbr: int) -> tuple[str, str]:
    """(state, city) of a store; none or several rows of it are an error."""
    found = stores.filter(F.col("store_nbr") == store_nbr).select("state", "city").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"store {store_nbr}: {'no row' if not found else 'several rows'} in stores, one is expected")
    return found[0].state, found[0].city


def located(days: DataFrame, stores: DataFrame) -> DataFrame:
    """days (store_nbr, date) with each store's state and city; a store with none or several rows is an error, which tells some."""
    held = stores.groupBy("store_nbr").agg(F.count("*").alias("n"), F.first("state").alias("state"), F.first("city").alias("city"))
    bad = days.select("store_nbr").distinct().join(held, "store_nbr", "left").filter("n is null or n > 1").orderBy("store_nbr").limit(5).collect()
    if bad:
        raise ValueError("rows in stores, where one is expected: " + ", ".join(f"{r.n or 0} of store {r.store_nbr}" for r in bad))
    return days.join(held.drop("n"), "store_nbr")
