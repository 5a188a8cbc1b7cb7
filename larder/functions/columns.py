"""Column functions with the exact rounding and tie rules that the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two packs differ when they are further apart than this share of them.
PACK_TOLERANCE = 1e-9


def positive_part(x: Column) -> Column:
    """x or 0; never minus zero."""
    return F.greatest(x, F.lit(0.0)) + F.lit(0.0)


def is_fractional(x: Column) -> Column:
    return x != F.round(x)


def round_up_to_pack(quantity: Column, pack: Column) -> Column:
    """The least whole number of packs that covers quantity; a ratio within the tolerance of a whole number is that number."""
    ratio = quantity / pack
    near = F.rint(ratio)
    packs = F.when(F.abs(ratio - near) <= PACK_TOLERANCE * F.greatest(F.abs(ratio), F.abs(near)), near).otherwise(F.ceil(ratio).cast("double"))
    return F.when(quantity <= 0, 0.0).otherwise(packs * pack)


def day_number(d: Column) -> Column:
    return F.unix_date(d).cast("long")
