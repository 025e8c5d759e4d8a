"""Arithmetic with missing values.

A missing number is NULL throughout the package.  NaN is read as missing too, and
is never produced: 0/0 gives NULL.  Infinities are kept, because a plan without a
scenario value to compare with is a result users look for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str) -> Column:
    """Column by its literal name; `target_1.5c` holds a dot and needs the quotes."""
    return F.col(f"`{name}`")


def known(value: Column) -> Column:
    """The value, or NULL where it is NaN."""
    return F.when(~F.isnan(value), value)


def known_total(value: Column) -> Column:
    """Sum of the known values; zero, not NULL, when there are none."""
    return F.coalesce(F.sum(known(value)), F.lit(0.0))


def or_zero(value: Column) -> Column:
    return F.coalesce(known(value), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """IEEE division without NaN: x/0 is an infinity with the sign of x, 0/0 is NULL."""
    numerator = known(numerator)
    infinite = F.when(numerator > 0, F.lit(float("inf"))).when(
        numerator < 0, F.lit(float("-inf"))
    )
    return F.when(denominator == 0, infinite).otherwise(
        known(F.try_divide(numerator, denominator))
    )


def text_or_na(value: Column) -> Column:
    """The value as text, with the letters NA for a missing one, as in generated ids."""
    return F.coalesce(value.cast("string"), F.lit("NA"))
