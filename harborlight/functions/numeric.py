"""Number handling: one rounding rule, exact money sums, lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column | str, digits: int) -> Column:
    """Round half up with plain double arithmetic, the same in every engine."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    shifted = value * F.lit(scale) + F.lit(0.5)
    # from 2^53 on a double has no fraction, and floor's bigint would not hold it
    whole = F.when(F.abs(shifted) < F.lit(2.0**53), F.floor(shifted)).otherwise(shifted)
    return whole / F.lit(scale)


def money_sum(value: Column | str) -> Column:
    """Sum cents exactly, so that the result does not depend on row order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds; null counts as no."""
    return F.count(F.when(condition, F.lit(1)))


# a plain decimal number, blanks around it allowed
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(value: Column) -> Column:
    """Text to double, null for what is no number.

    The pattern is asked first: a failing cast raises and catches an exception
    per cell, which is far dearer than a match when many cells are bad.
    """
    text = value.cast("string")
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def to_double(value: Column, default: float) -> Column:
    """Lenient number: text that is no number becomes the default."""
    return F.coalesce(number(value), F.lit(default))


def to_int(value: Column, default: int = 0) -> Column:
    """Lenient whole number, cut toward zero; what an int cannot hold is the default."""
    whole = to_double(value, float(default))
    return F.coalesce(whole.try_cast("int"), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    """The value held within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
