"""Ratios and percentages with explicit rules for rounding and for division by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rate_or_zero(part: Column, whole: Column) -> Column:
    """An unrounded rate; 0 when there is nothing to count."""
    return F.coalesce(quotient(part, whole), F.lit(0.0))


def percent_rounded(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, rounded half up; 0.00 for an empty whole."""
    return F.round(F.coalesce(quotient(part, whole) * 100, F.lit(0.0)), 2)


def percent_truncated(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, cut off; 100 for an empty whole."""
    return F.when(whole == 0, 100.0).otherwise(F.floor(F.try_divide(part * 10000, whole)) / 100)


def percent_text(part: Column, whole: Column) -> Column:
    """The overall figure as text: ``Unknown%`` for an empty whole."""
    return F.when(whole == 0, "Unknown%").otherwise(F.concat(percent_truncated(part, whole).cast("string"), F.lit("%")))


def percent_exact(part: Column, whole: Column) -> Column:
    """Unrounded percentage, as in total rows."""
    return F.coalesce(quotient(part, whole) * 100, F.lit(0.0))


def coverage_class(percent: Column, medium: float = 50.0, high: float = 80.0) -> Column:
    """low, medium or high; no data is medium. The cut-offs are parameters."""
    return F.when(percent.isNull(), "medium").when(percent >= high, "high").when(percent >= medium, "medium").otherwise("low")


def is_hit(count: Column) -> Column:
    return count > 0


def split_consistent(missed: Column, covered: Column, total: Column) -> Column:
    return missed + covered == total
