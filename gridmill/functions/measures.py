"""Numeric, counting and filter expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Number of rows for which the condition is true (NULL counts as not true)."""
    return F.count_if(condition)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL when the denominator is NULL or zero."""
    return F.when(denominator != 0, numerator / denominator)


def round_half_up(value: Column, digits: int) -> Column:
    """Round the double itself, so that 1.005 (stored a little below) gives 1.0 at two digits.

    ``F.round(x, 2)`` rounds the printed decimal and would give 1.01.
    """
    scale = float(10**digits)
    return F.round(value * scale) / scale


def in_list(column: str, values: Sequence | None) -> Column:
    """Membership filter; ``None`` keeps every row and an empty list keeps none."""
    if values is None:
        return F.lit(True)
    values = list(values)
    return F.col(column).isin(values) if values else F.lit(False)
