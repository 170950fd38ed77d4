"""Means, rounding and numeric coercion (PRJ4, PRJ8, PRJ9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """Spark's ``round`` (HALF_UP on the decimal form of the value)."""
    return F.round(c, digits)


def rounded_mean(c: str | Column, digits: int) -> Column:
    """``round(avg(c), digits)``: nulls are skipped by the mean (PRJ4)."""
    return F.round(F.avg(c), digits)


def mean_from_parts(total: Column, count: Column, digits: int) -> Column:
    """Mean rebuilt from a partial rollup's (sum, count) pair.

    NULL when no value was counted, exactly like ``avg`` over all-null
    input. Delays are whole minutes, so the double sums are exact and the
    result equals the direct ``avg`` bit for bit.
    """
    return F.round(F.try_divide(total, count.cast("double")), digits)


def num(c: str | Column) -> Column:
    """NULL / NaN -> 0, as the dashboard coerces values before ranking (PRJ8)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def pct(c: str | Column, digits: int = 2) -> Column:
    """Rate -> percent, rounded (PRJ9)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100, digits)
