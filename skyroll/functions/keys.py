"""Item keys for the keyed store (PRJ5).

A NULL key means "no item": such rows stay in the JSON output but are
skipped by the keyed writer (FLT2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def airline_key() -> Column:
    return F.col("AIRLINE").cast("string")


def airport_key() -> Column:
    return F.col("ORIGIN_AIRPORT").cast("string")


def month_key() -> Column:
    """``YYYY-MM``; NULL when either part is missing (no failure)."""
    y, m = F.col("YEAR"), F.col("MONTH")
    return F.when(y.isNotNull() & m.isNotNull(), F.format_string("%04d-%02d", y, m))


def constant_key(value: str = "global") -> Column:
    return F.lit(value)


KEY_RULES = {
    "AIRLINE": airline_key,
    "ORIGIN_AIRPORT": airport_key,
    "YEAR-MONTH": month_key,
    "global": constant_key,
}


def key_for(rule: str) -> Column:
    return KEY_RULES[rule]()
