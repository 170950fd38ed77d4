"""Labels and grades (PRJ10, PRJ11, PRJ12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyroll.functions.measures import num
from skyroll.schemas import MONTH_ABBREV, MONTH_NAMES

# Severity thresholds in minutes and cancellation grade
# thresholds in percent, with the grade texts.
SEVERITY_HIGH = 20
SEVERITY_MED = 10
GRADE_POSITIVE_BELOW = 1.5
GRADE_INFO_BELOW = 2.5
GRADE_NOTES = {
    "positive": "Cancellations are low.",
    "info": "Cancellations are noticeable; compare the months.",
    "warning": "Cancellations are high; compare the causes.",
}


def _month_lookup(names: list[str], month: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), month.cast("int"))


def month_name(month: Column) -> Column:
    """1 -> 'January'; NULL outside 1..12."""
    return _month_lookup(MONTH_NAMES, month)


def month_label(year: Column, month: Column) -> Column:
    """'Jan 2015'. A missing or zero month reads as January, a missing or
    zero year as an empty string; months past 12 have no name."""
    m = F.coalesce(F.when(month != 0, month), F.lit(1))
    y = F.coalesce(F.when(year != 0, year.cast("string")), F.lit(""))
    return F.concat(F.coalesce(_month_lookup(MONTH_ABBREV, m), F.lit("")), F.lit(" "), y)


def delay_severity(c: Column) -> Column:
    """'high' (>= 20 min), 'med' (>= 10), else 'low'; NULL counts as 0."""
    v = num(c)
    return (F.when(v >= SEVERITY_HIGH, F.lit("high"))
            .when(v >= SEVERITY_MED, F.lit("med"))
            .otherwise(F.lit("low")))


def cancellation_grade(rate_pct: Column) -> Column:
    return (F.when(rate_pct < GRADE_POSITIVE_BELOW, F.lit("positive"))
            .when(rate_pct < GRADE_INFO_BELOW, F.lit("info"))
            .otherwise(F.lit("warning")))


def cancellation_note(grade: Column) -> Column:
    expr = F.lit(None).cast("string")
    for kind, text in reversed(list(GRADE_NOTES.items())):
        expr = F.when(grade == kind, F.lit(text)).otherwise(expr)
    return expr
