"""Column expressions: casts, rounded means, keys, decimals and labels.

Every helper returns a ``pyspark.sql.Column`` built from built-in functions,
so it stays inside whole-stage codegen; none of them is a Python UDF.
"""

from skyroll.functions.casts import typed, to_double, to_int
from skyroll.functions.measures import (
    mean_from_parts, num, pct, round_half_up, rounded_mean,
)
from skyroll.functions.keys import airline_key, airport_key, month_key, constant_key
from skyroll.functions.decimals import to_store_decimal, decimalise_columns
from skyroll.functions.labels import (
    cancellation_grade, cancellation_note, delay_severity, month_label, month_name,
)

__all__ = [
    "typed", "to_double", "to_int",
    "mean_from_parts", "num", "pct", "round_half_up", "rounded_mean",
    "airline_key", "airport_key", "month_key", "constant_key",
    "to_store_decimal", "decimalise_columns",
    "cancellation_grade", "cancellation_note", "delay_severity", "month_label", "month_name",
]
