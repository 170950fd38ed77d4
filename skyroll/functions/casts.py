"""Typed casts from raw strings (PRJ3).

Raw files are read with every column as a string and converted here. The
rules reproduce the lenient (non-ANSI) cast the data was first processed
with, while running safely on an ANSI session:

* double: ``try_cast``; unparsable text ('', 'NA', 'x') becomes NULL. The
  literal 'NaN' parses to a NaN double, which would poison every mean; it is
  turned into NULL as well (a deliberate departure).
* int: parse as double first, then ``try_cast`` to int. That keeps '1.0' and
  '1.7' as 1 (the lenient cast truncated them) and turns out-of-range values
  such as '99999999999' into NULL.
* string: unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def to_int(c: Column) -> Column:
    return to_double(c).try_cast("int")


def typed_sql(name: str, kind: str) -> str:
    """The same rules as SQL text over column ``name`` (one expression string,
    parsed on the JVM side; used for wide projections)."""
    ref = f"`{name}`"
    as_double = (f"CASE WHEN abs(try_cast({ref} AS DOUBLE)) < double('Infinity') "
                 f"THEN try_cast({ref} AS DOUBLE) END")
    if kind == "double":
        return as_double
    if kind == "int":
        return f"try_cast({as_double} AS INT)"
    if kind == "string":
        return f"CAST({ref} AS STRING)"
    raise ValueError(f"unsupported target type {kind!r}")


def typed(c: Column, kind: str) -> Column:
    if kind == "double":
        return to_double(c)
    if kind == "int":
        return to_int(c)
    if kind == "string":
        return c.cast("string")
    raise ValueError(f"unsupported target type {kind!r}")
