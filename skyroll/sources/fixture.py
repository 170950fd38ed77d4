"""Deterministic flight records generated from ``lineitem``.

The driver's tables hold no flights, so raw flight rows in both historical
layouts are derived from ``lineitem`` by a fixed rule (FIXTURES.md, F6).
The rows come out as strings, exactly like a headered CSV scan, so the
standardise / union / aggregate path runs for real and grows with the
table. Only the columns the rule needs are read from the parquet file, and
the layout split (generated year <= 2017 vs later) is a ship-date range
pushed down to the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyroll.schemas import SourceSpec, source_specs

# Fixture column order; position i maps to source column i of each layout.
FIXTURE_COLUMNS = ["yr", "mo", "dy", "dow", "airline", "origin", "dest", "arr_delay",
                   "dep_delay", "carrier_d", "weather_d", "nas_d", "security_d", "late_d",
                   "cancelled", "diverted", "distance"]
LAST_2015_YEAR = 2017


# The generation rule as SQL expressions (FIXTURES.md, F6), evaluated in one
# projection. "Cause" columns are set only for flights that arrived 15+
# minutes late and were neither cancelled nor diverted.
_BASE = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
    "CAST(l_shipdate AS DATE) AS d",
    "(l_orderkey + l_suppkey) % 53 = 0 AS cx",
    "(l_orderkey + l_partkey) % 211 = 0 AS dv",
    "CAST(floor(l_extendedprice) AS BIGINT) % 140 - 25 AS arr",
]
_CAUSE = "CASE WHEN NOT cx AND NOT dv AND arr >= 15 THEN CAST(arr % {m} AS STRING) END"
_FIXTURE_SQL = {
    "yr": "CAST(year(d) + 20 AS STRING)",
    "mo": "CAST(month(d) AS STRING)",
    "dy": "CAST(day(d) AS STRING)",
    "dow": "CAST(extract(DAYOFWEEK_ISO FROM d) AS STRING)",
    "airline": ("CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE "
                "concat('C', lpad(CAST((l_suppkey * 7 + l_partkey) % 17 AS STRING), 2, '0')) END"),
    "origin": "concat('A', lpad(CAST(l_partkey % 120 AS STRING), 3, '0'))",
    "dest": "concat('A', lpad(CAST(l_orderkey % 120 AS STRING), 3, '0'))",
    "arr_delay": "CASE WHEN cx OR dv THEN NULL ELSE CAST(arr AS STRING) END",
    "dep_delay": "CASE WHEN cx THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) * 2 - 12 AS STRING) END",
    "carrier_d": _CAUSE.format(m=37),
    "weather_d": _CAUSE.format(m=11),
    "nas_d": _CAUSE.format(m=23),
    "security_d": _CAUSE.format(m=3),
    "late_d": _CAUSE.format(m=29),
    "cancelled": "CASE WHEN cx THEN '1' ELSE '0' END",
    "diverted": "CASE WHEN dv AND NOT cx THEN '1' ELSE '0' END",
    "distance": "CAST(100 + l_partkey % 2400 AS STRING)",
}
assert list(_FIXTURE_SQL) == FIXTURE_COLUMNS


def fixture_flights_raw(lineitem: DataFrame) -> DataFrame:
    """All generated flights as raw strings in fixture column names."""
    return (lineitem.selectExpr(*_BASE)
            .selectExpr(*[f"{expr} AS {name}" for name, expr in _FIXTURE_SQL.items()]))


def _as_layout(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    # positional rename: fixture column i becomes the layout's source column i
    return raw.toDF(*spec.source_columns)


def fixture_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Label -> raw string DataFrame in that layout's headers."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    # The layouts split at generated year 2017, i.e. ship year 1997. Stated
    # on the raw timestamp the split is a plain range predicate, which the
    # parquet reader receives as a pushed filter and can use to skip row
    # groups by their statistics; a predicate on the generated string could
    # not be pushed. A NULL ship date has no year and goes to the later layout.
    cut = f"TIMESTAMP_NTZ'{LAST_2015_YEAR - 20 + 1}-01-01 00:00:00'"
    specs = {s.label: s for s in source_specs()}
    early = fixture_flights_raw(lineitem.filter(f"l_shipdate < {cut}"))
    late = fixture_flights_raw(
        lineitem.filter(f"l_shipdate >= {cut} OR l_shipdate IS NULL"))
    return {
        "2015": _as_layout(early, specs["2015"]),
        "2018_2024": _as_layout(late, specs["2018_2024"]),
    }
