"""Carrier, airport, month and network aggregates (AGG1-AGG4, TOP1, SRT2, SRT3).

Two equivalent forms are provided:

* **direct**: ``groupBy(key).agg(count(*), round(avg(x), d)...)`` over the fact.
  Catalyst plans a partial (map-side) hash aggregate, a hash shuffle of the
  partial buffers and a final aggregate, so a hot key (one carrier holding a
  third of all flights) is combined inside each task before anything moves.

* **rollup**: one pass over the fact builds a partial rollup at
  (AIRLINE, ORIGIN_AIRPORT, YEAR, MONTH) holding ``count(*)`` and a
  ``(sum, count)`` pair per measure. Every output is a decomposable mean, so
  all four aggregates are re-aggregations of that small table:
  ``round(sum(s) / sum(n), d)``. The fact is scanned once instead of once per
  output, and nothing fact-sized is cached. Delays are whole minutes, so the
  double sums are exact and both forms agree bit for bit (tested).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyroll.schemas import (
    AIRLINE_DELAYS, AIRPORT_DELAYS, AIRPORT_TOP_N, DELAY_DIGITS, MEASURE_ALIAS,
    MONTHLY_DELAYS, RATE_DIGITS, RATES, SUMMARY_MEANS,
)

ROLLUP_KEYS = ["AIRLINE", "ORIGIN_AIRPORT", "YEAR", "MONTH"]
ROLLUP_MEASURES = ["ARRIVAL_DELAY", "DEPARTURE_DELAY", "CARRIER_DELAY", "WEATHER_DELAY",
                   "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY",
                   "CANCELLED", "DIVERTED", "DISTANCE"]


@dataclass(frozen=True)
class AggSpec:
    """Output layout of one aggregate: group keys, count alias, rounded means."""

    keys: tuple[str, ...]
    count_alias: str
    means: tuple[tuple[str, str, int], ...]   # (output alias, fact column, digits)
    year_range: bool = False


def _means(cols: list[str], digits: int) -> list[tuple[str, str, int]]:
    return [(MEASURE_ALIAS[c], c, digits) for c in cols]


AIRLINES = AggSpec(("AIRLINE",), "flights",
                   tuple(_means(AIRLINE_DELAYS, DELAY_DIGITS) + _means(RATES, RATE_DIGITS)))
AIRPORTS = AggSpec(("ORIGIN_AIRPORT",), "flights",
                   tuple(_means(AIRPORT_DELAYS, DELAY_DIGITS) + _means(RATES, RATE_DIGITS)))
MONTHLY = AggSpec(("YEAR", "MONTH"), "flights",
                  tuple(_means(MONTHLY_DELAYS, DELAY_DIGITS) + _means(["CANCELLED"], RATE_DIGITS)))
SUMMARY = AggSpec((), "total_flights", tuple(SUMMARY_MEANS), year_range=True)


# Aggregate lists are written as SQL expression text: one JVM call per
# expression instead of one per nested function, same Catalyst plan.

def _year_range() -> list[Column]:
    return [F.expr("min(YEAR) AS min_year"), F.expr("max(YEAR) AS max_year")]


def _direct_columns(spec: AggSpec) -> list[Column]:
    cols = [F.expr(f"count(1) AS {spec.count_alias}")]
    cols += [F.expr(f"round(avg(`{src}`), {d}) AS `{alias}`") for alias, src, d in spec.means]
    return cols + (_year_range() if spec.year_range else [])


def _rollup_columns(spec: AggSpec) -> list[Column]:
    """``round(sum(s) / sum(c), d)``; NULL when nothing was counted (like ``avg``)."""
    cols = [F.expr(f"sum(n) AS {spec.count_alias}")]
    cols += [F.expr(f"round(try_divide(sum(`s_{src}`), CAST(sum(`c_{src}`) AS DOUBLE)), {d}) "
                    f"AS `{alias}`") for alias, src, d in spec.means]
    return cols + (_year_range() if spec.year_range else [])


def _aggregate(df: DataFrame, spec: AggSpec, columns: list[Column]) -> DataFrame:
    if spec.keys:
        return df.groupBy(*spec.keys).agg(*columns)
    return df.agg(*columns)


def _by_volume(df: DataFrame, key: str) -> DataFrame:
    # Volume ties are broken by key so the order (and any top-k cut) is stable.
    return df.orderBy(F.col("flights").desc(), F.col(key).asc_nulls_last())


# ---------------------------------------------------------------- direct form

def by_airline(flights: DataFrame, ordered: bool = True) -> DataFrame:
    out = _aggregate(flights, AIRLINES, _direct_columns(AIRLINES))
    return _by_volume(out, "AIRLINE") if ordered else out


def by_airport(flights: DataFrame) -> DataFrame:
    """Every origin airport, unranked (input of the top-k and the rollup test)."""
    return _aggregate(flights, AIRPORTS, _direct_columns(AIRPORTS))


def by_airport_top(flights: DataFrame, n: int = AIRPORT_TOP_N) -> DataFrame:
    """Busiest ``n`` origin airports (TOP1): ``TakeOrderedAndProject`` keeps a
    bounded top-n heap per partition, so no global sort of all airports."""
    return _by_volume(by_airport(flights), "ORIGIN_AIRPORT").limit(n)


def by_month(flights: DataFrame, ordered: bool = True) -> DataFrame:
    out = _aggregate(flights, MONTHLY, _direct_columns(MONTHLY))
    return out.orderBy("YEAR", "MONTH") if ordered else out


def summary(flights: DataFrame) -> DataFrame:
    return _aggregate(flights, SUMMARY, _direct_columns(SUMMARY))


# ---------------------------------------------------------------- rollup form

def flight_rollup(flights: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Partial rollup at (AIRLINE, ORIGIN_AIRPORT, YEAR, MONTH[, extra keys]).

    Its size is bounded by carriers x airports x months, independent of the
    number of flights. ``extra_keys`` lets a run keep e.g. the source label.
    """
    cols = [F.expr("count(1) AS n")]
    for m in ROLLUP_MEASURES:
        cols += [F.expr(f"sum(`{m}`) AS `s_{m}`"), F.expr(f"count(`{m}`) AS `c_{m}`")]
    return flights.groupBy(*extra_keys, *ROLLUP_KEYS).agg(*cols)


def airline_from_rollup(rollup: DataFrame, ordered: bool = True) -> DataFrame:
    out = _aggregate(rollup, AIRLINES, _rollup_columns(AIRLINES))
    return _by_volume(out, "AIRLINE") if ordered else out


def airport_from_rollup(rollup: DataFrame) -> DataFrame:
    return _aggregate(rollup, AIRPORTS, _rollup_columns(AIRPORTS))


def airport_top_from_rollup(rollup: DataFrame, n: int = AIRPORT_TOP_N) -> DataFrame:
    return _by_volume(airport_from_rollup(rollup), "ORIGIN_AIRPORT").limit(n)


def month_from_rollup(rollup: DataFrame, ordered: bool = True) -> DataFrame:
    out = _aggregate(rollup, MONTHLY, _rollup_columns(MONTHLY))
    return out.orderBy("YEAR", "MONTH") if ordered else out


def summary_from_rollup(rollup: DataFrame) -> DataFrame:
    return _aggregate(rollup, SUMMARY, _rollup_columns(SUMMARY))


def merge_rollups(*rollups: DataFrame) -> DataFrame:
    """Combine partial rollups (e.g. an existing one and a new batch).

    Counts and sums add up, so the merge is another partial aggregation.
    """
    base = rollups[0]
    for r in rollups[1:]:
        base = base.unionByName(r)
    keys = [c for c in base.columns if c == "n" or c.startswith(("s_", "c_"))]
    group = [c for c in base.columns if c not in keys]
    return base.groupBy(*group).agg(*[F.sum(c).alias(c) for c in keys])


# ------------------------------------------------------- grouping-sets form
#
# One scan, one shuffle for all four outputs: GROUPING SETS over
# (AIRLINE), (ORIGIN_AIRPORT), (YEAR, MONTH) and () expands each row once per
# set inside the task (codegen'd Expand), and the partial aggregate then
# holds only carriers + airports + months + 1 groups per task. The shuffle
# is therefore tiny whatever the fact size, unlike a 4-key rollup whose
# per-task buffers grow with carriers x airports x months.

GRAIN_KEYS = ["AIRLINE", "ORIGIN_AIRPORT", "YEAR", "MONTH"]
GRAIN_SETS = {
    "airline": ["AIRLINE"],
    "airport": ["ORIGIN_AIRPORT"],
    "month": ["YEAR", "MONTH"],
    "all": [],
}
MEASURE_DIGITS = {m: (RATE_DIGITS if m in RATES else DELAY_DIGITS) for m in ROLLUP_MEASURES}


def _grain_of(keys: list[str], grouped: list[str]) -> int:
    """Spark's grouping_id: bit (n-1-i) is set when key i is not grouped."""
    n = len(keys)
    return sum(1 << (n - 1 - i) for i, k in enumerate(keys) if k not in grouped)


def grain_table(flights: DataFrame, extra_sets: dict[str, list[str]] | None = None) -> DataFrame:
    """All four aggregates (plus any ``extra_sets``) in one grouped pass.

    Columns: ``grain``, the grouping keys, ``n`` and the rounded mean of every
    measure under its fact column name, ``min_year`` / ``max_year``.
    """
    sets = dict(GRAIN_SETS)
    sets.update(extra_sets or {})
    keys = list(GRAIN_KEYS)
    for cols in sets.values():
        keys += [c for c in cols if c not in keys]
    aggs = [F.grouping_id(*keys).alias("_gid"), F.expr("count(1) AS n")]
    aggs += [F.expr(f"round(avg(`{m}`), {MEASURE_DIGITS[m]}) AS `{m}`") for m in ROLLUP_MEASURES]
    aggs += _year_range()
    table = flights.groupingSets([[F.col(c) for c in cols] for cols in sets.values()],
                                 *keys).agg(*aggs)
    gid_col = F.col("_gid")
    grain = F.lit(None).cast("string")
    for name, cols in reversed(list(sets.items())):
        grain = F.when(gid_col == _grain_of(keys, cols), F.lit(name)).otherwise(grain)
    return table.select(grain.alias("grain"), *keys, "n", *ROLLUP_MEASURES,
                        "min_year", "max_year")


def _from_grain(table: DataFrame, grain: str, spec: AggSpec) -> DataFrame:
    part = table.filter(F.col("grain") == grain)
    cols = [F.col(k) for k in spec.keys] + [F.col("n").alias(spec.count_alias)]
    cols += [F.col(src).alias(alias) for alias, src, _ in spec.means]
    if spec.year_range:
        cols += [F.col("min_year"), F.col("max_year")]
    return part.select(*cols)


def airline_from_grains(table: DataFrame, ordered: bool = True) -> DataFrame:
    out = _from_grain(table, "airline", AIRLINES)
    return _by_volume(out, "AIRLINE") if ordered else out


def airport_top_from_grains(table: DataFrame, n: int = AIRPORT_TOP_N) -> DataFrame:
    return _by_volume(_from_grain(table, "airport", AIRPORTS), "ORIGIN_AIRPORT").limit(n)


def month_from_grains(table: DataFrame, ordered: bool = True) -> DataFrame:
    out = _from_grain(table, "month", MONTHLY)
    return out.orderBy("YEAR", "MONTH") if ordered else out


def summary_from_grains(table: DataFrame) -> DataFrame:
    return _from_grain(table, "all", SUMMARY)


# ------------------------------------------------- additive (mergeable) grains
#
# The same grouping sets, but holding counts and sums instead of rounded
# means. Two such tables merge by adding them up, which makes the grain table
# usable as incremental state (streaming, or appending a new month of files).

def additive_grain_table(flights: DataFrame,
                         extra_sets: dict[str, list[str]] | None = None,
                         by: list[str] | None = None) -> DataFrame:
    """``by`` names columns that are grouped on in every set (e.g. the source file)."""
    by = by or []
    sets = {name: [*by, *cols] for name, cols in {**GRAIN_SETS, **(extra_sets or {})}.items()}
    keys = [*by, *GRAIN_KEYS]
    for cols in sets.values():
        keys += [c for c in cols if c not in keys]
    aggs = [F.grouping_id(*keys).alias("_gid"), F.expr("count(1) AS n")]
    for m in ROLLUP_MEASURES:
        aggs += [F.expr(f"sum(`{m}`) AS `s_{m}`"), F.expr(f"count(`{m}`) AS `c_{m}`")]
    aggs += _year_range()
    table = flights.groupingSets([[F.col(c) for c in cols] for cols in sets.values()],
                                 *keys).agg(*aggs)
    grain = F.lit(None).cast("string")
    for name, cols in reversed(list(sets.items())):
        grain = F.when(F.col("_gid") == _grain_of(keys, cols), F.lit(name)).otherwise(grain)
    parts = [c for m in ROLLUP_MEASURES for c in (f"s_{m}", f"c_{m}")]
    return table.select(grain.alias("grain"), *keys, "n", *parts, "min_year", "max_year")


def merge_additive(*tables: DataFrame) -> DataFrame:
    """Add up additive grain tables (grain and key columns identify a row)."""
    base = tables[0]
    for t in tables[1:]:
        base = base.unionByName(t)
    sums = [c for c in base.columns if c == "n" or c.startswith(("s_", "c_"))]
    keys = [c for c in base.columns if c not in sums and c not in ("min_year", "max_year")]
    return base.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums],
                                   F.min("min_year").alias("min_year"),
                                   F.max("max_year").alias("max_year"))


def grains_from_additive(table: DataFrame) -> DataFrame:
    """Rounded means from an additive grain table: same layout as ``grain_table``."""
    keys = [c for c in table.columns
            if c not in ("n", "min_year", "max_year") and not c.startswith(("s_", "c_"))]
    means = [F.expr(f"round(try_divide(`s_{m}`, CAST(`c_{m}` AS DOUBLE)), {MEASURE_DIGITS[m]}) "
                    f"AS `{m}`") for m in ROLLUP_MEASURES]
    return table.select(*keys, "n", *means, "min_year", "max_year")
