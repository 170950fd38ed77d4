"""Rankings over the served aggregates (TOP2-TOP7, SRT1, AGG8, AGG9, PRJ11, CMP2).

Inputs are the small served tables (one row per carrier, the top airports,
one row per month). Every top-k is ``orderBy(...).limit(k)`` with a stable
tie-break on the key, which Spark runs as ``TakeOrderedAndProject``: a
bounded heap per partition and a k-row merge. Values are coerced with
``num`` (NULL / NaN -> 0) before ranking, as the dashboard does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyroll.functions.labels import delay_severity
from skyroll.functions.measures import num, pct

# Measure labels of the airport delay matrix, in chart order.
MATRIX_MEASURES = [
    ("Arrival Delay", "arrival_delay"),
    ("Departure Delay", "departure_delay"),
    ("Carrier Delay", "carrier_delay"),
    ("Weather Delay", "weather_delay"),
    ("NAS Delay", "nas_delay"),
]
BREAKDOWN_CAUSES = ["carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_delay"]
MIN_FLIGHTS = 100_000    # a carrier counts as best or worst above this
SEVERITY_COLUMNS = ["arrival_delay", "departure_delay", "carrier_delay", "weather_delay",
                    "nas_delay", "security_delay", "late_delay"]


def _top_by_volume(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(num("flights").desc(), F.col(key).asc_nulls_last()).limit(n)


def airport_traffic(airports: DataFrame, n: int = 15) -> DataFrame:
    """Busiest airports with delay and cancellation (TOP2)."""
    top = _top_by_volume(airports, "ORIGIN_AIRPORT", n)
    return top.select(
        "ORIGIN_AIRPORT",
        F.coalesce("flights", F.lit(0)).cast("bigint").alias("flights"),
        num("arrival_delay").alias("arrival_delay"),
        num("cancelled").alias("cancelled"),
        pct(num("cancelled")).alias("cancelled_pct"),
    )


def airport_delay_matrix(airports: DataFrame, n: int = 10) -> DataFrame:
    """Top airports x five delay measures, wide form (TOP3)."""
    top = _top_by_volume(airports, "ORIGIN_AIRPORT", n)
    return top.select("ORIGIN_AIRPORT", *[num(c).alias(c) for _, c in MATRIX_MEASURES])


def airport_delay_matrix_long(airports: DataFrame, n: int = 10) -> DataFrame:
    """Same matrix in long form: one row per (airport, measure)."""
    wide = airport_delay_matrix(airports, n).select(
        "ORIGIN_AIRPORT", *[F.col(c).alias(label) for label, c in MATRIX_MEASURES])
    return wide.unpivot("ORIGIN_AIRPORT", [label for label, _ in MATRIX_MEASURES],
                        "measure", "minutes")


def delay_breakdown(airlines: DataFrame, n: int = 12) -> DataFrame:
    """Busiest carriers with the five cause means and their total (TOP4, AGG8)."""
    top = _top_by_volume(airlines, "AIRLINE", n)
    parts = [num(c) for c in BREAKDOWN_CAUSES]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return top.select("AIRLINE", F.col("flights").cast("bigint").alias("flights"),
                      *[p.alias(c) for p, c in zip(parts, BREAKDOWN_CAUSES)],
                      total.alias("total_delay"))


def cancellation_ranking(airlines: DataFrame, n: int = 15) -> DataFrame:
    """Carriers by cancellation percent with intensity vs the maximum (TOP5, AGG9).

    The ratio window spans the ``n`` ranked rows only.
    """
    ranked = (airlines
              .select("AIRLINE", num("flights").cast("bigint").alias("flights"),
                      (num("cancelled") * 100).alias("cancel_pct"))
              .orderBy(F.col("cancel_pct").desc(), F.col("AIRLINE").asc_nulls_last())
              .limit(n))
    top = F.max("cancel_pct").over(Window.partitionBy())
    return ranked.withColumn("intensity",
                             F.when(top > 0, F.col("cancel_pct") / top))


SORTABLE = ["AIRLINE", "flights", "arrival_delay", "departure_delay", "carrier_delay",
            "weather_delay", "nas_delay", "security_delay", "late_delay", "cancelled",
            "diverted"]


def airline_table_sorted(airlines: DataFrame, key: str = "flights",
                         descending: bool = True) -> DataFrame:
    """Carrier table sorted on any column, NULL as 0 (or '' for text) (SRT1).

    A ``position`` column records the order; it is a row number over the
    carrier table, which has one row per carrier.
    """
    if key not in SORTABLE:
        raise ValueError(f"cannot sort by {key!r}")
    text = dict(airlines.dtypes)[key] == "string"
    value: Column = F.coalesce(F.col(key), F.lit("")) if text else num(key)
    order = value.desc() if descending else value.asc()
    w = Window.orderBy(order, F.col("AIRLINE").asc_nulls_last())
    return airlines.withColumn("position", F.row_number().over(w))


def airline_severity(airlines: DataFrame) -> DataFrame:
    """Severity class of every delay cell of the carrier table (PRJ11)."""
    return airlines.select("AIRLINE",
                           *[delay_severity(F.col(c)).alias(f"{c}_class")
                             for c in SEVERITY_COLUMNS])


def delay_scatter(airports: DataFrame) -> DataFrame:
    """Departure vs arrival delay per airport with volume (CMP2)."""
    return airports.select(
        "ORIGIN_AIRPORT",
        num("departure_delay").alias("departure_delay"),
        num("arrival_delay").alias("arrival_delay"),
        num("flights").cast("bigint").alias("flights"),
        num("cancelled").alias("cancelled"),
        (num("arrival_delay") > num("departure_delay")).alias("above_diagonal"),
    )


def best_carrier(airlines: DataFrame, min_flights: int = MIN_FLIGHTS) -> DataFrame:
    """Lowest mean arrival delay among carriers above ``min_flights`` (FLT3, TOP6)."""
    eligible = airlines.filter(num("flights") > min_flights)
    return (eligible.orderBy(num("arrival_delay").asc(), F.col("AIRLINE").asc_nulls_last())
            .limit(1)
            .select("AIRLINE", num("arrival_delay").alias("arrival_delay"),
                    F.col("flights").cast("bigint").alias("flights")))


def worst_carrier(airlines: DataFrame, min_flights: int = MIN_FLIGHTS) -> DataFrame:
    """Highest mean arrival delay; reported only when two or more carriers are
    eligible (TOP6). The eligibility count is a window over carrier rows."""
    eligible = (airlines.filter(num("flights") > min_flights)
                .withColumn("_eligible", F.count(F.lit(1)).over(Window.partitionBy())))
    return (eligible.filter(F.col("_eligible") > 1)
            .orderBy(num("arrival_delay").desc(), F.col("AIRLINE").asc_nulls_last())
            .limit(1)
            .select("AIRLINE", num("arrival_delay").alias("arrival_delay"),
                    F.col("flights").cast("bigint").alias("flights")))


def busiest_airport(airports: DataFrame) -> DataFrame:
    """Origin airport with the most departures (TOP7)."""
    return (_top_by_volume(airports, "ORIGIN_AIRPORT", 1)
            .select("ORIGIN_AIRPORT", num("flights").cast("bigint").alias("flights"),
                    num("arrival_delay").alias("arrival_delay")))
