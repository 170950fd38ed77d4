"""Data checks and run bookkeeping (FLT1, FLT2, FLT6, FLT7, FLT8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_airline_check(flights: DataFrame) -> DataFrame:
    """Rows without a carrier code (FLT1), next to the total, in one pass."""
    return flights.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("AIRLINE").isNull()).alias("null_airline_rows"),
    )


def drop_null_keys(items: DataFrame, key: str = "item_key") -> DataFrame:
    """Rows with a NULL key never reach the keyed store (FLT2)."""
    return items.filter(F.col(key).isNotNull())


def source_profile(raw_by_label: dict[str, DataFrame]) -> DataFrame:
    """Rows and column count per raw source (FLT6).

    Each source is counted by a global aggregate (partial counts per task,
    one tiny final merge); the column count is schema metadata.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("raw_rows"))
          .select(F.lit(label).alias("source"), "raw_rows",
                  F.lit(len(df.columns)).alias("raw_columns"))
        for label, df in raw_by_label.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def readiness(outputs: dict[str, DataFrame]) -> DataFrame:
    """Per-output row counts and the all-four-non-empty gate (FLT7).

    The window spans exactly one row per output (four rows), never data.
    """
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("output"), "rows")
             for name, df in outputs.items()]
    counts = reduce(lambda a, b: a.unionByName(b), parts)
    everything = Window.partitionBy()
    return (counts
            .withColumn("ready", F.col("rows") > 0)
            .withColumn("all_ready", F.bool_and(F.col("rows") > 0).over(everything)))


def run_totals(summary: DataFrame, airlines: DataFrame, airports: DataFrame,
               monthly: DataFrame) -> DataFrame:
    """Total rows and the number of carriers, airports and months (FLT8)."""
    counts = [
        summary.select(F.col("total_flights").alias("v"), F.lit("total_rows").alias("k")),
        airlines.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("airlines")),
        airports.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("airports")),
        monthly.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("periods")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), counts)
    return (stacked.groupBy().pivot("k", ["total_rows", "airlines", "airports", "periods"])
            .agg(F.first("v")))


__all__ = ["null_airline_check", "drop_null_keys", "source_profile", "readiness",
           "run_totals"]
