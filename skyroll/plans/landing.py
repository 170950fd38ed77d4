"""Raw files -> typed fact beside its rejected lines, in one scan (SRC1, FLT1, FLT6, FLT8).

A line that has fewer or more fields than its file's header can't be bound to
columns; such lines are kept as text in a reject channel, never half-filled in the
fact. Fact and rejects are one Parquet table with a folder for each kind, so a
single scan of the CSV files writes both; counts of each file come from the small
``FILE`` column of that table, and the totals are observed while it is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyroll.operators.standardise import standardise, unify
from skyroll.schemas import FLIGHTS_SCHEMA, source_specs
from skyroll.sources.headers import FILE, REJECTED, read_raw_groups

SOURCE_COL = "source"
KIND = "kind"
OK, BAD = "ok", "rejected"


@dataclass
class Landed:
    """What a landing wrote: ``flights`` (canonical columns and the source label),
    ``rejects`` (source, file, line), ``counts`` (a row per file) and the observed
    ``totals`` of the same write."""

    flights: DataFrame
    rejects: DataFrame
    counts: DataFrame
    totals: dict[str, int]


def checked_flights(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Canonical columns, source label, file, kind and (for rejects only) the line."""
    parts = []
    for spec in source_specs(paths):
        if not spec.path:
            continue
        raw = read_raw_groups(spark, spec.path, spec, rejects=True)
        # the rejected line travels beside the typed columns of its row
        typed = standardise(raw, spec, carried=[REJECTED, FILE])
        good = F.col(REJECTED).isNull()
        parts.append(typed.select(
            F.when(good, F.lit(OK)).otherwise(F.lit(BAD)).alias(KIND),
            F.lit(spec.label).alias(SOURCE_COL), F.col(FILE).alias("file"),
            F.col(REJECTED).alias("line"),
            *[F.when(good, F.col(c)).alias(c) for c in FLIGHTS_SCHEMA.fieldNames()]))
    return unify(parts)


def land(spark: SparkSession, paths: dict[str, str], out: str,
         group: Column | None = None) -> Landed:
    """Write the fact and its rejects under ``out``. ``group``, an expression over
    ``file``, names what ``counts`` has a row for (default: the file itself)."""
    seen = Observation("landing")
    good = F.col(KIND) == OK
    rows = checked_flights(spark, paths).observe(
        seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(good).alias("rows_ok"),
        F.count_if(~good).alias("rows_rejected"),
        F.count_if(good & F.col("AIRLINE").isNull()).alias("null_airline_rows"))
    rows.write.mode("errorifexists").partitionBy(KIND).parquet(out)
    table = spark.read.schema(rows.schema).parquet(out)
    counts = (table.groupBy(SOURCE_COL, (F.col("file") if group is None else group).alias("file"))
              .agg(F.count(F.lit(1)).alias("rows_in"),
                   F.count_if(F.col(KIND) == OK).alias("rows_ok"),
                   F.count_if(F.col(KIND) == BAD).alias("rows_rejected")))
    return Landed(
        flights=table.where(F.col(KIND) == OK).select(SOURCE_COL, *FLIGHTS_SCHEMA.fieldNames()),
        rejects=table.where(F.col(KIND) == BAD).select(SOURCE_COL, "file", "line"),
        counts=counts, totals=dict(seen.get))
