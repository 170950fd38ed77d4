"""Headered CSV scan of the raw flight layouts (SRC1, SRC2).

Raw files are read with ``header=true`` and no schema inference: every
column is a string and conversion happens in ``standardise``. Inference
would cost a second full pass over the input and guess types per file.
Paths may be globs or directories, so a layout can span many files. Columns
are found by header name; a file whose header differs from the first one's
fails the read (``enforceSchema=false``) instead of being misread by position.
The scan splits them into ``spark.sql.files.maxPartitionBytes`` chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyroll.schemas import SourceSpec, source_specs


def read_raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    reader = (spark.read
              .option("header", "true")
              .option("inferSchema", "false")
              .option("mode", "PERMISSIVE")
              .option("multiLine", "false")
              .option("enforceSchema", "false"))
    return reader.csv(path)


def read_sources(spark: SparkSession, paths: dict[str, str],
                 specs: list[SourceSpec] | None = None) -> dict[str, DataFrame]:
    """Label -> raw DataFrame for every layout that has a path (SRC2)."""
    specs = specs or source_specs(paths)
    return {s.label: read_raw_csv(spark, s.path) for s in specs if s.path}
