"""JSON-lines aggregate reader (SRC3).

Reads every ``part-*.json`` file of an output folder (marker files such as
``_SUCCESS`` are skipped by the glob filter) with an explicit schema: the
JSON writer drops null fields, so inference would lose columns that happen
to be all-null. Blank lines produce no rows; a broken line fails the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_json_output(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema)
            .option("pathGlobFilter", "part-*.json")
            .option("mode", "FAILFAST")
            .json(folder))
