"""Served read of an output: keyed store first, JSON otherwise (SRC6).

* the keyed store has items -> they are served, tagged ``store``;
* the store is empty -> the JSON output is served, tagged ``json``;
* reading the store fails -> the JSON output, tagged ``json-fallback``;
* neither has rows -> ``DatasetNotReady``.

The emptiness tests are ``isEmpty()`` (a LIMIT 1 job), never a count.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyroll.sinks.keyed import KeyedStore
from skyroll.sources.json_lines import read_json_output


class DatasetNotReady(LookupError):
    pass


def _json_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame | None:
    """None when there is no folder or it has no rows; broken JSON is an error."""
    try:
        df = read_json_output(spark, folder, schema)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if df.isEmpty() else df


def load_dataset(spark: SparkSession, store: KeyedStore, json_folder: str,
                 json_schema: T.StructType) -> DataFrame:
    try:
        items = store.read()
        if items is not None and not items.isEmpty():
            return items.withColumn("data_source", F.lit("store"))
        source = "json"
    except Exception:  # noqa: BLE001 - any store failure falls back to JSON
        source = "json-fallback"
    rows = _json_rows(spark, json_folder, json_schema)
    if rows is None:
        raise DatasetNotReady(f"data not ready for {json_folder}")
    return rows.withColumn("data_source", F.lit(source))
