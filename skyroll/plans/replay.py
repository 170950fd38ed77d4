"""Replay JSON outputs into the keyed store (SNK4).

For each output folder: read its ``part-*.json`` files with the output's
schema (SRC3); an empty folder is skipped; otherwise the rows become keyed
items (NULL keys dropped) and are upserted as a new snapshot. The result is
one row per output with the number of items written (NULL keys excluded).
The first failure stops the replay, like the standalone loader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyroll.operators.aggregates import grain_table
from skyroll.plans.dashboard import outputs_from_grains
from skyroll.schemas import FLIGHTS_SCHEMA, KEYED_OUTPUTS, OUTPUT_NAMES
from skyroll.sinks.keyed import KeyedStore, keyed_items, written_count
from skyroll.sources.json_lines import read_json_output


def output_schemas(spark: SparkSession) -> dict[str, T.StructType]:
    """Schemas of the four outputs, taken from the plan (nothing is run)."""
    empty = spark.createDataFrame([], FLIGHTS_SCHEMA)
    outs = outputs_from_grains(grain_table(empty))
    return {name: df.schema for name, df in outs.as_dict().items()}


def replay(spark: SparkSession, json_root: str, store_root: str) -> DataFrame:
    schemas = output_schemas(spark)
    counts = []
    for name in OUTPUT_NAMES:
        table, rule = KEYED_OUTPUTS[name]
        rows = read_json_output(spark, f"{json_root}/{name}", schemas[name])
        if rows.isEmpty():
            continue
        items = keyed_items(rows, rule)
        KeyedStore(spark, store_root, table).upsert(items)
        counts.append(written_count(items).select(
            F.lit(name).alias("output"), F.lit(table).alias("store_table"), "written"))
    if not counts:
        return spark.createDataFrame([], "output string, store_table string, written bigint")
    return reduce(lambda a, b: a.unionByName(b), counts)
