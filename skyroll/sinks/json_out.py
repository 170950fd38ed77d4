"""Aggregate -> one JSON-lines file, replacing the folder (SNK1).

``coalesce(1)`` is safe only because every output is small by construction
(one row per carrier / month, the top airports, one summary row); it moves
the final rows, never the fact, into the writing task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_output(df: DataFrame, folder: str, single_file: bool = True) -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").json(folder)
