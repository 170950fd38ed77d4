"""CSV export of an output (SNK5, SET2).

Header row from the union of the inputs' columns, fields that contain a
quote, comma, CR or LF are quoted with inner quotes doubled, NULL and empty
strings are written as nothing, nested values as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyroll.operators.setops import union_headers


def flatten_for_csv(df: DataFrame) -> DataFrame:
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select([F.to_json(F.col(f.name)).alias(f.name)
                      if isinstance(f.dataType, nested) else F.col(f.name)
                      for f in df.schema.fields])


def write_csv(frames: DataFrame | list[DataFrame], folder: str, single_file: bool = True) -> None:
    df = union_headers(frames) if isinstance(frames, list) else frames
    df = flatten_for_csv(df)
    if single_file:
        df = df.coalesce(1)
    (df.write.mode("overwrite")
       .option("header", "true")
       .option("quote", '"')
       .option("escape", '"')
       .option("nullValue", "")
       .option("emptyValue", "")
       .csv(folder))
