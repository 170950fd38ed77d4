"""Set operations and dedup (SET1 lives in ``standardise``; SET2, SET3 here)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_headers(frames: list[DataFrame]) -> DataFrame:
    """Union rows with uneven columns; missing columns become NULL (SET2).

    Column order is first-seen order across the inputs, like a header union.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# Names beyond this would not make a table any more.
MOST_COLUMNS = 10_000


def read_row_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value, seen): JSON rows and where they stand, in the order of files and lines."""
    place = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).where(F.trim("value") != "").select("value", place.alias("seen"))


def row_keys(rows: DataFrame, column: str = "value", seen: str = "seen") -> list[str]:
    """The keys of all JSON rows, in the order in which they are first met: by row, then
    by place in the row. One aggregate; only the distinct names come to the driver."""
    keys = rows.select(seen, F.posexplode(F.json_object_keys(column)).alias("at", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(seen, "at")).alias("first"))
    found = first.orderBy("first").limit(MOST_COLUMNS + 1).select("key").collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"the rows have more than {MOST_COLUMNS} different keys")
    return [r.key for r in found]


def union_row_headers(rows: DataFrame, column: str = "value", seen: str = "seen") -> DataFrame:
    """JSON rows with uneven keys as one table of texts (SET2): a column per key of any
    row, NULL where a row lacks it, nested values as JSON. Rows are parsed once, as
    VARIANT, so no row needs the schema of another."""
    names = row_keys(rows, column, seen)
    cells = rows.select(F.parse_json(column).cast("map<string,string>").alias("cells"))
    return cells.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])


def dedup_last(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Keep the row with the highest ``ordinal`` per ``key`` (last write wins, SET3).

    Written as ``max_by`` in a grouped aggregate rather than a
    ``row_number`` window: the aggregate is combined map-side, so a key that
    holds a third of all rows is reduced to one candidate per task before
    the shuffle instead of being sorted whole in one task. NULL keys form a
    group of their own, like any other value. A NULL ordinal comes before all
    others; of equal ordinals the greatest row stays, so the result is the same
    on every run.
    """
    others = [c for c in df.columns if c != key]
    unordered = (T.MapType, T.VariantType)
    row = [F.col(f.name) for f in df.schema.fields
           if f.name in others and not isinstance(f.dataType, unordered)]
    order = F.struct(F.col(ordinal).isNotNull(), F.col(ordinal), *row)
    picked = F.max_by(F.struct(*[F.col(c) for c in others]), order)
    return (df.groupBy(key).agg(picked.alias("_last"))
              .select(key, *[F.col(f"_last.{c}").alias(c) for c in others])
              .select(*df.columns))
