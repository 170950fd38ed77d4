"""Holiday payloads (SRC4), their yearly archive (SNK3), normalisation
(PRJ7), the date-keyed store (SET3) and the listing by date (SRC7).

Two readers:

* ``read_holiday_arrays``: the public-holiday API format, one JSON array per
  year in a file named after the year. Each file is read whole (``wholetext``)
  and exploded with ``posexplode`` so the array position - which decides
  "last wins" on a repeated date - is kept. One year's array is a few dozen
  holidays, so a file per task is fine for this format. ``holiday_files``
  reads the same format leniently: a status per file, good files go on.
* ``read_holiday_archive``: the archive this package writes, JSON lines
  partitioned by ``year`` (splittable, any size), carrying the position.

``holiday_payloads`` derives payload rows from ``orders`` (FIXTURES.md, F8)
so the path runs on the driver's tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyroll.operators.setops import dedup_last

PAYLOAD_FIELDS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("localName", T.StringType()),
    T.StructField("fixed", T.BooleanType()),
    T.StructField("global", T.BooleanType()),
    T.StructField("types", T.ArrayType(T.StringType())),
])
# Payload row: request year, position in that year's array, then the fields.
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("position", T.LongType()),
    *PAYLOAD_FIELDS.fields,
])


def holiday_payloads(orders: DataFrame) -> DataFrame:
    """One payload row per order (F8): the holiday date is the order date 20
    years on, positions follow the order key within the year; names, flags
    and types are sometimes missing so the defaults are exercised."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      F.col("o_orderdate").cast("date").alias("d"), "o_orderpriority")
    year = (F.year("d") + 20).cast("int")
    cust = F.col("o_custkey")
    return o.select(
        year.alias("year"),
        F.col("o_orderkey").cast("bigint").alias("position"),
        F.format_string("%04d-%02d-%02d", year, F.month("d"), F.dayofmonth("d")).alias("date"),
        F.when(cust % 10 != 0,
               F.concat(F.lit("Day "), (cust % 50).cast("string"))).alias("name"),
        F.when(cust % 15 != 0, F.col("o_orderpriority")).alias("localName"),
        F.when(cust % 11 != 0, F.col("o_orderstatus") == "F").alias("fixed"),
        F.when(cust % 7 != 0, F.col("o_totalprice") > 150000).alias("global"),
        F.when(cust % 3 != 0,
               F.array(F.lit("Public"), F.col("o_orderpriority"))).alias("types"),
    )


YEAR_IN_NAME = r"(\d{4})[^/]*$"
# A later file of a year comes after all positions of an earlier one.
PART_BITS = 32


def holiday_array_texts(payload: DataFrame, per_file: int) -> DataFrame:
    """(year, part, value): payload rows as the texts of array files, records in order.
    A part holds the positions of one range of ``per_file``, so no text outgrows it."""
    fields = [f.name for f in PAYLOAD_FIELDS.fields]
    run = F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("h"))))
    return (payload.withColumn("part", F.expr(f"position div {per_file}"))
            .groupBy("year", "part").agg(run.alias("run"))
            .select("year", "part", F.to_json(F.col("run.h")).alias("value")))


def write_holiday_arrays(texts: DataFrame, root: str) -> None:
    """One JSON array per file, ``year=<year>/part=<part>/`` under ``root`` (SNK3 in
    the format of the API)."""
    texts.write.partitionBy("year", "part").text(root)


ARRAY_FILES = {"year_pattern": r"/year=(\d{4})/", "part_pattern": r"/part=(\d+)/"}


def holiday_files(spark: SparkSession, path: str, year_pattern: str = YEAR_IN_NAME,
                  part_pattern: str | None = None) -> DataFrame:
    """(year, part, status, items) of every payload file, whatever its content; year
    and part come from its path. ``items`` are the records, as VARIANT, of a file
    whose ``status`` is 'ok'; other files are 'unreadable' (no JSON), 'not a list' or
    have 'no year'. Each file is parsed on its own, so a broken one spoils no other."""
    file = F.col("_metadata.file_path")
    year = F.regexp_extract(file, year_pattern, 1).try_cast("int")
    part = F.regexp_extract(file, part_pattern, 1).try_cast("long") if part_pattern else F.lit(0)
    parsed = (spark.read.option("wholetext", "true").text(path)
              .select(year.alias("year"), F.coalesce(part, F.lit(0)).cast("long").alias("part"),
                      F.try_parse_json("value").alias("v"))
              .select("year", "part", F.col("v").isNull().alias("broken"),
                      F.try_variant_get("v", "$", "array<variant>").alias("items")))
    status = (F.when(F.col("broken"), "unreadable").when(F.col("items").isNull(), "not a list")
              .when(F.col("year").isNull(), "no year").otherwise("ok"))
    return parsed.select("year", "part", status.alias("status"),
                         F.when(status == "ok", F.col("items")).alias("items"))


def _record(h: str) -> dict[str, Column]:
    return {f.name: F.try_variant_get(h, f"$.{f.name}", f.dataType.simpleString())
            for f in PAYLOAD_FIELDS.fields}


def _usable(date: Column) -> Column:
    """A record needs a date with a month and a day in it; others can't be stored."""
    parts = F.split(date, "-")
    month, day = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (2, 3))
    return month.isNotNull() & day.isNotNull()


def holiday_rows(files: DataFrame) -> DataFrame:
    """Payload rows of the files that are 'ok', without records that lack a date. A
    field of another type than it should have is NULL, like one that is missing."""
    exploded = files.where(F.col("status") == "ok").select(
        "year", "part", F.posexplode("items").alias("at", "h"))
    rows = exploded.select("year", (F.shiftleft("part", PART_BITS) + F.col("at")).alias("position"),
                           *[c.alias(name) for name, c in _record("h").items()])
    return rows.where(_usable(F.col("date")))


def holiday_status(files: DataFrame) -> DataFrame:
    """(year, part, status, records, kept, rejected) of every file."""
    usable = F.filter("items", lambda h: _usable(F.try_variant_get(h, "$.date", "string")))
    records = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    kept = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size(usable)).cast("long")
    return files.select("year", "part", "status", records.alias("records"), kept.alias("kept"),
                        (records - kept).alias("rejected"))


def read_holiday_arrays(spark: SparkSession, path: str, on_error: str = "fail",
                        year_pattern: str = YEAR_IN_NAME,
                        part_pattern: str | None = None) -> DataFrame:
    """API payload files, each one JSON array, the year in its path (``<year>.json``).

    ``on_error='fail'``: a malformed file fails the read instead of losing its year.
    ``on_error='skip'``: files that can't be read are left out, each on its own, and
    the others go on; ``holiday_status`` says which."""
    if on_error == "skip":
        return holiday_rows(holiday_files(spark, path, year_pattern, part_pattern))
    if on_error != "fail":
        raise ValueError(f"on_error is 'fail' or 'skip', not {on_error!r}")
    file = F.col("_metadata.file_path")
    part = F.regexp_extract(file, part_pattern, 1).cast("long") if part_pattern else F.lit(0)
    files = spark.read.option("wholetext", "true").text(path)
    parsed = files.select(F.regexp_extract(file, year_pattern, 1).cast("int").alias("year"),
                          part.cast("long").alias("part"),
                          F.from_json("value", T.ArrayType(PAYLOAD_FIELDS),
                                      {"mode": "FAILFAST"}).alias("items"))
    exploded = parsed.select("year", "part", F.posexplode("items").alias("at", "h"))
    return exploded.select("year", (F.shiftleft("part", PART_BITS) + F.col("at")).alias("position"),
                           *[F.col(f"h.{f.name}").alias(f.name) for f in PAYLOAD_FIELDS.fields])


def archive_holidays(payload: DataFrame, root: str) -> None:
    """Raw payload by year; re-archiving a year replaces only that year (SNK3)."""
    (payload.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .json(root))


def read_holiday_archive(spark: SparkSession, root: str) -> DataFrame:
    df = spark.read.schema(PAYLOAD_SCHEMA).json(root)
    return df.select(*[f.name for f in PAYLOAD_SCHEMA.fields])


def normalise_holidays(payload: DataFrame) -> DataFrame:
    """Store records (PRJ7): text defaults to '', flags to false, types to
    an empty list; month and day come from the ISO date, year is the
    request year."""
    parts = F.split(F.col("date"), "-")
    return payload.select(
        "date",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("localName", F.lit("")).alias("localName"),
        F.col("year").cast("int").alias("year"),
        F.try_element_at(parts, F.lit(2)).try_cast("int").alias("month"),
        F.try_element_at(parts, F.lit(3)).try_cast("int").alias("day"),
        F.coalesce("fixed", F.lit(False)).alias("fixed"),
        F.coalesce("global", F.lit(False)).alias("global"),
        F.coalesce("types", F.array().cast("array<string>")).alias("types"),
        F.struct("year", "position").alias("_order"),
    )


def holiday_store(payload: DataFrame) -> DataFrame:
    """Date-keyed holidays: the last record written for a date wins (years
    in order, then array position), via a map-side-combined ``max_by``."""
    return dedup_last(normalise_holidays(payload), "date", "_order").drop("_order")


def holidays_by_date(store: DataFrame) -> DataFrame:
    """Listing ordered by date, a missing date sorting as '' (SRC7)."""
    return store.orderBy(F.coalesce(F.col("date"), F.lit("")))
