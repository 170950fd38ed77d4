"""Registered queries over raw input as it really lands: files with other headers,
broken lines, deliveries that come again, holiday files that can't be read.

The files are written from the driver's tables into the shared scratch folder, with
the faults planted by a fixed rule; the SQL states the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.operators import aggregates as agg
from skyroll.operators.standardise import flights_from_sources
from skyroll.plans.deliveries import ID, Deliveries
from skyroll.plans.holidays import load_holidays
from skyroll.plans.landing import land
from skyroll.plans.run import run
from skyroll.schemas import source_specs
from skyroll.session import scratch_path
from skyroll.sinks.keyed import KEY, KeyedStore
from skyroll.sources import holidays as hol
from skyroll.sources.fixture import fixture_sources
from skyroll.sources.headers import read_raw_groups

# Rules of the planted faults, shared with the SQL.
SHORT, LONG, FAULT_CYCLE = 3, 5, 40       # remainders of the distance
CORRECTED_YEARS = ["2016", "2019"]
POSITIONS_PER_FILE = 5000
BROKEN_FILE, OBJECT_FILE, FILE_CYCLE = 4, 7, 9   # remainders of 31 * year + part
DATELESS = 13                              # positions divisible by it have no date


def _specs():
    return {s.label: s for s in source_specs()}


def _mixed_headers(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Each layout as one folder of files with three headers, dealt out by the day."""
    root, landing, specs = scratch_path(spark, "mixed"), {}, _specs()
    for label, raw in fixture_sources(spark, sf_dir).items():
        cols, day = specs[label].source_columns, specs[label].source_columns[2]
        landing[label] = f"{root}/{label}"
        layouts = [
            [F.col(c) for c in cols],
            [F.lit("N1").alias("TAIL_MARK"), *[F.col(c) for c in reversed(cols)]],
            [*[F.col(c).alias(c.lower()) for c in cols[5:]], F.lit("7").alias("TAXI_MARK"),
             F.lit("a, \"b\"").alias("tail_mark"), *[F.col(c) for c in cols[:5]]],
        ]
        for k, columns in enumerate(layouts):
            (raw.where(F.col(day).cast("int") % 3 == k).select(*columns)
             .write.option("header", "true").csv(f"{landing[label]}/batch-{k}"))
    return landing


def _read_mixed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    landing = _mixed_headers(spark, sf_dir)
    return {label: read_raw_groups(spark, path, _specs()[label])
            for label, path in landing.items()}


def mixed_headers_by_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.by_airline(flights_from_sources(_read_mixed(spark, sf_dir)))


def mixed_headers_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the layout doesn't map: NULL where a file lacks it."""
    parts = [raw.groupBy(F.lit(label).alias("source"), "TAIL_MARK", "TAXI_MARK")
             .agg(F.count(F.lit(1)).alias("rows"))
             for label, raw in _read_mixed(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def _faulty_lines(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Each layout as CSV files in folders by year; lines whose distance has one of two
    remainders lack their last two fields or have two more."""
    root, landing, specs = scratch_path(spark, "faulty"), {}, _specs()
    for label, raw in fixture_sources(spark, sf_dir).items():
        cols = specs[label].source_columns
        rest = F.col(cols[-1]).cast("int") % FAULT_CYCLE
        fields = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cols])
        fields = (F.when(rest == SHORT, F.slice(fields, 1, len(cols) - 2))
                  .when(rest == LONG, F.concat(fields, F.array(F.lit("x"), F.lit("y"))))
                  .otherwise(fields))
        landing[label] = f"{root}/{label}"
        # one column named by the header: its values are written as lines
        (raw.select(F.array_join(fields, ",").alias(",".join(cols)),
                    F.col(cols[0]).alias("ship_year"))
         .write.partitionBy("ship_year").option("header", "true").option("sep", "\u0001")
         .csv(landing[label]))
    return landing


def _landed(spark: SparkSession, sf_dir: str):
    year: Column = F.regexp_extract("file", r"ship_year=([^/]+)/", 1)
    return land(spark, _faulty_lines(spark, sf_dir), scratch_path(spark, "fact"), year)


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir).counts


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reject channel: whole lines, by the number of their fields."""
    return (_landed(spark, sf_dir).rejects
            .groupBy("source", F.size(F.split("line", ",")).alias("fields"))
            .agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first_line")))


def landed_by_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.by_airline(_landed(spark, sf_dir).flights)


def landed_observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics observed while the fact was written: no scan of their own."""
    totals = _landed(spark, sf_dir).totals
    names = ["rows_in", "rows_ok", "rows_rejected", "null_airline_rows"]
    return spark.createDataFrame([tuple(totals[n] for n in names)],
                                 ", ".join(f"{n} long" for n in names))


def run_observed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and carrier-less rows of each source, observed while the run's one scan is
    read; nothing is counted in a job of its own."""
    done = run(spark, fixture_sources(spark, sf_dir), scratch_path(spark, "run"))
    return spark.createDataFrame(
        [(label, o["raw_rows"], o["null_airline_rows"]) for label, o in done.observed.items()],
        "source string, raw_rows long, null_airline_rows long")


def _redelivered(spark: SparkSession, sf_dir: str) -> Deliveries:
    """All years land, two of them wrong (half their rows twice, departure delays five
    minutes up); then those two land again, corrected."""
    root, specs, landing = scratch_path(spark, "delivered"), _specs(), {}
    raw = fixture_sources(spark, sf_dir)

    def put(label: str, df: DataFrame) -> None:
        landing[label] = f"{root}/{label}"
        (df.withColumn("delivery", F.col(specs[label].source_columns[0]))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("delivery").option("header", "true").csv(landing[label]))

    for label, df in raw.items():
        cols = specs[label].source_columns
        wrong = F.col(cols[0]).isin(CORRECTED_YEARS)
        late = F.when(wrong, (F.col(cols[8]).cast("int") + 5).cast("string")).otherwise(F.col(cols[8]))
        twice = F.when(wrong & (F.col(cols[2]).cast("int") % 2 == 0), 2).otherwise(1)
        put(label, df.withColumn("copy", F.explode(F.array_repeat(F.lit(0), twice))).drop("copy")
            .withColumn(cols[8], late))
    deliveries = Deliveries(spark, f"{root}/state")
    deliveries.refresh(landing)
    for label, df in raw.items():
        put(label, df.where(F.col(specs[label].source_columns[0]).isin(CORRECTED_YEARS)))
    deliveries.refresh(landing)
    return deliveries


def redelivered_by_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redelivered(spark, sf_dir).outputs().airlines


def redelivered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each delivery adds, and the refresh that took it in."""
    rows = _redelivered(spark, sf_dir).contributions().where("grain = 'all'")
    return rows.select(*ID, F.col("version").cast("int").alias("version"), F.col("n").alias("rows"))


def _holiday_files(spark: SparkSession, sf_dir: str) -> str:
    """Array files by year and range of positions; some cut off, some not a list."""
    payload = hol.holiday_payloads(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    payload = payload.withColumn("date", F.when(F.col("position") % DATELESS != 0, F.col("date")))
    texts = hol.holiday_array_texts(payload, POSITIONS_PER_FILE)
    rest = (31 * F.col("year") + F.col("part")) % FILE_CYCLE
    value = (F.when(rest == BROKEN_FILE, F.expr("left(value, length(value) div 2)"))
             .when(rest == OBJECT_FILE, F.lit('{"message": "not found"}')).otherwise(F.col("value")))
    root = scratch_path(spark, "holiday-arrays")
    hol.write_holiday_arrays(texts.withColumn("value", value), root)
    return root


def holiday_years_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = hol.holiday_files(spark, _holiday_files(spark, sf_dir), **hol.ARRAY_FILES)
    return hol.holiday_status(files)


def holiday_years_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hol.read_holiday_arrays(spark, _holiday_files(spark, sf_dir), on_error="skip",
                                   **hol.ARRAY_FILES)
    return hol.normalise_holidays(rows).drop("_order")


def holiday_years_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "holiday-load")
    store = KeyedStore(spark, f"{root}/store", "flight_holidays")
    load_holidays(spark, _holiday_files(spark, sf_dir), store, f"{root}/archive",
                  **hol.ARRAY_FILES)
    return store.read().drop(KEY)


QUERIES = {
    "mixed_headers_by_airline": mixed_headers_by_airline,
    "mixed_headers_extras": mixed_headers_extras,
    "rejected_rows": rejected_rows,
    "rejected_lines": rejected_lines,
    "landed_by_airline": landed_by_airline,
    "landed_observed_totals": landed_observed_totals,
    "run_observed_profile": run_observed_profile,
    "redelivered_by_airline": redelivered_by_airline,
    "redelivered_versions": redelivered_versions,
    "holiday_years_status": holiday_years_status,
    "holiday_years_read": holiday_years_read,
    "holiday_years_loaded": holiday_years_loaded,
}
