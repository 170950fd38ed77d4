"""Holiday load with each year on its own (SRC4, SNK3, PRJ7, SET3, CMP3).

A payload that can't be read costs its file and no other: the good files are
archived, normalised and stored, and every file has a row that says what became
of it. A failing archive is reported and does not stop the store.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.session import scratch_path
from skyroll.sinks.keyed import KEY, KeyedStore
from skyroll.sources.holidays import (
    archive_holidays, holiday_files, holiday_rows, holiday_status, holiday_store,
)

log = logging.getLogger("skyroll.holidays")


@dataclass
class HolidayLoad:
    """``status`` has a row per file; ``archive_error`` is None if all was archived;
    ``store_version`` is None if there was nothing to store."""

    status: DataFrame
    archive_error: str | None
    store_version: int | None


def load_holidays(spark: SparkSession, path: str, store: KeyedStore,
                  archive_root: str | None = None, **patterns: str) -> HolidayLoad:
    """Read, archive and store the payload files under ``path``. The files are parsed
    once; what was parsed is written to the shared folder and serves all three."""
    folder = scratch_path(spark, "holiday-files")
    holiday_files(spark, path, **patterns).write.parquet(folder)
    files = spark.read.parquet(folder)
    rows, error = holiday_rows(files), None
    if archive_root:
        try:
            archive_holidays(rows, archive_root)
        except Exception as exc:  # noqa: BLE001 - the original only warns here
            error = str(exc)
            log.warning("holiday archive failed: %s", error)
    version = None
    if not rows.isEmpty():
        items = holiday_store(rows)
        version = store.upsert(items.select(F.col("date").alias(KEY), "*"))
    return HolidayLoad(holiday_status(files), error, version)
