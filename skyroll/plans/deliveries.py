"""Raw deliveries that may come again (AGG1-AGG4, CMP3).

A batch run replaces its outputs, so a corrected file counts once. Here the same
holds when files are taken in one delivery at a time, without reading the others
again. A delivery is a folder of raw files; what it adds to the outputs, its
contribution, is an additive grain table (counts and sums) under its name. The
outputs are the merge of the newest contribution of every delivery, so a delivery
that comes again takes the place of its earlier one, and one that is gone adds
nothing.

``refresh`` compares the landed files (names, sizes, times: a listing, no content)
with what was taken in, and scans only the deliveries that differ. Each refresh
writes a snapshot of its own, with the contributions and the list of the deliveries
that it covers, and commits both at once. A refresh that fails leaves nothing that
readers see, and the next one does the same work again; of two at the same time the
second starts again from what the first took in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.operators.aggregates import (
    additive_grain_table, grains_from_additive, merge_additive,
)
from skyroll.operators.standardise import standardise, unify
from skyroll.plans.dashboard import Outputs, outputs_from_grains
from skyroll.schemas import source_specs
from skyroll.session import checkpointed
from skyroll.sinks.snapshots import Snapshots
from skyroll.sources.headers import FILE, REJECTED, read_raw_groups

SOURCE_COL = "source"
DELIVERY = "delivery"
# The folder that a file lies in.
FOLDER = r"([^/]+)/[^/]+$"
ID = [SOURCE_COL, DELIVERY]
# The two tables of a snapshot.
LIST, GRAINS = "deliveries", "contributions"


def landed_files(spark: SparkSession, landing: dict[str, str], pattern: str = FOLDER,
                 glob: str = "*.csv") -> DataFrame:
    """(source, delivery, path, stamp) of every landed file. Only the listing is read;
    the stamp changes with the file's name, size or time."""
    parts = []
    for label, path in landing.items():
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", glob).load(path))
        parts.append(files.select(
            F.lit(label).alias(SOURCE_COL), F.regexp_extract("path", pattern, 1).alias(DELIVERY),
            "path", F.xxhash64("path", "modificationTime", "length").alias("stamp")))
    return reduce(lambda a, b: a.unionByName(b), parts)


class Deliveries:
    """Contributions of all deliveries, under one folder."""

    def __init__(self, spark: SparkSession, root: str, pattern: str = FOLDER):
        self.spark, self.pattern = spark, pattern
        self.snapshots = Snapshots(spark, root)

    def known(self) -> DataFrame | None:
        """(source, delivery, stamp, version): the newest state of every delivery; a null
        stamp is one that is gone. One small row for each delivery and refresh."""
        lists = [self.spark.read.parquet(f"{folder}/{LIST}")
                 for folder in self.snapshots.committed().values()]
        if not lists:
            return None
        order = F.struct("version", "stamp")
        return (reduce(lambda a, b: a.unionByName(b), lists).groupBy(*ID)
                .agg(F.max_by(F.struct("stamp", "version"), order).alias("last"))
                .select(*ID, "last.*"))

    def changes(self, landing: dict[str, str]) -> DataFrame:
        """(source, delivery, stamp) of what is new, different or gone."""
        # xor does not depend on the order of a delivery's files
        now = (landed_files(self.spark, landing, self.pattern).groupBy(*ID)
               .agg(F.bit_xor("stamp").alias("stamp")))
        known = self.known()
        if known is None:
            return now
        was = known.select(*ID, F.col("stamp").alias("was"))
        return (now.join(was, ID, "full").where(~F.col("stamp").eqNullSafe(F.col("was")))
                .select(*ID, "stamp"))

    def refresh(self, landing: dict[str, str]) -> int | None:
        """Take in what has changed; the version written, or None if nothing has."""
        while True:
            version = self.snapshots.next_version()
            changed = checkpointed(self.changes(landing))
            if changed.isEmpty():
                return None
            folder = self.snapshots.new_folder()
            self._write(landing, changed, version, folder)
            if self.snapshots.commit(folder, version):
                return version
            self.snapshots.discard(folder)

    def _write(self, landing: dict[str, str], changed: DataFrame, version: int,
               folder: str) -> None:
        files = (landed_files(self.spark, landing, self.pattern)
                 .join(changed.where(F.col("stamp").isNotNull()), ID, "left_semi")
                 .select(SOURCE_COL, "path").collect())       # names, as any scan lists them
        parts = []
        for spec in source_specs(landing):
            own = [r.path for r in files if r[SOURCE_COL] == spec.label]
            if not own:
                continue
            raw = read_raw_groups(self.spark, own, spec, rejects=True)
            parts.append(standardise(raw.where(F.col(REJECTED).isNull()), spec, [FILE])
                         .withColumn(SOURCE_COL, F.lit(spec.label)))
        if parts:
            self.added(unify(parts)).write.parquet(f"{folder}/{GRAINS}")
        (changed.withColumn("version", F.lit(version)).coalesce(1)
         .write.parquet(f"{folder}/{LIST}"))

    def added(self, flights: DataFrame) -> DataFrame:
        """What each delivery adds. Rows are grouped by their file; its delivery is looked
        up in the few rows of every file, not in each flight."""
        by_file = additive_grain_table(flights, by=[SOURCE_COL, FILE])
        return merge_additive(by_file.withColumn(
            DELIVERY, F.regexp_extract(FILE, self.pattern, 1)).drop(FILE))

    def contributions(self) -> DataFrame | None:
        """The newest contribution of every delivery that is there."""
        known = self.known()
        if known is None:
            return None
        newest = [r.version for r in known.where(F.col("stamp").isNotNull())
                  .select("version").distinct().collect()]
        committed = self.snapshots.committed()
        parts = [self.spark.read.parquet(f"{committed[v]}/{GRAINS}").withColumn("version", F.lit(v))
                 for v in sorted(newest)]
        if not parts:
            return None
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        live = known.where(F.col("stamp").isNotNull()).select(*ID, "version")
        return rows.join(live, [*ID, "version"], "left_semi")

    def grains(self) -> DataFrame | None:
        """The grain table of all deliveries together."""
        rows = self.contributions()
        if rows is None:
            return None
        return grains_from_additive(merge_additive(rows.drop(*ID, "version")))

    def outputs(self) -> Outputs | None:
        grains = self.grains()
        return None if grains is None else outputs_from_grains(checkpointed(grains))
