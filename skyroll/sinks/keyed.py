"""Keyed store with upsert semantics (SNK2, SNK4, SRC5, PRJ5, PRJ6, FLT2).

A keyed table is a series of immutable parquet snapshots. An upsert reads the
current snapshot, replaces the items whose key appears in the batch and keeps all
others (items are never deleted, so e.g. an airport that left the top 50 stays),
then commits the result as the next snapshot. A failed or half-written run is
invisible and a path is never overwritten while it is being read. Of two upserts
at the same time the one that commits second merges again with the other's
snapshot (``sinks.snapshots``). Retried tasks after an executor loss simply rewrite
their files inside the uncommitted folder.

The merge is a ``left_anti`` join on ``item_key`` plus a union, planned by
Catalyst: keys are unique on both sides (the batch is deduplicated first),
so there is no key skew, and AQE turns the join into a broadcast at run
time only when the measured batch side is small.

Snapshots are sorted by key over range partitions, so a page of keys is found by
the statistics of files and row groups without reading the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.functions.decimals import decimalise_columns
from skyroll.functions.keys import key_for
from skyroll.operators.checks import drop_null_keys
from skyroll.operators.setops import dedup_last
from skyroll.session import checkpointed
from skyroll.sinks.snapshots import Snapshots

KEY = "item_key"
PAGE = 1000


def keyed_items(df: DataFrame, key_rule: str) -> DataFrame:
    """``item_key`` first, then every column with floats as DECIMAL(38,6);
    rows whose key is NULL are dropped (PRJ5, PRJ6, FLT2)."""
    items = df.select(key_for(key_rule).alias(KEY), *decimalise_columns(df))
    return drop_null_keys(items, KEY)


_SEEN = "_seen_at"


def merge_items(current: DataFrame | None, batch: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Upsert ``batch`` into ``current``: last write wins per key (SET3). Without an
    ``ordinal`` column the batch's own row order says which write of a key is last."""
    batch = drop_null_keys(batch, KEY)
    if ordinal is None:
        batch, ordinal = batch.withColumn(_SEEN, F.monotonically_increasing_id()), _SEEN
    batch = dedup_last(batch, KEY, ordinal).drop(ordinal)
    if current is None:
        return batch
    kept = current.join(batch.select(KEY), on=KEY, how="left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


class KeyedStore:
    """One keyed table stored as committed parquet snapshots."""

    def __init__(self, spark: SparkSession, root: str, table: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{table}"
        self.snapshots = Snapshots(spark, self.path)

    def current_version(self) -> int | None:
        return max(self.snapshots.committed(), default=None)

    def read(self) -> DataFrame | None:
        """Full scan of the current snapshot (SRC5); None when nothing is committed."""
        committed = self.snapshots.committed()
        return self.spark.read.parquet(committed[max(committed)]) if committed else None

    def page(self, after: str | None = None, size: int = PAGE) -> DataFrame | None:
        """The next ``size`` items after key ``after`` in key order (SRC5). The bound is
        a pushed filter, and the cut a bounded heap per task."""
        items = self.read()
        if items is None:
            return None
        if after is not None:
            items = items.where(F.col(KEY) > after)
        return items.orderBy(KEY).limit(size)

    def pages(self, size: int = PAGE) -> Iterator[DataFrame]:
        """All items of one snapshot, page by page; only each page's last key comes to
        the driver. Upserts meanwhile go to later snapshots and are not seen."""
        items, after = self.read(), None
        while items is not None:
            rest = items if after is None else items.where(F.col(KEY) > after)
            page = checkpointed(rest.orderBy(KEY).limit(size))
            after = page.agg(F.max(KEY)).first()[0]
            if after is None:
                return
            yield page

    def upsert(self, batch: DataFrame, ordinal: str | None = None) -> int:
        """Merge ``batch`` into the store and commit it as a new snapshot; if another
        upsert commits meanwhile, merge again with what it committed."""
        while True:
            version = self.snapshots.next_version()
            merged = merge_items(self.read(), batch, ordinal)
            folder = self.snapshots.new_folder()
            (merged.repartitionByRange(F.col(KEY)).sortWithinPartitions(KEY)
             .write.mode("errorifexists").parquet(folder))
            if self.snapshots.commit(folder, version):
                return version
            self.snapshots.discard(folder)


def written_count(batch: DataFrame) -> DataFrame:
    """Items a batch writes: rows with a non-NULL key (the replay count)."""
    return drop_null_keys(batch, KEY).agg(F.count(F.lit(1)).alias("written"))
