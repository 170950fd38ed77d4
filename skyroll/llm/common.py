"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.session import scratch_path

# Rows of one Arrow batch handed to a Python task. Texts run to more than
# 100 kB, so a batch of the default 10,000 rows could exceed a worker.
ARROW_ROWS = 1000
TEXT_BYTES = 2 << 20     # of texts that a task works on at a time


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of text that a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of ``text``, or of
    one row: what a task computes for the texts of a slice is bounded by that."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(
            zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            before = size[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield b.slice(a, z - a)
            a = z


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage
    ends there, so a lost executor re-reads files instead of repeating work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def done_with(spark: SparkSession, *tables: DataFrame) -> None:
    """Give back the disk of ``saved`` tables whose last reader has run, and of the
    shuffles of finished jobs: Spark removes those once its driver has collected the
    plans that made them, which it would otherwise do every half hour."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    for table in tables:
        at = jvm.org.apache.hadoop.fs.Path(table.saved_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text modulo ``k``: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def labelled_sample(docs: DataFrame, labels_df: DataFrame, label: str, fold: int,
                    per_class: int) -> DataFrame:
    """(text, label) of at most ``per_class`` training rows for each label value.

    Training rows are those whose fold remainder is not 0. They are taken in
    the order of a hash of doc_id, so the sample is the same on every run.
    Ids and labels (at most ``2 * per_class`` rows, which bounds the broadcast)
    meet the documents in the scan; no text is shuffled.
    """
    train = (labels_df.select("doc_id", F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
             .where(id_remainder(F.col("doc_id"), fold) != 0))
    picked = None
    for value in (0, 1):
        part = (train.where(F.col("label") == value)
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
        picked = part if picked is None else picked.unionAll(part)
    return (docs.select("doc_id", "text")
            .join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id")
            .select("text", "label"))


# A group with more than one row in HOT_SHARE is hot. There can be at most
# HOT_SHARE hot groups, whatever the input, so these may be broadcast.
HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per group (``size``: its rows), both
    saved tables. Rows of hot groups never meet in one task: they take a
    broadcast join, the others, of which no key is large, a sort-merge join."""
    total = rows.count()
    is_hot = F.col(size) * HOT_SHARE > total
    hot = groups.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(
        cold.join(groups.where(~is_hot).hint("merge"), keys))
