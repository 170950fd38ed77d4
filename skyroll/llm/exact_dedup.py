"""Exact dedup over a persistent digest index (DataFrame and SQL only).

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
normalised text, one row per distinct text. A batch is reduced to one row per
digest, meets the index in a sort-merge anti-join (the index side needs no
shuffle, its buckets already are the join's partitions), and what is new is
appended with the same bucketing.

An index outlives its session: whoever opens the folder again, in whatever session,
goes on with its batches and its number of buckets, which a file beside the data
holds. A batch that failed on its way can be given again under the same number;
what it had appended already counts as its own.

Defined cases: a null text counts as empty, all empty texts are one group; a
null doc_id sorts after every id; rows that repeat a doc_id and a text are
separate rows of one group, of which exactly one is kept (the first in scan
order); an empty batch changes nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import saved
from skyroll.session import scratch_path

# The characters a text is compared without: space, and tab to carriage return.
IGNORED = " \t\n\x0b\x0c\r"

# A digest with more than one row in HOT_SHARE belongs to a hot group. There
# can be at most HOT_SHARE of them, whatever the input, so they may be
# broadcast; all others take the sort-merge join, where none is large.
HOT_SHARE = 1000

INDEX_COLUMNS = ["digest", "keep_id", "keep_row", "n_points"]


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_points, digest): all that later steps need of a text.

    ``row`` names a column of unique numbers; without it the scan gives them out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col("doc_id"),
        F.length(text).alias("n_points"),
        F.unhex(F.sha2(F.translate(text, IGNORED, "").cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of digests in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """Open the index in ``path`` or begin one there. ``buckets`` is for a new index
        (default: the shuffle partitions); an old one keeps its own, and refuses others."""
        self.spark = spark
        self.path = (path or scratch_path(spark, "digest-index")).rstrip("/")
        known = self._read_about()
        if known and buckets not in (None, known["buckets"]):
            raise ValueError(f"the index in {self.path} has {known['buckets']} buckets, not {buckets}")
        self.buckets = (known["buckets"] if known else buckets
                        or int(spark.conf.get("spark.sql.shuffle.partitions")))
        # the same folder has the same name in every session's catalog
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, "
            f"keep_row BIGINT, n_points INT, batch INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}'")
        if not known:
            self._write_about()
        spark.catalog.refreshTable(self.name)

    def _about(self):
        """The file that tells of the index; readers of the table pass over its name."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_about.json")
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at, jvm

    def _read_about(self) -> dict | None:
        fs, at, jvm = self._about()
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(jvm.java.io.BufferedReader(
                jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
        finally:
            stream.close()

    def _write_about(self) -> None:
        fs, at, _ = self._about()
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets}).encode()))
        out.close()

    def next_batch(self) -> int:
        """The number after the last batch that any session has appended."""
        return self.table().agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] + 1

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, docs: DataFrame, row: str | None = None,
               batch: int | None = None) -> DataFrame:
        """Append what is new in ``docs``; one decision per row of ``docs``.

        Returns doc_id, keep_id, group_size (rows of this batch with the same
        text), kept and text_sha256. Of equal texts in the batch the row with
        the most code points, then the smallest doc_id, stays; if an earlier
        batch holds the text, its row stays and none of this batch does.
        With ``row``, a column of unique numbers, the decisions have it too.

        ``batch`` numbers the batch (default: the next number). One that is given again
        with the same rows and numbers gets the decisions that it would have had, so a
        batch that may have to be repeated needs ``row`` and ``batch``.
        """
        rows = saved(digests(docs, row), "digests")
        batch = self.next_batch() if batch is None else batch
        groups = rows.groupBy("digest").agg(
            F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"),
                           F.col("doc_id").alias("c"), F.col("row").alias("d"))).alias("best"),
            F.count(F.lit(1)).alias("group_size"))
        groups = saved(groups, "digest-groups")
        first = groups.select("digest", F.col("best.c").alias("keep_id"),
                              F.col("best.d").alias("keep_row"),
                              (-F.col("best.a")).alias("n_points"),
                              F.lit(batch).alias("batch"))
        known = self.table().select("digest")
        fresh = first.join(known.hint("merge"), "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)
        index = self.table().select("digest", "keep_id", "keep_row", "batch")
        verdict = groups.select("digest", "group_size").join(index.hint("merge"), "digest")
        return self._decide(rows, saved(verdict, "digest-verdicts"), batch, row)

    @staticmethod
    def _decide(rows: DataFrame, verdict: DataFrame, batch: int,
                row: str | None = None) -> DataFrame:
        """Hand each row its group's verdict; hot groups never meet in one task."""
        total = rows.count()
        hot = verdict.where(F.col("group_size") * HOT_SHARE > total)
        cold = verdict.where(F.col("group_size") * HOT_SHARE <= total)
        is_hot = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        parts = rows.join(F.broadcast(hot), "digest").unionByName(
            is_hot.join(cold.hint("merge"), "digest"))
        return parts.select(
            "doc_id", "keep_id", "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            *([F.col("row").alias(row)] if row else []))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's verdict against a fresh index (one batch, all rows)."""
    from skyroll.llm.common import documents

    return DigestIndex(spark).ingest(documents(spark, sf_dir))


ORACLE_OP6 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
