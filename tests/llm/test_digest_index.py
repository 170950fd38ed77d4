"""The digest index across sessions, failures and batches."""

import pytest
from pyspark.sql import functions as F

from llm_cases import frame
from skyroll.llm import exact_dedup
from skyroll.llm.exact_dedup import DigestIndex


def keys(df):
    return sorted((r.doc_id, r.keep_id, r.kept) for r in df.collect())


def forget(index):
    """As in a new session, whose catalog doesn't know the table; its files stay."""
    index.spark.sql(f"DROP TABLE {index.name}")


FIRST = [(1, "a b"), (2, "ab"), (3, "c"), (4, None)]
NEXT = [(5, "c"), (6, "d"), (7, " d"), (8, "")]


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "index")


def test_an_index_goes_on_in_another_session(spark, path):
    index = DigestIndex(spark, path, buckets=3)
    assert keys(index.ingest(frame(spark, FIRST))) == [(1, 1, True), (2, 1, False), (3, 3, True),
                                                       (4, 4, True)]
    forget(index)
    again = DigestIndex(spark.newSession(), path)
    assert again.buckets == 3 and again.next_batch() == 2
    # nothing is kept twice
    assert keys(again.ingest(frame(again.spark, FIRST))) == [
        (1, 1, False), (2, 1, False), (3, 3, False), (4, 4, False)]
    assert keys(again.ingest(frame(again.spark, NEXT))) == [
        (5, 3, False), (6, 7, False), (7, 7, True), (8, 4, False)]
    assert again.table().count() == 4


def test_another_bucket_count_is_refused(spark, path):
    forget(DigestIndex(spark, path, buckets=3))
    with pytest.raises(ValueError, match="3 buckets"):
        DigestIndex(spark, path, buckets=4)
    assert DigestIndex(spark, path, buckets=3).buckets == 3


def test_a_batch_that_failed_after_its_append(spark, path, monkeypatch):
    docs = frame(spark, FIRST).coalesce(1).withColumn("line", F.monotonically_increasing_id())
    index = DigestIndex(spark, path, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(DigestIndex, "_decide", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.ingest(docs, "line", batch=1)
    forget(index)
    again = DigestIndex(spark, path)
    want = [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert keys(again.ingest(docs, "line", batch=1)) == want
    assert keys(again.ingest(docs, "line", batch=1)) == want
    assert again.table().count() == 3
    assert not any(r.kept for r in again.ingest(docs, "line", batch=2).collect())


def test_a_batch_that_had_appended_a_part(spark, path):
    docs = frame(spark, FIRST).coalesce(1).withColumn("line", F.monotonically_increasing_id())
    index = DigestIndex(spark, path, buckets=2)
    index.ingest(docs.where("doc_id = 3"), "line", batch=1)
    assert keys(index.ingest(docs, "line", batch=1)) == [(1, 1, True), (2, 1, False), (3, 3, True),
                                                         (4, 4, True)]


def test_an_empty_batch_changes_nothing(spark, path, none):
    index = DigestIndex(spark, path, buckets=2)
    assert index.ingest(none).collect() == [] and index.next_batch() == 1


def test_the_index_side_needs_no_shuffle(spark, path):
    index = DigestIndex(spark, path, buckets=4)
    index.ingest(frame(spark, FIRST))
    known = index.table().select("digest")
    batch = exact_dedup.digests(frame(spark, NEXT))
    plan = batch.join(known.hint("merge"), "digest", "left_anti")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1
