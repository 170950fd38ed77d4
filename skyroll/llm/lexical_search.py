"""Ranked lexical search with each different bag of item words scored once.

Only words of the queries (items) can score, so a document is reduced to its bag:
the item words that it holds and how often, with the length measure m. Documents
with the same bag and m score alike for every item. They are one class, found by a
hash and verified by the bag itself; a class is scored once, and its members come
back in ascending doc_id where the class is among an item's best.

An item needs no more classes than documents: if as many classes come before a
class (by score, then by smallest doc_id), as many documents come before each of
its members. For the same reason no more members of a class are kept.

The items' words are sent to the tasks while there are at most ``VOCABULARY`` of
them; beyond that, documents and words meet in a join. Scoring takes the items in
blocks of about ``POSTINGS`` words. Both bounds choose a way and drop nothing.

Defined cases: a document without a term (null and empty texts too) counts neither
in N nor in L and is never found; an item without terms finds nothing; rows that
repeat an item_id, a doc_id or a text are ranked as rows of their own; null doc_ids
come after all others; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyroll.llm.common import documents, saved, small_batches

TOP = 20
VOCABULARY = 500_000     # words that are sent to every task
POSTINGS = 500_000       # (item, word) pairs scored in one pass
CELLS = 2_000_000        # scores and products that a task holds at a time

# Signs and blanks separate terms; A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else 0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
    else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order, repeats included."""
    return text.encode().translate(_FOLD).split() if text else []


def term_counts(rows: DataFrame, carried: list[str]) -> DataFrame:
    """(*carried, n, term, tf): a row per different term of each row's ``text``."""
    small_batches(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in rows.select(*carried).schema.fields)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
            kept = [b.column(c).take(pa.array(at)) for c in carried]
            sizes = np.array([x.total() for x in bags], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sizes[at]),
                 pa.array([t for x in bags for t in x], pa.string()),
                 pa.array([n for x in bags for n in x.values()], pa.int64())],
                [*carried, "n", "term", "tf"])

    return rows.select(*carried, "text").mapInArrow(split, f"{schema}, n long, term string, tf long")


def bags(docs: DataFrame, vocabulary: DataFrame, limit: int = VOCABULARY) -> DataFrame:
    """(row, doc_id, n, ids, tfs), saved, of every row with a term: its words among
    ``vocabulary`` (term, id), ascending by id, and their counts."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "row long, doc_id long, n long, ids array<long>, tfs array<long>"
    if vocabulary.count() > limit:
        counted = saved(term_counts(rows, ["row", "doc_id"]), "document-terms")
        found = (counted.join(vocabulary, "term").groupBy("row")
                 .agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("bag")))
        lengths = counted.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                             F.first("n").alias("n"))
        none = F.array().cast("array<long>")
        return saved(lengths.join(found, "row", "left").select(
            "row", "doc_id", "n", F.coalesce("bag.id", none).alias("ids"),
            F.coalesce("bag.tf", none).alias("tfs")), "bags")
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(
        {r.term.encode(): r.id for r in vocabulary.collect()})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value.get
        for b in batches:
            sizes, ids, tfs = [], [], []
            for text in b.column("text").to_pylist():
                words = terms(text)
                found = np.fromiter((i for i in map(of, words) if i is not None), np.int64)
                own, count = np.unique(found, return_counts=True)
                sizes.append(len(words))
                ids.append(own)
                tfs.append(count)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)

            def lists(parts):
                return pa.ListArray.from_arrays(
                    ends, np.concatenate(parts) if parts else np.empty(0, np.int64))

            out = pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(sizes, pa.int64()), lists(ids),
                 lists([t.astype(np.int64) for t in tfs])], ["row", "doc_id", "n", "ids", "tfs"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    return saved(rows.mapInArrow(reduce, shape), "bags")


def classes(bag_rows: DataFrame, top: int = TOP) -> DataFrame:
    """(class, member, row, doc_id, m, ids, tfs): rows of the same ``ids``, ``tfs`` and
    m, which the hash brings together and the values themselves verify. ``member``
    counts a class's rows by ascending doc_id, up to ``top``; the first names it."""
    same = Window.partitionBy("hash", "m", "ids", "tfs").orderBy(
        F.col("doc_id").asc_nulls_last(), "row")
    return (bag_rows.where(F.size("ids") > 0)
            .withColumn("hash", F.xxhash64("m", "ids", "tfs"))
            .withColumn("member", F.row_number().over(same)).where(F.col("member") <= top)
            .withColumn("class", F.first("row").over(same)).drop("hash", "n"))


class _Best:
    """The best classes of each item so far: score down, then doc_id up, null last."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, dtype=np.int64)
        self.rows = np.empty((0, 5), dtype=np.int64)   # item, -score, null id, doc_id, class

    def add(self, scores: np.ndarray, no_id: np.ndarray, doc: np.ndarray, cls: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least)
        if not len(at):
            return
        rows = np.concatenate([self.rows, np.stack(
            [item, -scores[at, item], no_id[at], doc[at], cls[at]], axis=1)])
        rows = rows[np.lexsort(rows.T[::-1])]
        starts = np.searchsorted(rows[:, 0], np.arange(self.items))
        place = np.arange(len(rows)) - starts[rows[:, 0]]
        self.rows = rows[place < self.top]
        last = rows[place == self.top - 1]
        self.least[last[:, 0]] = -last[:, 1]


def _scores(names: np.ndarray, words: np.ndarray, start: np.ndarray, item_of: np.ndarray,
            weight: np.ndarray, top: int):
    """A mapInArrow function from classes to each task's best of every item. Word k
    stands at start[k]:start[k + 1] of (item_of, weight); names[item_of] is the item."""
    items = len(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(items, top)
        for b in batches:
            sizes = np.diff(b.column("ids").offsets.to_numpy())
            ids = b.column("ids").flatten().to_numpy()
            tf = b.column("tfs").flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            m = b.column("m").to_numpy()
            place = np.minimum(np.searchsorted(words, ids), len(words) - 1)
            here = words[place] == ids
            place, tf, row = place[here], tf[here], row[here]
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            fan = start[place + 1] - start[place]
            doc = b.column("doc_id")
            no_id = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, cls = doc.fill_null(0).to_numpy(), b.column("class").to_numpy()
            # as many rows at a time as products and scores have room
            load = np.bincount(row, weights=fan, minlength=len(sizes)) + items
            chunk = (np.cumsum(load) // CELLS).astype(np.int64)
            for c in np.unique(chunk):
                low, high = np.searchsorted(chunk, [c, c + 1])
                own = slice(*np.searchsorted(row, [low, high]))
                many = fan[own]
                ends = np.cumsum(many)
                at = np.arange(ends[-1] if len(ends) else 0)
                at = at + np.repeat(start[place[own]] - (ends - many), many)
                table = np.zeros((high - low) * items, dtype=np.int64)
                np.add.at(table, np.repeat(row[own] - low, many) * items + item_of[at],
                          weight[at] * np.repeat(part[own], many))
                best.add(table.reshape(-1, items), no_id[low:high], doc[low:high], cls[low:high])
        r = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[r[:, 0]]), pa.array(-r[:, 1]),
             pa.array(r[:, 3], mask=r[:, 2] == 1), pa.array(r[:, 4])],
            ["item", "score", "doc_id", "class"])
    return score


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, vocabulary: int = VOCABULARY,
           postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents of each item."""
    spark = docs.sparkSession
    asked = saved(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"),
                  "items")
    wanted = saved(term_counts(asked, ["item", "item_id"]), "item-terms")
    words = saved(wanted.select("term").distinct()
                  .withColumn("id", F.monotonically_increasing_id()), "item-vocabulary")
    found = bags(docs, words, vocabulary)
    count, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shape = "item long, item_id " + asked.schema["item_id"].dataType.simpleString() + \
            ", rank int, doc_id long, score long"
    if not count:
        return spark.createDataFrame([], shape).drop("item")
    df = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * count + 2)) / (2 * F.col("df") + 1)))
    index = saved(wanted.join(words, "term").join(df, "id").select(
        "item", "item_id", "id", (F.col("tf") * weight).cast("long").alias("weight")), "item-index")
    grouped = saved(classes(found.withColumn(
        "m", F.expr(f"75 + (25 * n * {count}L) div {length}L")), top), "classes")
    heads = grouped.where("member = 1").select("class", "doc_id", "m", "ids", "tfs")
    blocks = -(-index.count() // postings)
    best = None
    for k in range(blocks):
        own = index.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("id", "item")
        rows = own.select("item", "id", "weight").toPandas()
        if not len(rows):
            continue
        names, place = np.unique(rows["item"].to_numpy(), return_inverse=True)
        ids, start = np.unique(rows["id"].to_numpy(), return_index=True)
        part = heads.mapInArrow(
            _scores(names, ids, np.append(start, len(rows)), place, rows["weight"].to_numpy(), top),
            "item long, score long, doc_id long, class long")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], shape).drop("item")
    of_item = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(),
                                                 "class")
    first = saved(best.withColumn("place", F.row_number().over(of_item))
                  .where(F.col("place") <= top).select("item", "score", "class"), "best-classes")
    rows = first.join(grouped.select("class", "doc_id", "row"), "class")
    by_doc = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(),
                                                "row")
    return (rows.withColumn("rank", F.row_number().over(by_doc)).where(F.col("rank") <= top)
            .join(asked.select("item", "item_id"), "item")
            .select("item_id", "rank", "doc_id", "score"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
asked AS (SELECT item, item_id, term, count(*) AS qtf
  FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
weight AS MATERIALIZED (SELECT term,
    CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term),
part AS MATERIALIZED (SELECT row, doc_id, term,
    (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)) AS x FROM tf, totals),
scored AS (SELECT item, item_id, row, doc_id, CAST(sum(qtf * w * x) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN part USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item
  ORDER BY score DESC, doc_id ASC NULLS LAST, row) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
