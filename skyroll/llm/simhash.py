"""Near-duplicates by SimHash, found with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Two fingerprints with at most
three different bits differ by at most one bit in one of them, so they agree in
that segment or in one of its variants with one bit left out. Every different
fingerprint is indexed under its segments and their one-wildcard variants;
fingerprints that meet in an equality join on such a signature are compared.

A signature that many fingerprints share (families of near copies agree in a
whole segment) is refined: its fingerprints are indexed again by variants of the
halves of their other segment, which also differ by at most one bit in one half,
and so on. After three rounds at most eight bits are free, so a signature has at
most 2,048 fingerprints. No group grows with the input, and no partner is left out.

What comes out of a group is a spanning forest of its links, at most one edge for
each member, never all its pairs; components of all edges are the result.

Defined cases: without words (null, empty, blank texts) the fingerprint is zero,
linked like any other; with fewer than three words the whole sequence is the one
shingle; a fingerprint of repeated rows or equal texts is compared once; a null
doc_id comes after every id, and is the component's id only where there is no
other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import attach, documents, saved, small_batches
from skyroll.llm.components import components

BITS = 64
DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
GROUP = 4096          # fingerprints of one signature that are compared at once
LAST_BITS = 8         # free bits below which a signature isn't refined
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text, as an unsigned number."""
    words = text.encode().lower().split() if text else []   # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    grams = list(zip(*[words[i:] for i in range(SHINGLE_WORDS)])) or [tuple(words)]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(grams), SHINGLES_AT_ONCE):
        hashes = b"".join([digest(b" ".join(g), SEED) for g in grams[at:at + SHINGLES_AT_ONCE]])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(mark, "doc_id long, fp long"))


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (key, fp, rest) indexed by the two halves of the ``width`` bits of
    ``fp`` from bit ``rest`` on: each half as it is and with each bit left out.

    The new key takes in the old one; ``side`` is the bit left out (null for a whole
    half) and ``rest`` where the other half begins. Keys are hashes: if two clash,
    their fingerprints are compared in vain, and nothing is lost."""
    half = width // 2
    variants = rows.select("key", "fp", "rest",
                           F.explode(F.sequence(F.lit(0), F.lit(2 * half + 1))).alias("v"))
    cut = variants.select(
        "key", "fp", "v", F.expr(f"v % {half + 1}").alias("p"),
        F.expr(f"rest + {half} * (v div {half + 1})").cast("int").alias("other"),
        F.expr(f"shiftrightunsigned(fp, CAST(rest + {half} * (1 - v div {half + 1}) AS INT))"
               f" & {(1 << half) - 1}L").alias("part"))
    masked = F.expr(f"CASE WHEN p < {half} THEN part & ~shiftleft(1L, p) ELSE part END")
    side = F.expr(f"CASE WHEN p < {half} THEN CAST(shiftright(part, p) & 1 AS INT) END")
    return cut.select(F.xxhash64("key", "v", masked).alias("key"), "fp",
                      F.col("other").alias("rest"), side.alias("side"))


def linked(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each row the first row of its linked part, among rows with equal keys
    (which stand together): row i is compared with i + 1, i + 2, ... of its group."""
    label = np.arange(len(keys))
    at, step = label[:-1], 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        while len(near):
            a, b = label[near], label[near + step]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label != label[label]).any():
                label = label[label]
        step += 1
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of rows (key, fp) sorted by key; groups may span batches."""
    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        first = linked(keys, fps)
        on = first != np.arange(len(first))
        return pa.RecordBatch.from_arrays(
            [pa.array(fps[first[on]].view(np.int64)), pa.array(fps[on].view(np.int64))],
            ["a", "b"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in batches:
        keys = np.concatenate([keys, b.column("key").to_numpy()])
        fps = np.concatenate([fps, b.column("fp").to_numpy().view(np.uint64)])
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield edges(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    yield edges(keys, fps)


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the fingerprints
    ``distinct`` (column fp, no two equal) with at most ``DISTANCE`` different bits."""
    rows = distinct.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("rest"))
    width, found = BITS, None
    while True:
        rows = signatures(rows, width)
        width //= 2
        shared = (rows.groupBy("key")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("low"),
                       F.max("side").alias("high"))
                  .where("n > 1 AND (low IS NULL OR low < high)").select("key", "n"))
        live = saved(rows.join(shared.hint("shuffle_hash"), "key"), f"signatures-{width}")
        small = live if width <= LAST_BITS else live.where(F.col("n") <= group)
        forest = (small.select("key", "fp").repartition(F.col("key"))
                  .sortWithinPartitions("key", "fp").mapInArrow(_forest, "a long, b long"))
        found = forest if found is None else found.unionByName(forest)
        if width <= LAST_BITS:
            return found
        rows = live.where(F.col("n") > group).select("key", "fp", "rest")
        if rows.isEmpty():
            return found


def simhash_components(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    marked = saved(fingerprints(docs), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first"),
                                              F.count(F.lit(1)).alias("copies")), "distinct")
    nodes = components(links(distinct, group))
    rooted = saved(distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "first", "copies", F.coalesce("component", "fp").alias("root")), "rooted")
    roots = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id"),
                                             F.count(F.lit(1)).alias("members")), "roots")
    of_fp = saved(attach(rooted.drop("first"), roots, ["root"], "members")
                  .select("fp", "copies", "component_id"), "component-of-fingerprint")
    return attach(marked, of_fp, ["fp"], "copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
