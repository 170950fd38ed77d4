"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Only lengths are packed: a map-only pass tokenises every whole text, cuts
documents longer than a sequence into full pieces and a rest, and keeps a short
row per piece. Full pieces are sequences of their own. The rest go, dealt out
by a hash, to groups of bounded size; each group places its pieces one by one
where the sum over residual gaps of the squared number of open sequences with
that gap becomes smallest (a new sequence counts as one choice). Sequences that
end with a gap are opened again and their pieces packed in fewer groups, until
one group is left or a round closes less than ``LEAST_CLOSED`` of its pieces:
these do not fill sequences exactly, in whatever groups, so that round's open
sequences stay as they are. Every other round shrinks the rest by that share.

Defined cases: a null or empty text is one piece (its end id alone); repeated
rows and repeated or null doc_ids are pieces of their own; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import documents, saved, small_batches
from skyroll.llm.tokens import encoder

SEQUENCE = 2048          # ids of a sequence
END_ID = 0
GROUP_PIECES = 20_000    # pieces that one task packs
LEAST_CLOSED = 0.25      # of a round's pieces, for another round to follow
BATCH_ROWS = 1500

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE,
           end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document, without the ids themselves."""
    small_batches(docs.sparkSession, BATCH_ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, keep_blanks=False)
        for b in batches:
            ids, bounds = enc.encode(b.column("text"))
            doc, piece, start, length, crc = [], [], [], [], []
            end = np.array([end_id], dtype=np.uint32)
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                own = np.concatenate([ids[bounds[i]:bounds[i + 1]], end])
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at:at + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(cut, PIECE))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order.

    With n[g] open sequences of gap g, moving one from gap g to g - s changes
    the sum of squares by 2 (n[g - s] - n[g]) + 2; closing one (g = s) by
    1 - 2 n[s]; opening one by 2 n[capacity - s] + 1. Ties go to the tightest gap.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    made = 0
    far = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        here = n[s:capacity]                      # gaps s .. capacity - 1
        change = 2 * (n[:capacity - s] - here) + 2
        if len(change):
            change[0] = 1 - 2 * n[s]
            change[here == 0] = far
            at = int(change.argmin())
            least = change[at]
        else:
            least = far
        gap_new = capacity - s
        fresh = 2 * n[gap_new] + 1 if gap_new else 0
        if least <= fresh and least < far:
            gap = s + at
            b = open_by_gap[gap].pop()
            n[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        where[i], offset[i] = b, capacity - gap
        if gap - s:
            n[gap - s] += 1
            open_by_gap[gap - s].append(b)
    return where, offset


def _pack_group(capacity: int, final: bool):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shuffle", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        order = placing_order(rows["length"].to_numpy(), capacity)
        rows = rows.iloc[order].reset_index(drop=True)
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        fill = np.bincount(where, weights=rows["length"].to_numpy(), minlength=1)
        rows["sequence_id"] = where + (int(key[0]) << 32)
        rows["offset"] = offset
        rows["closed"] = True if final else fill[where] >= capacity
        return rows
    return pack


def placing_order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces over half a sequence first (no two fit together), then the others,
    which find the gaps they close; in hashed order within both."""
    return np.argsort(lengths * 2 <= capacity, kind="stable")


def pack(piece_rows: DataFrame, capacity: int = SEQUENCE,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``piece_rows`` (saved) with sequence_id and offset."""
    base = piece_rows.withColumn("shuffle", F.xxhash64("doc_id", "piece", "ids_crc32"))
    full = piece_rows.where(F.col("length") >= capacity).select(
        "*", F.lit(0).alias("level"),
        (-F.monotonically_increasing_id() - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    todo = base.where(F.col("length") < capacity)
    left, level, done = todo.count(), 0, [full]
    while left:
        groups = math.ceil(left / group_pieces)
        final = groups == 1
        packed = saved(
            todo.withColumn("bin_group", F.pmod(F.xxhash64("shuffle", F.lit(level)), F.lit(groups)))
            .groupBy("bin_group").applyInPandas(_pack_group(capacity, final),
                                                _fields(base) + ", bin_group long, "
                                                "sequence_id long, offset long, closed boolean"),
            f"packed-{level}")
        todo = packed.where(~F.col("closed")).select(*base.columns)
        rest = 0 if final else todo.count()
        if rest > (1 - LEAST_CLOSED) * left:
            final, rest = True, 0
        done.append((packed if final else packed.where("closed")).select(
            *piece_rows.columns, F.lit(level).alias("level"),
            (F.col("sequence_id") + F.lit(level << 56)).alias("sequence_id"), "offset"))
        left, level = rest, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")),
                 "pieces")
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32",
                             "sequence_id", "offset")
