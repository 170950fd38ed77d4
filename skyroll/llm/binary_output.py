"""Token ids as binary files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id; each partition becomes
one file, so file order and place within a file are the order of ids. A file is
a run of segments (whole documents, about ``SEGMENT_IDS`` ids), a segment is

    header        magic, sizes of the parts that follow
    documents     doc_id, null flag, ids of each
    block index   minimum, width, exceptions and payload start of each block
    payload       packed deltas, block after block
    exceptions    place in the block and delta, block after block

A block holds 256 ids: the minimum is subtracted, the deltas are packed at the
width that the 90th percentile needs (or the widest, where that is smaller
altogether), and larger deltas are stored whole in the exception list. With the
index, ids from any place are read by unpacking the blocks that cover it.

Files go out through Spark's own writer and commit protocol, so any shared file
system works and a lost executor's attempt leaves nothing behind; they are read
back as whole binary files. A manifest (one short row per file) holds each
file's place in the sequence of all ids.

Defined cases: null and empty texts are the end id alone; a null doc_id sorts
first; rows that repeat a doc_id follow one another, ordered by text hash; an
empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyroll.llm.common import documents, saved, small_batches
from skyroll.llm.tokens import encoder
from skyroll.session import scratch_path

END_ID = 2
BLOCK = 256              # ids of a block; a place in it fits one byte
PERCENTILE = 90
SEGMENT_IDS = 1 << 20    # a segment is closed at this many ids
BATCH_ROWS = 1000
MAGIC = b"PFORSEG1"
# magic, documents, ids, blocks, payload words, exceptions, size of the segment
HEADER = struct.Struct("<8sqqqqqq")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each non-negative number."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_lanes(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers as rows of ``4 * width`` 64-bit words."""
    lanes = v.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(lanes), width), dtype=np.uint64)
    for j in range(64):
        word, off = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << np.uint64(off)
        if off + width > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - off)
    return out.reshape(len(v), -1)


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers back from rows of ``4 * width`` words."""
    lanes = words.reshape(-1, width)
    out = np.empty((len(lanes), 64), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, off = divmod(j * width, 64)
        x = lanes[:, word] >> np.uint64(off)
        if off + width > 64:
            x = x | (lanes[:, word + 1] << np.uint64(64 - off))
        out[:, j] = x & mask
    return out.reshape(len(words), -1)


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes, int, int]:
    """(block index, payload, exceptions, payload words, exceptions) of ids."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, dtype=np.int64)
    padded[:len(ids)] = ids
    padded[len(ids):] = ids[-1] if len(ids) else 0
    rows = padded.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    kth = BLOCK * PERCENTILE // 100 - 1
    at_percentile = _bits(np.partition(delta, kth, axis=1)[:, kth])
    widest = _bits(delta.max(axis=1))
    over = delta >= (np.int64(1) << at_percentile)[:, None]
    patched = at_percentile * BLOCK + 40 * over.sum(axis=1)
    width = np.where(patched < widest * BLOCK, at_percentile, widest)
    over &= (width < widest)[:, None]
    block, place = np.nonzero(over)
    n_over = np.bincount(block, minlength=n_blocks)
    values = delta[block, place]
    delta[block, place] = 0
    words = 4 * width
    start = np.cumsum(words) - words
    payload = np.zeros(int(words.sum()), dtype="<u8")
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        payload[start[mine][:, None] + np.arange(4 * w)] = pack_lanes(delta[mine], int(w))
    index = (low.astype("<u4").tobytes() + width.astype("u1").tobytes()
             + n_over.astype("<u2").tobytes() + start.astype("<i8").tobytes())
    outliers = place.astype("u1").tobytes() + values.astype("<u4").tobytes()
    return index, payload.tobytes(), outliers, len(payload), len(values)


def segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    index, payload, outliers, n_words, n_over = encode_ids(ids)
    known = np.array([d is not None for d in doc_ids], dtype="u1")
    docs = (np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes()
            + sizes.astype("<i8").tobytes())
    body = docs + index + payload + outliers
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), -(-len(ids) // BLOCK), n_words, n_over,
                       HEADER.size + len(body)) + body


class Segment:
    """A segment read from ``data`` at ``at``."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, n, self.n_ids, blocks, words, n_over, self.size = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        self._at = at + HEADER.size
        ids = self._take(data, "<i8", n)
        known = self._take(data, "u1", n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.sizes = self._take(data, "<i8", n)
        self.low = self._take(data, "<u4", blocks)
        self.width = self._take(data, "u1", blocks).astype(np.int64)
        self.n_over = self._take(data, "<u2", blocks).astype(np.int64)
        self.start = self._take(data, "<i8", blocks)
        self.payload = self._take(data, "<u8", words)
        self.place = self._take(data, "u1", n_over)
        self.over = self._take(data, "<u4", n_over)

    def _take(self, data: memoryview, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive), from the blocks that cover them."""
        last = self.n_ids if last is None else last
        b0, b1 = first // BLOCK, -(-last // BLOCK)
        out = np.zeros((max(0, b1 - b0), BLOCK), dtype=np.int64)
        width, start = self.width[b0:b1], self.start[b0:b1]
        for w in np.unique(width[width > 0]):
            mine = np.flatnonzero(width == w)
            out[mine] = unpack_lanes(self.payload[start[mine][:, None] + np.arange(4 * w)], int(w))
        before = np.cumsum(self.n_over) - self.n_over
        if b1 > b0:
            lo = int(before[b0])
            hi = int(before[b1 - 1] + self.n_over[b1 - 1])
            block = np.repeat(np.arange(b1 - b0), self.n_over[b0:b1])
            out[block, self.place[lo:hi]] = self.over[lo:hi]
        out += self.low[b0:b1].astype(np.int64)[:, None]
        return out.reshape(-1)[first - b0 * BLOCK:last - b0 * BLOCK].astype(np.uint32)


def segments(content: bytes) -> Iterator[Segment]:
    """The segments of a file; the writer ends each with a line end."""
    at, data = 0, memoryview(content)
    while at < len(data):
        s = Segment(data, at)
        yield s
        at += s.size + 1


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
              partitions: int | None = None) -> None:
    """Write the ids of all documents, in order of doc_id, below ``path``.

    ``partitions`` (files) defaults to the session's shuffle partitions; take so
    many that a partition's text fits in a task's memory several times.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, keep_blanks=True)
        end = np.array([end_id], dtype=np.uint32)
        doc_ids: list = []
        chunks: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(c) for c in chunks], dtype=np.int64)
            out = segment(doc_ids, sizes, np.concatenate(chunks))
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["segment"])

        for b in batches:
            ids, bounds = enc.encode(b.column("text"))
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                doc_ids.append(d)
                chunks.append(np.concatenate([ids[bounds[i]:bounds[i + 1]], end]))
                held += len(chunks[-1])
                if held >= SEGMENT_IDS:
                    yield close()
                    doc_ids, chunks, held = [], [], 0
        if doc_ids:
            yield close()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie))
    # The text writer puts the bytes out as they are, one segment a line.
    (ordered.mapInArrow(encode, "segment binary")
     .select(F.col("segment").cast("string").alias("segment")).write.text(f"{path}/ids"))
    manifest = (_files(spark, path).mapInArrow(_count_ids, "file string, n_ids long"))
    number = F.split("file", "-")[1].cast("long")  # part-<partition>-...
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    (manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
     .write.parquet(f"{path}/manifest"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
            .load(f"{path}/ids").select(name.alias("file"), "content"))


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = []
        for i in range(b.num_rows):
            data, at, total = memoryview(b.column("content")[i].as_buffer()), 0, 0
            while at < len(data):
                head = HEADER.unpack_from(data, at)
                total, at = total + head[2], at + head[6] + 1
            n.append(total)
        yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(n, pa.int64())],
                                         ["file", "n_ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32 of each document, from the files."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, at = b.column("file")[i].as_py(), 0
                for s in segments(b.column("content")[i].as_buffer()):
                    ids = s.ids().astype("<u4")
                    stop = np.cumsum(s.sizes)
                    crc = [zlib.crc32(ids[a:z].tobytes())
                           for a, z in zip(stop - s.sizes, stop, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(crc)), pa.array(s.doc_ids, pa.int64()),
                         pa.array(at + stop - s.sizes, pa.int64()), pa.array(s.sizes, pa.int64()),
                         pa.array(crc, pa.int64())],
                        ["file", "doc_id", "place", "n_tokens", "ids_crc32"])
                    at += s.n_ids

    rows = _files(spark, path).mapInArrow(
        decode, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")
    manifest = spark.read.schema("file string, n_ids long, first long").parquet(f"{path}/manifest")
    return rows.join(manifest, "file").select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path)
