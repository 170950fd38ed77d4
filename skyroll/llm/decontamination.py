"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus give every word a
   weight (idf). A passage is a vector of sqrt(tf) * idf.
2. A randomised SVD of the benchmark's passage vectors, by subspace iteration in
   which each product with the passages is a Spark job, gives the latent space
   of a block of items. Its rank is the block's size at most, so a block small
   enough loses nothing of an item's inner products.
3. Every document is covered by overlapping windows of the items' lengths. The
   part of a window's norm that lies on benchmark words bounds its cosine with
   every item, and so does the sum of its words' latent products with the items;
   windows that may reach the cosine are folded in and compared with the items.
   Beside them, every place where an item stands word by word is a candidate,
   whatever its words weigh.
4. A candidate is confirmed word by word: the longest common subsequence of
   the item and the text around the window covers most of the item, or a good
   part of it while the item's answer (its last sentence) is there as well.

The benchmark is the query set: it is read in blocks, and each pass over the
corpus serves ``BLOCKS_PER_PASS`` blocks.

Defined cases: null texts and texts without words (empty, or signs only) match
nothing, neither as documents nor as items; numbers are words; repeated items and repeated doc_ids give a row each; an empty benchmark
or corpus gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import by_bytes, documents, saved, small_batches
from skyroll.llm.jaccard_join import word_hashes

BUCKET_BITS = 16         # word weights are kept for this many hash buckets
ITEM_BLOCK = 256         # items of a latent space
RANK = 256               # its dimensions at most
BLOCKS_PER_PASS = 8
POWER_STEPS = 2          # subspace iterations of the SVD
CANDIDATE_COSINE = 0.35  # a window's cosine with an item, to be looked at
LCS_SHARE = 0.7          # of the item's words, for a match by itself
LCS_WITH_ANSWER = 0.5    # the same where the answer is found too
ANSWER_SHARE = 0.8       # of the answer's words
BATCH_ROWS = 2000
WORDS_AT_ONCE = 32768    # words of text whose products are held at a time
# ASCII signs become blanks; all other bytes stay.
_NO_SIGNS = np.array([0x20 if 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60
                      or 0x7B <= b <= 0x7E else b for b in range(256)], dtype=np.uint8)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without ASCII signs; digits are words too."""
    low = pc.utf8_lower(texts.fill_null(""))
    _, ends, data = low.buffers()
    if data is None:
        return word_hashes(low)
    plain = _NO_SIGNS[np.frombuffer(data, np.uint8)]
    return word_hashes(pa.Array.from_buffers(low.type, len(low), [None, ends, pa.py_buffer(plain)],
                                             offset=low.offset))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_weights(docs: DataFrame) -> np.ndarray:
    """idf by bucket, from the document frequencies over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BUCKET_BITS, dtype=np.int64), 0
        for b in by_bytes(batches):
            words, at = _words(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            pair = np.sort((doc << BUCKET_BITS) | _bucket(words))
            first = pair[np.diff(pair, prepend=-1) > 0]
            seen += np.bincount(first & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
            n += b.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(seen[used], n))],
            ["bucket", "n"])

    rows = (docs.select("text").mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n"))).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(1 << BUCKET_BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    total = float(n[bucket < 0].sum())
    return np.log((total + 1) / (df + 0.5)).clip(min=0.05)


def passage_vector(words: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray):
    """(places in the vocabulary, weights) of a passage's words that it has."""
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    have = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
    term, tf = np.unique(at[have], return_counts=True)
    return term, np.sqrt(tf) * idf[_bucket(vocabulary[term])]


def randomized_svd(passages: DataFrame, size: int, rank: int, steps: int = POWER_STEPS) -> np.ndarray:
    """Right singular vectors (size x rank) of the matrix whose sparse rows are
    the ``terms`` and ``weights`` of ``passages``.

    Each step multiplies the current basis by A'A: tasks add up the products of
    their rows, Spark sums them by term. ``size`` and ``rank`` are bounded by
    the block of items, and so is what the driver orthonormalises.
    """
    sc = passages.sparkSession.sparkContext
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((size, min(rank, size))))[0]
    for _ in range(steps + 1):
        shared = sc.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v = shared.value
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for terms, weights in zip(b.column("terms").to_pylist(),
                                          b.column("weights").to_pylist(), strict=True):
                    y = np.array(weights) @ v[terms]
                    for t, w in zip(terms, weights, strict=True):
                        total[t] = total[t] + w * y if t in total else w * y
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()),
                 pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))],
                ["term", "vec"])

        def add(key: tuple, rows):
            return rows.head(1).assign(vec=[np.sum(np.stack(rows["vec"].to_numpy()), axis=0)])

        got = (passages.mapInArrow(multiply, "term int, vec array<double>")
               .groupBy("term").applyInPandas(add, "term int, vec array<double>")).toArrow()
        image = np.zeros_like(basis)
        for t, v in zip(got.column("term").to_pylist(), got.column("vec").to_pylist(), strict=True):
            image[t] = v
        basis = np.linalg.qr(image)[0]
    return basis


class Block:
    """The latent space of a block of items, and the items in it."""

    def __init__(self, ids, words, answers, vocabulary, basis, idf):
        self.ids, self.words, self.answers = ids, words, answers
        self.vocabulary, self.basis = vocabulary, basis.astype(np.float32)
        self.items = np.zeros((len(ids), basis.shape[1]), dtype=np.float32)
        for i, w in enumerate(words):
            term, weight = passage_vector(w, vocabulary, idf)
            self.items[i] = weight @ basis[term] / max(1e-9, np.sqrt((weight ** 2).sum()))
        # Window lengths: powers of two that cover the items' lengths.
        self.sizes = sorted({1 << max(3, int(np.ceil(np.log2(max(1, len(w)))))) for w in words})
        self.masks = [_masks(w) for w in words]
        self.answer_masks = [_masks(w) for w in answers]
        # Each item is looked for by its word of the highest weight.
        self.anchor_at = [int(idf[_bucket(w)].argmax()) for w in words]
        self.anchors = np.unique([w[k] for w, k in zip(words, self.anchor_at, strict=True)])

    def pull(self, idf: np.ndarray) -> np.ndarray:
        """The latent product of every term, weighted, with every item; then zeros."""
        terms = idf[_bucket(self.vocabulary)].astype(np.float32)[:, None] * self.basis
        return np.vstack([terms @ self.items.T, np.zeros((1, len(self.items)), np.float32)])


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def lcs(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    full = (1 << size) - 1
    v = full
    for w in other:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def answer_of(text: str) -> str:
    """The last sentence of an item; the last third where it is one sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip(" .!?")]
    if len(parts) > 1:
        return parts[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 3):])


def fit_block(passages: DataFrame, rows: list, idf: np.ndarray) -> Block | None:
    """``passages``: the benchmark rows with the ids of ``rows`` (one block)."""
    words, at = _words(pa.array([r["text"] for r in rows], pa.string()))
    items = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    keep = [i for i, w in enumerate(items) if len(w)]
    if not keep:
        return None
    answers, cut = _words(pa.array([answer_of(rows[i]["text"]) for i in keep], pa.string()))
    vocabulary = np.unique(np.concatenate([items[i] for i in keep]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, place = _words(b.column("text"))
            got = [passage_vector(w[x:y], vocabulary, idf)
                   for x, y in zip(place[:-1], place[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0].tolist() for g in got], pa.list_(pa.int32())),
                 pa.array([g[1].tolist() for g in got], pa.list_(pa.float64()))],
                ["terms", "weights"])

    matrix = saved(passages.select("text").mapInArrow(
        vectors, "terms array<int>, weights array<double>"), "passage-vectors")
    basis = randomized_svd(matrix, len(vocabulary), min(RANK, len(keep)))
    return Block([rows[i]["item_id"] for i in keep], [items[i] for i in keep],
                 [answers[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)],
                 vocabulary, basis, idf)


def candidate_windows(words: np.ndarray, at: np.ndarray, block: Block, idf: np.ndarray,
                      pull: np.ndarray, cosine: float = CANDIDATE_COSINE) -> Iterator[tuple]:
    """(text, first word, last word, item, cosine) of the windows near an item;
    ``pull`` is the block's.

    The latent product is linear in the window's terms. With tf in place of
    sqrt(tf) the sum of its terms' products is never below the product of the
    window's vector, so a window goes on only while such a sum can reach
    ``cosine``: first with each term's greatest product with any item, which is one
    number for each word; then, for the few that are left, with every item.
    """
    bucket = _bucket(words)
    mass = idf[bucket] ** 2
    place = np.searchsorted(block.vocabulary, words)
    place[place == len(block.vocabulary)] = 0
    inside = block.vocabulary[place] == words
    most = np.maximum(pull.max(axis=1), 0).astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(mass)])
    shared = np.concatenate([[0.0], np.cumsum(mass * inside)])
    reach = np.concatenate([[0.0], np.cumsum(most[np.where(inside, place, len(most) - 1)])])
    known = np.flatnonzero(inside)
    term_of = place[known]
    first, last = at[:-1], at[1:]
    for size in block.sizes:
        step = size // 4
        count = np.where(last > first, np.maximum(0, -(-(last - first - size) // step)) + 1, 0)
        doc = np.repeat(np.arange(len(first)), count)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        a = first[doc] + turn * step
        z = np.minimum(a + size, last[doc])
        norm2 = total[z] - total[a]
        near = np.flatnonzero(
            (shared[z] - shared[a] >= (cosine ** 2) * norm2 - 1e-9)
            & (reach[z] - reach[a] >= (cosine - 1e-3) * np.sqrt(norm2)) & (shared[z] > shared[a]))
        doc, a, z, norm = doc[near], a[near], z[near], np.sqrt(norm2[near])
        # a window is four steps of its text, and four windows share a step
        steps = np.unique((a[:, None] + np.arange(4) * step).ravel())
        ends = np.minimum(steps + step, at[np.searchsorted(at, steps, side="right").clip(max=len(at) - 1)])
        lo, hi = np.searchsorted(known, steps), np.searchsorted(known, np.maximum(steps, ends))
        at_once = max(1, WORDS_AT_ONCE // size)
        for x in range(0, len(a), at_once):
            y = min(x + at_once, len(a))
            p, q = np.searchsorted(steps, (a[x], a[y - 1] + 3 * step + 1))
            length = hi[p:q] - lo[p:q]
            begin = np.cumsum(length) - length
            own = np.arange(length.sum()) + np.repeat(lo[p:q] - begin, length)
            full = np.flatnonzero(length)
            part = np.zeros((q - p, pull.shape[1]), dtype=np.float32)
            part[full] = np.add.reduceat(pull[term_of[own]], begin[full], axis=0)
            sums = np.zeros((y - x, pull.shape[1]), dtype=np.float32)
            for quarter in range(4):
                from_ = a[x:y] + quarter * step
                inside_text = from_ < z[x:y]
                sums[inside_text] += part[np.searchsorted(steps, from_[inside_text]) - p]
            for k in (x + np.flatnonzero(
                    (sums >= ((cosine - 1e-3) * norm[x:y])[:, None]).any(axis=1))).tolist():
                term, weight = passage_vector(words[a[k]:z[k]], block.vocabulary, idf)
                found = block.items @ (weight.astype(np.float32) @ block.basis[term])
                found /= np.float32(max(norm[k], 1e-9))
                for i in np.flatnonzero(found >= cosine).tolist():
                    yield int(doc[k]), int(a[k]), int(z[k]), i, float(found[i])


def literal_copies(words: np.ndarray, at: np.ndarray, block: Block) -> Iterator[tuple]:
    """(text, first word, last word, item, cosine) of the places where an item
    stands word by word."""
    near = np.searchsorted(block.anchors, words)
    near[near == len(block.anchors)] = 0
    hits = np.flatnonzero(block.anchors[near] == words)
    hits = hits[np.argsort(words[hits], kind="stable")]
    found = words[hits]
    for i, (item, k) in enumerate(zip(block.words, block.anchor_at, strict=True)):
        lo, hi = np.searchsorted(found, item[k], "left"), np.searchsorted(found, item[k], "right")
        a = hits[lo:hi] - k
        a = a[(a >= 0) & (a + len(item) <= len(words))]
        for j, w in enumerate(item):
            if not len(a):
                break
            a = a[words[a + j] == w]
        doc = np.searchsorted(at, a, side="right") - 1
        inside = a + len(item) <= at[doc + 1]
        for d, x in zip(doc[inside].tolist(), a[inside].tolist(), strict=True):
            yield d, x, x + len(item), i, 1.0


def confirm(words: np.ndarray, lo: int, hi: int, block: Block, item: int) -> tuple[float, bool]:
    """(share of the item in the common subsequence, is the answer there)"""
    around = words[lo:hi].tolist()
    size = len(block.words[item])
    share = lcs(block.masks[item], size, around) / size
    n = len(block.answers[item])
    found = n > 0 and lcs(block.answer_masks[item], n, around) >= ANSWER_SHARE * n
    return share, bool(found)


def search(docs: DataFrame, blocks: list[Block], idf: np.ndarray) -> DataFrame:
    """Confirmed pairs of ``docs`` and the items of ``blocks``, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((blocks, idf))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        pulls = [block.pull(weights) for block in own]
        for b in by_bytes(batches):
            words, at = _words(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            out = []
            for block, pull in zip(own, pulls, strict=True):
                best: dict[tuple[int, int], tuple] = {}
                for doc, a, z, i, cos in chain(literal_copies(words, at, block),
                                               candidate_windows(words, at, block, weights, pull)):
                    margin = len(block.words[i]) // 2
                    lo, hi = max(int(at[doc]), a - margin), min(int(at[doc + 1]), z + margin)
                    share, found = confirm(words, lo, hi, block, i)
                    if share >= LCS_SHARE or (found and share >= LCS_WITH_ANSWER):
                        got = (share, cos, found)
                        best[doc, i] = max(best.get((doc, i), got), got)
                out += [(ids[d], block.ids[i], c, s, f) for (d, i), (s, c, f) in best.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in
                 enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))],
                ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        find, "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found of all confirmed pairs."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    idf = word_weights(docs)
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
             .where(F.col("text").isNotNull()))
    rows = items.orderBy("item_id", "text").toLocalIterator()
    out = None
    while True:
        blocks, empty = [], True
        while len(blocks) < BLOCKS_PER_PASS and (part := list(islice(rows, ITEM_BLOCK))):
            empty = False
            ids = [r["item_id"] for r in part]
            own = items.where(F.col("item_id").isNull() | F.col("item_id").between(
                min((i for i in ids if i is not None), default=0),
                max((i for i in ids if i is not None), default=0)))
            block = fit_block(own, part, idf)
            blocks += [block] if block is not None else []
        if blocks:
            found = search(docs, blocks, idf)
            out = found if out is None else out.unionByName(found)
        if empty or len(blocks) < BLOCKS_PER_PASS:
            break
    return search(docs.limit(0), [], idf) if out is None else out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
