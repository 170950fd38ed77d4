"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, accents and compatibility forms, Cyrillic and
Greek look-alikes, and the digits and signs that stand for letters. The lexicon
holds whole words and word beginnings, each weighted by how much more often it
occurs in toxic than in other training documents (log odds). The automaton
finds them all in one pass over a text; a word counts once, with the largest
weight that begins at it. A hit inside an exception phrase (two words that
training saw around a lexicon word in clean documents only, or phrases given by
the caller) does not count. The summed weight, by itself and per word of text,
goes through a logistic function fitted on the training rows.

Learning uses a bounded sample (``FIT_PER_CLASS`` labelled rows of each class);
scoring covers every whole text in one map-only pass.

Defined cases: null and empty texts have no hits and so the score of a text
without hits; without labels of both classes the lexicon is empty and every
score is ``NO_MODEL_SCORE``; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import documents, id_remainder, labelled_sample, labels, saved, small_batches

FIT_PER_CLASS = 4000     # labelled rows of each class used for learning
MIN_SUPPORT = 5          # toxic training documents a lexicon entry occurs in
MIN_WEIGHT = 3.0         # log odds of an entry, from the cautious count of toxic documents
CAUTION = 1.5            # standard deviations taken off that count
MAX_ENTRIES = 5000       # size of the learned lexicon (by weight, then support)
PREFIXES = range(4, 9)   # lengths of the word beginnings considered
EXCEPTION_SUPPORT = 3    # clean training documents an exception phrase occurs in
NO_MODEL_SCORE = 0.0

# Letters of other scripts that look like Latin ones, and the
# digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
               "@": "a", "$": "s", "!": "i", "|": "l"}


def _fold_table() -> dict[int, str | None]:
    """Folding by rule: the base letter of every accented, wide or styled letter,
    nothing for marks and invisible characters."""
    table: dict[int, str | None] = {}
    for c in [*range(0x80, 0x2E80), *range(0xA640, 0xABFF), *range(0xFB00, 0xFB07),
              *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Cf", "Me"):
            table[c] = None
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", ch)
                       if unicodedata.category(x) != "Mn").lower()
        base = "".join(LOOKALIKES.get(x, x) for x in base)
        if base and base != ch:
            table[c] = base
    table.update({ord(k): v for k, v in LOOKALIKES.items()})
    return table


FOLD = _fold_table()
_LETTER = re.compile(r"[^\W\d_]")
_SUBST = {ord(k): v for k, v in SUBSTITUTES.items()}
_SPLIT = re.compile(r"[^\w@$!|*]+|_+")
_HAS_SUBST = re.compile("[" + re.escape("".join(SUBSTITUTES)) + "]")


def _unsubstitute(word: str) -> str:
    """Signs at the end of a word are punctuation; in a word with letters the
    other digits and signs stand for letters."""
    if not _HAS_SUBST.search(word) or not _LETTER.search(word):
        return word
    return word.rstrip("!|$@.,;:?").translate(_SUBST)


def fold(text: str | None) -> str:
    """Words of the folded text, one blank around each."""
    if not text:
        return " "
    t = text.lower()
    if not t.isascii():
        t = t.translate(FOLD)
    if _HAS_SUBST.search(t):
        t = " ".join(map(_unsubstitute, t.split()))
    return " " + " ".join(w for w in _SPLIT.split(t) if w) + " "


def entries_of(folded: str) -> set[str]:
    """Candidate lexicon entries of a folded text: ' word ' and ' begin'."""
    out = set()
    for w in set(folded.split()):
        if not _LETTER.match(w):
            continue
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            by[y].update(entries_of(fold(t)))
        keys = sorted(set(by[0]) | set(by[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()),
             pa.array([by[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])


def one_of_each(sample: DataFrame) -> DataFrame:
    """Thin out near copies, which would lend their words a support that the
    words don't have: rows of a label with the same smallest hash of an
    eight-word run are taken once."""
    def keyed(batches):
        for b in batches:
            keys = []
            for t in b.column("text").to_pylist():
                w = (t or "").split()
                runs = {" ".join(w[i:i + 8]) for i in range(max(1, len(w) - 7))}
                keys.append(min(zlib.crc32(r.encode("utf-8", "replace")) for r in runs))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())],
                                             [*b.schema.names, "run"])

    return (sample.mapInArrow(keyed, "text string, label int, run long")
            .groupBy("label", "run").agg(F.min("text").alias("text")).select("text", "label"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their log odds; an entry that begins with a shorter entry of
    about the same weight adds nothing and is left out."""
    cautious = F.greatest(F.col("toxic") - CAUTION * F.sqrt("toxic"), F.lit(0.0))
    odds = (F.log((cautious + 0.5) / (n_toxic + 1.0))
            - F.log((F.col("clean") + 0.5) / (n_clean + 1.0)))
    counted = (sample.mapInArrow(_count_entries, "entry string, toxic long, clean long")
               .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .where(F.col("toxic") >= MIN_SUPPORT)
               .withColumn("weight", odds).where(F.col("weight") >= MIN_WEIGHT)
               .orderBy(F.desc("weight"), F.desc("toxic"), "entry").limit(MAX_ENTRIES))
    found = {r["entry"]: r["weight"] for r in counted.collect()}
    out: dict[str, float] = {}
    for entry in sorted(found, key=len):
        shorter = (entry[:k] for k in range(2, len(entry)))
        if not any(s in out and out[s] >= found[entry] - 0.7 for s in shorter):
            out[entry] = found[entry]
    return out


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton | None:
    if not lexicon:
        return None
    a = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        a.add_word(entry, (len(entry), weight))
    a.make_automaton()
    return a


def hits(folded: str, auto, exceptions: frozenset[str]) -> list[tuple[int, float]]:
    """(start, weight) of the words that match, outside exception phrases."""
    best: dict[int, float] = {}
    if auto is not None:
        for end, (size, weight) in auto.iter(folded):
            start = end - size + 1
            best[start] = max(best.get(start, 0.0), weight)
    if best and exceptions:
        best = {s: w for s, w in best.items() if not exceptions & set(phrases(folded, s))}
    return sorted(best.items())


def phrases(folded: str, start: int) -> list[str]:
    """The word that begins after ``start``, with the word before and after it."""
    end = folded.index(" ", start + 1)
    before = folded.rfind(" ", 0, max(start, 0)) if start > 0 else -1
    after = folded.find(" ", end + 1)
    word = folded[start + 1:end]
    out = []
    if before >= 0 and start > 0:
        out.append(f"{folded[before + 1:start]} {word}")
    if after > 0:
        out.append(f"{word} {folded[end + 1:after]}")
    return out


def _facts(folded: str, auto, exceptions) -> tuple[float, float, float]:
    """The largest weight, the summed weight and the summed weight per word."""
    weights = [w for _, w in hits(folded, auto, exceptions)]
    total = sum(weights)
    return (max(weights, default=0.0), math.log1p(total),
            math.log1p(1000.0 * total / (folded.count(" ") + 20)))


class ToxicModel:
    """Lexicon, exception phrases and the logistic map; the automaton is built
    once in each Python worker."""

    def __init__(self, lexicon, exceptions=frozenset(), coef=(0.0, 0.0, 0.0, 0.0), fitted=False):
        self.lexicon, self.exceptions = lexicon, frozenset(exceptions)
        self.coef, self.fitted = coef, fitted
        self._auto = None

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}

    def facts(self, text: str | None) -> tuple[float, float, float]:
        if self._auto is None:
            self._auto = automaton(self.lexicon)
        return _facts(fold(text), self._auto, self.exceptions)

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return NO_MODEL_SCORE
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], self.facts(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _learn_exceptions(sample: DataFrame, lexicon: dict[str, float]) -> set[str]:
    """Two-word phrases around a lexicon word that only clean documents have."""
    model = ToxicModel(lexicon)

    def count(batches):
        auto = automaton(model.lexicon)
        for b in batches:
            by = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(),
                            strict=True):
                folded = fold(t)
                by[y].update({p for s, _ in hits(folded, auto, frozenset())
                              for p in phrases(folded, s)})
            keys = sorted(set(by[0]) | set(by[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()),
                 pa.array([by[0][k] for k in keys], pa.int64())], ["phrase", "toxic", "clean"])

    found = (sample.mapInArrow(count, "phrase string, toxic long, clean long")
             .groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") == 0) & (F.col("clean") >= EXCEPTION_SUPPORT))
             .orderBy(F.desc("clean"), "phrase").limit(MAX_ENTRIES))
    return {r["phrase"] for r in found.collect()}


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps on (1, largest, total, density)."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - 0.5 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def train_toxicity(docs: DataFrame, labels_df: DataFrame,
                   exceptions: frozenset[str] = frozenset()) -> ToxicModel:
    """Learn lexicon, exception phrases and the logistic map from the sample.
    Only counts of entries and three numbers for each sampled row reach the driver."""
    small_batches(docs.sparkSession)
    sample = saved(one_of_each(labelled_sample(docs, labels_df, "toxic", 5, FIT_PER_CLASS)),
                   "toxic-sample")
    by = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(by) < 2:
        return ToxicModel({})
    lexicon = learn_lexicon(sample, by[1], by[0])
    model = ToxicModel(lexicon, exceptions | _learn_exceptions(sample, lexicon))

    def facts(batches):
        for b in batches:
            xs = [model.facts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(xs, pa.list_(pa.float64()))], ["label", "x"])

    got = sample.mapInArrow(facts, "label int, x array<double>").toArrow()
    y = np.array(got.column("label").to_pylist(), dtype=float)
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, 3)
    order = np.lexsort(np.c_[x, y].T)
    model.coef, model.fitted = _fit_logistic(x[order], y[order]), True
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``, in one map-only pass."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s, pa.float64()),
                 pa.array([int(v >= 0.5) for v in s], pa.int32())],
                ["doc_id", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(score, "doc_id long, score double, predicted int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, train_toxicity(docs, labels(spark, sf_dir)))
    return scored.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")
