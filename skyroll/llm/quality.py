"""Quality classifier by Bradley-Terry ranking of documents.

A document's score is linear in a few text measures. The weights are learned
from preference pairs (a document labelled good is preferred to one labelled
bad): logistic loss on the difference of the two feature vectors, so only the
order of documents matters and no intercept exists. The accept threshold comes
from quantiles of the training scores, and the score is mapped to 0..1 with
the threshold at 0.3.

The fit uses a bounded sample (``FIT_PER_CLASS`` labelled rows of each class);
scoring covers every whole text in one map-only pass.

Defined cases: null and empty texts get the measures of an empty text and so a
score; without labels of both classes every score is ``NO_MODEL_SCORE``;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import documents, id_remainder, labelled_sample, labels, small_batches

FIT_PER_CLASS = 4000     # labelled rows of each class used for the fit
FIT_PAIRS = 40000        # preference pairs drawn from them
RIDGE = 1e-5             # penalty on the squared weights, per pair
ACCEPT = 0.3             # score at the threshold
NO_MODEL_SCORE = 0.5
# The threshold lies between these quantiles of the bad and the good scores.
BAD_QUANTILE, GOOD_QUANTILE = 0.99, 0.002

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FEATURES = ["log_words", "distinct_words", "upper", "symbols", "digits", "word_length",
            "adjacent_repeats", "distinct_lines", "line_words", "top_word"]


def measures(text: str | None) -> list[float]:
    """The measures of one whole text, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    words = text.lower().split()
    n = max(1, len(words))
    lines = text.split("\n")
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [math.log1p(len(words)),
            len(counts) / n,
            (size - len(raw.translate(None, _UPPER))) / size,
            (size - len(raw.translate(None, _SYMBOL))) / size,
            (size - len(raw.translate(None, _DIGIT))) / size,
            min(len(text) / n, 50.0),
            repeats / n,
            len(set(lines)) / len(lines),
            math.log1p(n / len(lines)),
            max(counts.values(), default=0) / n]


class Ranker:
    """Weights on standardised measures, and the map from score to 0..1."""

    def __init__(self, mean, scale, weights, cut, spread):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.cut, self.spread = cut, spread

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        z = np.clip((raw - self.cut) / self.spread + math.log(ACCEPT / (1 - ACCEPT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_ranker(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranker | None:
    """Bradley-Terry weights by Newton steps over drawn pairs."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    std = lambda a: np.clip((a - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = (std(good)[rng.integers(0, len(good), FIT_PAIRS)]
            - std(bad)[rng.integers(0, len(bad), FIT_PAIRS)])
    w = np.zeros(x.shape[1])
    ridge = RIDGE * len(diff) * np.eye(len(w))
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        curve = (diff * (p * (1 - p))[:, None]).T @ diff + ridge
        w += np.linalg.solve(curve, diff.T @ p - ridge @ w)
    top = float(np.quantile(std(bad) @ w, BAD_QUANTILE))
    low = float(np.quantile(std(good) @ w, GOOD_QUANTILE))
    cut = (top + low) / 2 if top < low else low
    spread = float(np.std(np.r_[std(good) @ w, std(bad) @ w])) / 4 + 1e-6
    return Ranker(mean, scale, w, cut, spread)


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [measures(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))],
                                         ["label", "x"])


def train_quality(docs: DataFrame, labels_df: DataFrame) -> Ranker | None:
    """Fit on the bounded sample; only its measures (2 x FIT_PER_CLASS short
    rows) reach the driver."""
    sample = labelled_sample(docs, labels_df, "quality", 5, FIT_PER_CLASS)
    got = sample.mapInArrow(_measure_rows, "label int, x array<double>").toArrow()
    y = np.array(got.column("label").to_pylist(), dtype=int)
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(np.c_[x, y].T)
    return fit_ranker(x[order], y[order])


def score_quality(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``, in one map-only pass."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measures(t) for t in b.column("text").to_pylist()], dtype=float)
            s = (np.full(b.num_rows, NO_MODEL_SCORE) if model is None or not b.num_rows
                 else model.score(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s, pa.float64()),
                 pa.array((s >= ACCEPT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(score, "doc_id long, score double, predicted int"))


def accepted(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model accepts."""
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([measures(t) for t in b.column("text").to_pylist()], dtype=float)
                b = b.filter(pa.array(model.score(x) >= ACCEPT))
            yield b

    if model is None:  # NO_MODEL_SCORE is above ACCEPT
        return docs
    return docs.mapInArrow(keep, docs.schema)


def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small_batches(spark)
    scored = score_quality(docs, train_quality(docs, labels(spark, sf_dir)))
    return scored.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")
