"""Language identification with span labels for mixed-language text.

Each word gets one score per language: a naive Bayes log-likelihood over its
character n-grams, learned from labelled documents. The script of a word (by
Unicode ranges) first narrows the languages: only those that training saw in
that script compete. Words of several scripts are cut where the script changes,
long ones every ``PIECE_LETTERS`` letters (``DENSE_LETTERS`` in scripts without
blanks), and each piece counts as a word does; the n-grams across a cut belong to
the piece they begin in. A Viterbi pass over the words, with a penalty for every
change of language, labels the spans; the language with the most letters wins.

Most texts are in one language throughout. A text skips the Viterbi recursion
when no run of words gains more than the penalty over the best single language,
which proves the unswitched path optimal (each foreign piece of a path costs at
least one change).

Learning uses a bounded sample (about ``FIT_PER_LANG`` documents of each
language) of every language there is, and each language brings its own most
frequent n-grams into the model. Prediction covers every whole text in one
map-only pass.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
words in a script no learned language uses are neutral; a word in which the
language changes is in both spans, and the later one has ``first_char`` above 0; a text of such words
only gets the most frequent learned language with score 1/languages; without
training rows everything is ``und``; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyroll.llm.common import documents, id_remainder, saved, small_batches

FIT_PER_LANG = 1500      # expected training documents of each language
MODEL_GRAMS = 60_000     # n-grams of the model: each language has an equal share, by count,
LANG_GRAMS = 1000        # ... and at least so many
SWITCH_PENALTY = 12.0    # nats that a change of language costs
WORD_CAP = 6.0           # nats that one word may count against a language
SCRIPT_SHARE = 0.01      # of a language's words, for the script to be its own
PIECE_LETTERS = 40       # letters of a word that are scored together
DENSE_LETTERS = 6        # the same in scripts that write without blanks
WORD_CACHE = 300_000     # scored words a Python worker keeps
WORDS_AT_ONCE = 20_000   # words scored together with up to four languages
BATCH_ROWS = 2000

# First and last code point of the scripts told apart.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
           ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
           ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
           ("latin", 0x1E00, 0x1EFF), ("han", 0x3005, 0x3007),
           ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]
DENSE = {"han", "kana", "thai"}
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _one_script() -> re.Pattern:
    """Matches a run of letters of one script and names it."""
    by: dict[str, str] = {}
    for name, lo, hi in SCRIPTS:
        by[name] = by.get(name, "") + f"{chr(lo)}-{chr(hi)}".replace("[", r"\[")
    parts = [f"(?P<{name}>[{chars}]+)" for name, chars in by.items()]
    return re.compile("|".join([*parts, f"(?P<other>[^{''.join(by.values())}]+)"]))


_RUN = _one_script()
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]+")


def script_of(word: str) -> str:
    """Script of the first letter; 'other' outside the listed ranges."""
    c = ord(word[0])
    for name, lo, hi in SCRIPTS:
        if lo <= c <= hi:
            return name
    return "other"


class Piece(NamedTuple):
    """Letters of one script: ``text`` has word ends marked and up to three
    letters that follow; n-grams begin at its first ``n`` places."""

    text: str
    n: int
    letters: int
    script: str


def pieces(word: str) -> list[tuple[int, Piece]]:
    """(first letter, piece) of a word of letters; the pieces cover all of it."""
    if len(word) <= PIECE_LETTERS and (word.isascii() or _LATIN.fullmatch(word)):
        return [(0, Piece(f"^{word}$", len(word) + 2, len(word), "latin"))] if word else []
    out = []
    for run in _RUN.finditer(word):
        size = DENSE_LETTERS if run.lastgroup in DENSE else PIECE_LETTERS
        marked, letters = f"^{run[0]}$", len(run[0])
        for a in range(0, letters, size):
            z = min(a + size, letters)
            lo, hi = (a + 1 if a else 0), (z + 1 if z < letters else letters + 2)
            out.append((run.start() + a, Piece(marked[lo:hi + 3], hi - lo, z - a, run.lastgroup)))
    return out


def grams(piece: Piece) -> list[str]:
    """Character n-grams of one to four letters, word ends marked."""
    w, k = piece.text, piece.n
    if k == len(w) and w[0] == "^":  # a whole run
        return [w[i:i + n] for n in (2, 3, 4) for i in range(k - n + 1)] + list(w[1:-1])
    return ([w[i:i + n] for n in (2, 3, 4) for i in range(min(k, len(w) - n + 1))]
            + [c for c in w[:k] if c not in "^$"])


@lru_cache(WORD_CACHE)
def token_pieces(token: str) -> list[tuple[int, str | Piece]]:
    """(first character, piece) of a token; one that is not cut stands for itself."""
    if len(token) <= PIECE_LETTERS and token.isascii():
        return [(0, token)]
    word = _NOT_LETTERS.sub("", token)
    found = pieces(word)
    if len(found) < 2:
        return [(0, token)]
    at = [i for i, c in enumerate(token) if not _NOT_LETTERS.match(c)]
    return [(at[first] if first else 0, piece) for first, piece in found]


# Odd multipliers of the n-grams' hashes (any odd 64-bit numbers do).
_PLACE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                   0xD6E8FEB86659FD93], dtype=np.uint64)
_SIZE = np.uint64(0xA0761D6478BD642F)
_MARKS = (ord("^"), ord("$"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hash(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` letters from every place of ``codes`` on."""
    n = len(codes) - size + 1
    h = np.full(max(n, 0), size, dtype=np.uint64) * _SIZE
    for k in range(size):
        h += codes[k:k + n] * _PLACE[k]
    h ^= h >> np.uint64(29)
    return h * _PLACE[0]


class LanguageModel:
    """Log-probabilities of n-grams by language, and the scripts of each."""

    def __init__(self, langs: list[str], counts: dict[str, list[int]],
                 scripts: dict[str, list[bool]], docs: list[int]):
        self.langs, self.scripts, self.docs = langs, scripts, docs
        k = len(langs)
        table = np.array(list(counts.values()), dtype=np.float64).reshape(len(counts), k)
        self.logp = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * (len(counts) + 1)))
        hashes = np.array([_hash(_codes(g), len(g))[0] for g in counts], dtype=np.uint64)
        order = np.argsort(hashes)
        self.known, self.rows = hashes[order], order
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two n-grams of the model have one hash")
        self._cache: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def _found(self, parts: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
        """(part, row of the model) of every known n-gram, ordered by part."""
        codes = _codes("".join(p.text for p in parts))
        length = np.array([len(p.text) for p in parts], dtype=np.int64)
        part = np.repeat(np.arange(len(parts)), length)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        begins = place < np.array([p.n for p in parts], dtype=np.int64)[part]
        left = length[part] - place
        who, which = [], []
        for size in (1, 2, 3, 4):
            n = max(len(codes) - size + 1, 0)
            ok = begins[:n] & (left[:n] >= size)
            if size == 1:
                ok &= ~np.isin(codes, _MARKS)
            at = np.flatnonzero(ok)
            h = _hash(codes, size)[at]
            row = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[row] == h
            who.append(part[at[hit]])
            which.append(self.rows[row[hit]])
        who, which = np.concatenate(who), np.concatenate(which)
        order = np.argsort(who, kind="stable")
        return who[order], which[order]

    def score(self, tokens: list[str | Piece]) -> list[tuple[int, bytes]]:
        """(letters, float32 scores) of each word or piece: 0 for the best language,
        negative for others; all 0 for words of a script of no language."""
        k = len(self.langs)
        letters, parts, of = [], [], []
        allowed = np.ones((len(tokens), k), dtype=bool)
        for i, token in enumerate(tokens):
            if isinstance(token, str):
                word = token if token.isalpha() else _NOT_LETTERS.sub("", token)
                token = next((p for _, p in pieces(word)), None)
            letters.append(token.letters if token else 0)
            known = self.scripts.get(token.script) if token else None
            if known is not None and any(known):
                allowed[i] = known
                parts.append(token)
                of.append(i)
        s = np.zeros((len(tokens), k))
        if parts and len(self.known):
            who, which = self._found(parts)
            if len(who):
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                s[np.array(of)[who[first]]] = np.add.reduceat(self.logp[which], first, axis=0)
        s = np.where(allowed, s, -np.inf)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -WORD_CAP).astype(np.float32)
        return [(n, x.tobytes()) for n, x in zip(letters, s, strict=True)]

    def words(self, tokens: list[str | Piece]) -> tuple[np.ndarray, np.ndarray]:
        """Letters and scores of distinct words, through the worker's cache."""
        if len(self._cache) > WORD_CACHE:
            self._cache.clear()
        cache = self._cache
        new = [t for t in tokens if t not in cache]
        at_once = max(200, WORDS_AT_ONCE * 4 // max(4, len(self.langs)))
        for at in range(0, len(new), at_once):
            part = new[at:at + at_once]
            cache.update(zip(part, self.score(part), strict=True))
        out = [cache[t] for t in tokens]
        letters = np.array([g[0] for g in out], dtype=np.int64)
        scores = np.frombuffer(b"".join(g[1] for g in out), np.float32)
        return letters, scores.reshape(len(out), len(self.langs))


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray,
            penalty: float) -> list[np.ndarray]:
    """Best states of the rows ``scores[start:end]`` of each text when a change of
    state costs ``penalty``. Texts go forward together, one row of each at a time."""
    order = np.argsort(starts - ends, kind="stable")          # longest first
    begin, size = starts[order], (ends - starts)[order]
    k, steps = scores.shape[1], int(size.max(initial=0))
    live = np.searchsorted(-size, -np.arange(steps), side="left")   # texts with a row t
    at = np.concatenate([[0], np.cumsum(live)])
    stay, top = np.empty((at[-1], k), dtype=bool), np.empty(at[-1], dtype=np.int64)
    v, own = np.zeros((len(order), k)), np.arange(len(order))
    for t in range(steps):
        n = live[t]
        now = v[:n]
        best = now.argmax(axis=1)
        least = now[own[:n], best][:, None] - penalty
        keep = now >= least
        stay[at[t]:at[t + 1]], top[at[t]:at[t + 1]] = keep, best
        np.maximum(now, least, out=now)
        now += scores[begin[:n] + t]
    state = v.argmax(axis=1)
    flat = np.empty(at[-1], dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        flat[at[t]:at[t + 1]] = state[:n]
        state[:n] = np.where(stay[at[t] + own[:n], state[:n]], state[:n], top[at[t]:at[t + 1]])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return [flat[at[:size[j]] + j] for j in place.tolist()]


def _unswitched(scores: np.ndarray, first: np.ndarray, best: np.ndarray) -> np.ndarray:
    """For texts that begin at rows ``first``: is the path that stays in ``best``
    proven optimal? (No run of words gains more than the penalty.)"""
    n_docs = len(first) - 1
    ok = np.ones(n_docs, dtype=bool)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(n_docs), sizes)
    own = scores[np.arange(len(doc)), best[doc]].astype(np.float64)
    live = sizes > 0
    for k in range(scores.shape[1]):
        gain = np.cumsum(scores[:, k] - own)
        before = np.concatenate([[0.0], gain[:-1]])
        # A lower floor for each later text restarts the running minimum there.
        floor = doc * (2.0 * WORD_CAP * (sizes.max(initial=1) + 1) + 1.0)
        base = before[first[:-1][live]] if live.any() else np.zeros(0)
        start = np.zeros(n_docs)
        start[live] = base
        low = np.minimum.accumulate((before - start[doc]) - floor) + floor
        rise = (gain - start[doc]) - low
        worst = np.zeros(n_docs)
        np.maximum.at(worst, doc, rise)
        ok &= worst <= SWITCH_PENALTY
    return ok


def label_batch(texts: pa.Array, model: LanguageModel) -> list[tuple]:
    """(lang, score, spans) of each text; spans are (first word, words, lang,
    character of the first word where it begins)."""
    n, k = len(texts), len(model.langs)
    if not k:
        return [("und", 0.0, [])] * n
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    first = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
    first = first - first[0]
    idx = coded.indices.to_numpy(zero_copy_only=False)
    tokens = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    word = np.arange(len(idx)) - np.repeat(first[:-1], np.diff(first))
    char = np.zeros(len(tokens), dtype=np.int64)
    cut = {i: own for i, t in enumerate(tokens) if len(t) > PIECE_LETTERS or not t.isascii()
           if len(own := token_pieces(t)) > 1}
    if cut:  # from words to pieces: of each its word in the text and its place in it
        every = [cut.get(i) or ((0, t),) for i, t in enumerate(tokens)]
        tokens = [p for own in every for _, p in own]
        size = np.array([len(own) for own in every], dtype=np.int64)
        char = np.array([c for own in every for c, _ in own], dtype=np.int64)
        begin, count = np.cumsum(size) - size, size[idx]
        place = np.concatenate([[0], np.cumsum(count)])
        word = np.repeat(word, count)
        idx = np.repeat(begin[idx] - place[:-1], count) + np.arange(place[-1])
        first = place[first]
    letters_of, scores_of = model.words(tokens)
    letters, scores = letters_of[idx], scores_of[idx]
    sums = np.zeros((n, k))
    total = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(np.diff(first) > 0)
    if len(live):
        sums[live] = np.add.reduceat(scores, first[:-1][live], axis=0, dtype=np.float64)
        total[live] = np.add.reduceat(letters, first[:-1][live])
    best = sums.argmax(axis=1)
    flat = np.flatnonzero(~sums.any(axis=1))
    best[flat] = int(np.argmax(model.docs))
    plain = _unswitched(scores, first, best)
    mixed = np.flatnonzero(~plain & (total > 0))
    paths = dict(zip(mixed.tolist(), viterbi(scores, first[:-1][mixed], first[1:][mixed],
                                             SWITCH_PENALTY), strict=True))
    out = []
    for i in range(n):
        if not total[i]:
            out.append(("und", 0.0, []))
            continue
        a, b = first[i], first[i + 1]
        if plain[i]:
            share, win, spans = 1.0, int(best[i]), [(0, int(word[b - 1]) + 1, model.langs[best[i]], 0)]
        else:
            path = paths[i]
            mass = np.bincount(path, weights=letters[a:b], minlength=k)
            win = int(mass.argmax())
            share = float(mass[win] / total[i])
            cut = np.flatnonzero(np.diff(path)) + 1
            ends = [0, *cut.tolist(), int(b - a)]
            spans = [(int(word[a + p]), int(word[a + q - 1] - word[a + p]) + 1,
                      model.langs[path[p]], int(char[idx[a + p]]))
                     for p, q in zip(ends, ends[1:], strict=False)]
        if not sums[i].any():
            out.append((model.langs[win], 1.0 / k, spans))
            continue
        rest = np.delete(sums[i], win)
        margin = float(sums[i, win] - rest.max()) if len(rest) else 30.0
        sure = 1.0 if not plain[i] else 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))
        out.append((model.langs[win], share * sure, spans))
    return out


def train_languages(docs: DataFrame) -> LanguageModel:
    """Learn from (text, lang) rows. The rows are thinned by a hash of doc_id to
    about ``FIT_PER_LANG`` of each language; counts are summed in Spark."""
    small_batches(docs.sparkSession, BATCH_ROWS)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one short row for each language, which the model has to have anyway
    sizes = {r["lang"]: r["n"] for r in
             docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {}, {}, [])
    million = 1_000_000
    share = docs.sparkSession.createDataFrame(
        [(x, min(million, math.ceil(million * FIT_PER_LANG / sizes[x]))) for x in langs],
        "lang string, share int")
    sample = (docs.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(million)).alias("draw"))
              .join(F.broadcast(share), "lang").where(F.col("draw") < F.col("share"))
              .select("lang", "text"))

    def count(batches):
        for b in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(),
                                  strict=True):
                c = by.setdefault(lang, Counter())
                for w, n in Counter(_NOT_LETTERS.sub(" ", text.lower()).split()).items():
                    for _, piece in pieces(w):
                        for g in grams(piece):
                            c[g] += n
                        c["script " + piece.script] += n
                        c["words"] += n
            rows = [(lang, g, n) for lang, c in by.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])

    counted = saved(sample.mapInArrow(count, "lang string, gram string, n long")
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    is_script = F.col("gram").startswith("script ") | (F.col("gram") == "words")
    scripts: dict[str, list[bool]] = {}
    about = {(r["lang"], r["gram"]): r["n"] for r in counted.where(is_script).collect()}
    for name in {g for _, g in about if g != "words"}:
        scripts[name[7:]] = [about.get((x, name), 0) > SCRIPT_SHARE * max(1, about.get((x, "words"), 0))
                             for x in langs]
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    own = max(LANG_GRAMS, MODEL_GRAMS // len(langs))
    grams_only = counted.where(~is_script)
    chosen = (grams_only.withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= own).select("gram").distinct())
    rows = grams_only.join(chosen, "gram").toPandas().sort_values(["gram", "lang"])
    names = sorted(rows["gram"].unique())
    table = np.zeros((len(names), len(langs)), dtype=np.int64)
    table[np.searchsorted(np.array(names, dtype=object), rows["gram"].to_numpy()),
          np.searchsorted(np.array(langs, dtype=object), rows["lang"].to_numpy())] = rows["n"]
    return LanguageModel(langs, dict(zip(names, table.tolist(), strict=True)), scripts,
                         [sizes[s] for s in langs])


def label_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and the labelled spans of every row."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of languages

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        span = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()),
                                   ("lang", pa.string()), ("first_char", pa.int32())]))
        for b in batches:
            got = label_batch(b.column("text"), m)
            spans = [[{"first_word": p, "n_words": q, "lang": s, "first_char": c}
                      for p, q, s, c in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array(spans, span)],
                ["doc_id", "lang_pred", "score", "spans"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        label, "doc_id long, lang_pred string, score double, "
               "spans array<struct<first_word:int,n_words:int,lang:string,first_char:int>>"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return label_languages(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")
