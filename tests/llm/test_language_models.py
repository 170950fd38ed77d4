"""Language identification: many languages, rare ones, and its parts by hand."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from skyroll.llm import langid
from skyroll.llm.langid import LanguageModel, Piece, grams, pieces, train_languages, viterbi


def words_of(seed, letters, n=40):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(n)]


def corpus(spark, langs, docs, seed=0):
    """``docs`` texts of each language (or a number by language), of its own words."""
    r, rows = random.Random(seed), []
    for lang, own in langs.items():
        for _ in range(docs[lang] if isinstance(docs, dict) else docs):
            rows.append((len(rows), " ".join(r.choice(own) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_three_hundred_languages(spark):
    langs = {f"l{i:03d}": words_of(i, r) for i in range(300)
             for r in ["".join(random.Random(i).sample("abcdefghijklmnopqrstuvwxyz", 12))]}
    model = train_languages(corpus(spark, langs, 4))
    assert model.langs == sorted(langs)
    texts = [" ".join(langs[x][:25]) for x in model.langs]
    got = langid.label_batch(pa.array(texts), model)
    assert sum(g[0] == x for g, x in zip(got, model.langs)) >= 295


def test_a_rare_language_among_common_ones(spark):
    langs = {"aa": words_of(1, "abcdefgh"), "bb": words_of(2, "hijklmnop"),
             "rare": words_of(3, "βγδεζηθικ")[:20] + words_of(4, "qrstuvwxyz")[:20]}
    model = train_languages(corpus(spark, langs, {"aa": 900, "bb": 900, "rare": 3}))
    texts = [" ".join(langs["rare"][20:]), " ".join(langs["rare"][:20]), " ".join(langs["aa"])]
    assert [g[0] for g in langid.label_batch(pa.array(texts), model)] == ["rare", "rare", "aa"]
    assert model.scripts["greek"] == [False, False, True]


def test_scores_against_a_plain_loop():
    r = random.Random(7)
    alphabet = "abcdeé漢字ßя"
    tokens = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(300)]
    tokens += ["x" * 60, "12", "", "a1b", "don't"]
    counts = {}
    for t in tokens[:150]:
        for _, p in pieces("".join(c for c in t if c.isalpha())):
            for g in grams(p):
                counts.setdefault(g, [r.randint(0, 5) for _ in range(3)])
    scripts = {"latin": [True, True, False], "han": [False, True, True], "cyrillic": [False] * 3}
    model = LanguageModel(["x", "y", "z"], counts, scripts, [1, 1, 1])
    total = [sum(c[k] for c in counts.values()) + 0.5 * (len(counts) + 1) for k in range(3)]

    def by_hand(token):
        word = "".join(c for c in token if c.isalpha())
        piece = token if isinstance(token, Piece) else next((p for _, p in pieces(word)), None)
        if piece is None or not any(scripts.get(piece.script, [])):
            return 0 if piece is None else piece.letters, [0.0] * 3
        sums = [sum(math.log((counts[g][k] + 0.5) / total[k]) for g in grams(piece) if g in counts)
                for k in range(3)]
        best = max(s for s, ok in zip(sums, scripts[piece.script]) if ok)
        return piece.letters, [max(s - best, -langid.WORD_CAP) if ok else -langid.WORD_CAP
                               for s, ok in zip(sums, scripts[piece.script])]

    letters, scores = model.words(tokens)
    for token, n, s in zip(tokens, letters, scores):
        want = by_hand(token)
        assert n == want[0] and np.allclose(s, want[1], atol=1e-4), token


def test_viterbi_against_all_paths():
    r = np.random.default_rng(3)
    sizes = [0, 1, 6, 3, 5, 1, 6]
    scores = r.normal(scale=3, size=(sum(sizes), 3))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    got = viterbi(scores, starts, ends, 2.0)
    for a, b, path in zip(starts, ends, got):
        rows = scores[a:b]

        def worth(p):
            return sum(rows[i][x] for i, x in enumerate(p)) - 2.0 * sum(
                x != y for x, y in zip(p, p[1:]))

        best = max(map(worth, itertools.product(range(3), repeat=b - a)))
        assert len(path) == b - a and math.isclose(worth(path), best, abs_tol=1e-9)


def test_no_languages_and_no_grams(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.label_batch(pa.array(["a b", None]), train_languages(none)) == [("und", 0.0, [])] * 2
    bare = train_languages(spark.createDataFrame([(1, "1 2 3", "en")], none.schema))
    assert [g[0] for g in langid.label_batch(pa.array(["word", ""]), bare)] == ["en", "und"]
