"""Phrase collocations against counts of all sequences, one by one."""

import random
import re
from collections import Counter

import duckdb
import pytest

from llm_cases import EDGE_ROWS
from skyroll.llm import collocations
from skyroll.llm.common import saved

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
        yield re.findall(r"[^\x20\x09]+", piece)


def by_hand(rows, longest, least, shadow, top):
    """rows of (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in pieces(text):
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i:i + size])] += 1
    found = {}
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, g), a in cand.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                if 100 * a >= shadow * cand[lang, g[i:i + size]]:
                    hidden.add((lang, g[i:i + size]))
    for (lang, g), a in cand.items():
        if (lang, g) in hidden:
            continue
        score, k = min((10**6 * a * a // (counts[lang, g[:k]] * counts[lang, g[k:]]), k)
                       for k in range(1, len(g)))
        found.setdefault(lang, []).append(
            (-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    return {(lang, i, p.decode(), -a, x, r, totals[lang], -s)
            for lang, all_ in found.items()
            for i, (s, a, p, x, r) in enumerate(sorted(all_)[:top], start=1)}


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "key", "w") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, key string, tail string")


# a long passage repeated (one unary path of many blocks), a cycle of three words, a
# language with a blank and a tab in its name, pieces of one and two words
PASSAGE = " ".join(f"p{i}" for i in range(700))
ROWS = ([("en", f"Start {PASSAGE} end.")] * 12 + [("fr", "a b c " * 30)] * 2
        + [(None, "x Y, x y; x y: z"), ("de at\tx", "eins zwei drei vier")] * 11
        + [("en", "one two"), ("en", "one"), ("en", "\x00 \x1c odd  word p1 p2 p3"),
           ("en", None), ("en", "")] * 5)


def rows_of(df):
    return {(r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


# words sent to the tasks as ids, and edges counted as texts
@pytest.mark.parametrize("longest,words_sent", [(2, 10**6), (2, 0), (3, 10**6), (3, 0), (4, 10**6),
                                                (4, 0)])
def test_against_counts_by_hand(spark, longest, words_sent):
    got = rows_of(collocations.collocations(table(spark, ROWS), longest, 10, top=300,
                                            words_sent=words_sent))
    assert got == by_hand(ROWS, longest, 10, 50, 300)


def test_rare_words_beside_frequent_ones(spark):
    r = random.Random(3)
    few, many = [f"f{i}" for i in range(8)], [f"r{i}" for i in range(400)]
    rows = [(r.choice(["en", "de"]), " ".join(
        r.choice(few) if r.random() < 0.8 else r.choice(many) for _ in range(r.randint(0, 40)))
        .replace(" f7 ", r.choice([" f7. ", " f7 "]))) for _ in range(300)]
    want = by_hand(rows, 4, 10, 50, 2000)
    for words_sent in (10**6, 0):
        got = rows_of(collocations.collocations(table(spark, rows), 4, 10, words_sent=words_sent))
        assert got == want


def test_many_small_tallies_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(collocations, "IDS_AT_ONCE", 50)
    monkeypatch.setattr(collocations, "TALLY", 20)
    want = by_hand(ROWS, 3, 10, 50, 300)
    for words_sent in (10**6, 0):
        got = collocations.collocations(table(spark, ROWS), top=300, words_sent=words_sent)
        assert rows_of(got) == want


def test_edge_rows_and_empty_table(spark, edge, none):
    rows = [("en", t) for _, t in EDGE_ROWS] * 3
    got = rows_of(collocations.collocations(edge.unionAll(edge).unionAll(edge), least=3))
    assert got == by_hand(rows, 3, 3, 50, 2000)
    assert collocations.collocations(none).collect() == []


def test_paths_hold_every_frequent_edge_once(spark):
    net = collocations.graph(table(spark, ROWS), 3, 10)
    paths = saved(collocations.unary_paths(net, 10, 3), "test-paths")
    whole = collocations.path_counts(paths).where("NOT inner")
    got = Counter({r.key: r.n for r in whole.collect()})
    want = {f"{r.key} {r.tail}": r.w for r in net.where("tail IS NOT NULL").collect()}
    assert dict(got) == want and whole.count() == len(want)
    # the passage is a few rows, not one for each edge
    assert paths.where("key LIKE 'en\\tp%' OR key LIKE 'en\\tstart%'").count() <= 5


def test_counts_beyond_64_bits(spark):
    # a * a * 1,000,000 passes 2^63 from a = 3,037,001 on
    a, left, right = 4_000_000_000, 5_000_000_000, 7_000_000_000
    got = spark.sql(f"SELECT (CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)) * 1000000BD) "
                    f"div (CAST({left} AS DECIMAL(15,0)) * CAST({right} AS DECIMAL(15,0)))").first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_small_tables_match_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(collocations.ORACLE_OP11).fetchall()
    got = collocations.op11_phrase_collocations(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
