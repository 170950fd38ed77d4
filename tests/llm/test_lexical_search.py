"""Ranked lexical search against scores of every document, one by one."""

import math
import re
from collections import Counter

import duckdb

from llm_cases import EDGE_ROWS, frame
from skyroll.llm import lexical_search

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def by_hand(docs, items, top=20):
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, length = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        asked, found = Counter(words(text)), []
        for i, b in bags:
            tf, m = Counter(b), 100 - 25 + 25 * len(b) * count // length
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                        * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, q in asked.items()
                        if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])
                                                                  [:top], start=1)]
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items],
                                 "item_id long, text string, term string, n int")


# a group of copies larger than any top list, copies by another order of words, ties
DOCS = (EDGE_ROWS + [(100 - i, "the hot copy, THE copy") for i in range(60)]
        + [(200 + i, "copy the copy hot the") for i in range(5)]
        + [(300 + i, f"text {i} one two plain") for i in range(50)]
        + [(None, "the hot copy, the copy"), (None, "no id one"), (7, "again seven one")])
ITEMS = [(1, "The hot-copy"), (2, "one two two three"), (2, "plain text"), (3, None), (4, ""),
         (5, "absent words only"), (6, "漢字 ünïcode 123 12345"), (7, "Ünïcode"), (None, "one")]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()),
                  key=str)


def test_against_scores_by_hand(spark):
    docs, items = frame(spark, DOCS), benchmark(spark, ITEMS)
    want = by_hand(DOCS, ITEMS)
    assert rows_of(lexical_search.ranked(docs, items)) == want
    # words that meet the documents in a join, and items in many blocks
    assert rows_of(lexical_search.ranked(docs, items, vocabulary=2, postings=3)) == want


def test_small_chunks_give_the_same(spark, monkeypatch):
    docs, items = frame(spark, DOCS), benchmark(spark, ITEMS)
    monkeypatch.setattr(lexical_search, "CELLS", 5)
    assert rows_of(lexical_search.ranked(docs, items, top=3)) == by_hand(DOCS, ITEMS, 3)


def test_one_class_for_equal_bags(spark):
    docs = frame(spark, DOCS)
    vocabulary = spark.createDataFrame([("hot", 0), ("copy", 1), ("the", 2)], "term string, id long")
    found = lexical_search.bags(docs, vocabulary)
    grouped = lexical_search.classes(found.selectExpr("*", "75L AS m"), top=20).collect()
    hot = [r for r in grouped if r.ids == [0, 1, 2]]
    assert len({r["class"] for r in hot}) == 1 and len(hot) == 20
    assert [r.doc_id for r in sorted(hot, key=lambda r: r.member)] == list(range(41, 61))


def test_empty_tables(spark, none):
    some = benchmark(spark, ITEMS)
    assert lexical_search.ranked(none, some).collect() == []
    assert lexical_search.ranked(frame(spark, DOCS), benchmark(spark, [])).collect() == []
    assert lexical_search.ranked(frame(spark, [(1, None), (2, " . ")]), some).collect() == []


def test_small_tables_match_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["documents", "benchmark"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(lexical_search.ORACLE_OP12).fetchall()
    got = lexical_search.op12_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
