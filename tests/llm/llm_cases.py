"""Rows and plain checks that the tests of the training-data operators share."""

import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, "
          "token string, n string, label string, digest string, component_id string")


def frame(spark, rows):
    """A documents table of (doc_id, text) rows whose extra columns have names
    that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "x", "x", "x", "x")
                                  for i, t in rows], SCHEMA)


LONG = " ".join(f"wordy{i % 9000} plain" for i in range(30_000))
EDGE_ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "One  two three"),
             (6, "a b c d e f g h i j k l m n o p"), (6, "a b c d e f g h i j k l m n o p"),
             (7, LONG), (8, LONG + " tail"), (None, "no id at all here, a text without its id"),
             (9, "12345 !!! 678"), (10, "Ünïcode 漢字 😀 текст")]


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in rows)
