"""Profiles of shingle sets never rule out a pair that links."""

import numpy as np
import pyarrow as pa

from llm_cases import frame
from skyroll.llm import jaccard_join


def may_link(pairs):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(pairs)), pa.int64()), pa.array(range(len(pairs)), pa.int64()),
         pa.array([len(a) for a, _ in pairs], pa.int32()), pa.array([len(b) for _, b in pairs], pa.int32()),
         pa.array([jaccard_join.profile(a) for a, _ in pairs], pa.binary()),
         pa.array([jaccard_join.profile(b) for _, b in pairs], pa.binary())],
        ["a", "b", "n_a", "n_b", "profile_a", "profile_b"])
    (out,) = jaccard_join._may_link(iter([batch]))
    return set(out.column("a").to_pylist())


def test_pairs_that_link_always_pass():
    rng = np.random.default_rng(1)
    pairs = []
    for n in (1, 2, 7, 60, 500, 5000, 200_000):
        for share in (0.76, 0.9, 1.0):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, int(n * (1 / share - 1)), dtype=np.uint64)
            cut = len(rest) // 2
            pairs.append((np.concatenate([both, rest[:cut]]), np.concatenate([both, rest[cut:]])))
    assert may_link(pairs) == set(range(len(pairs)))


def test_unlike_sets_of_usual_sizes_are_ruled_out():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64))
             for n in (20, 100, 1000, 3000)]
    assert may_link(pairs) == set()


def test_texts_that_are_shuffled_give_the_same(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i % 9] + ["x"] + base[i % 9 + 1:])) for i in range(40)]
    rows += [(100 + i, f"other {i} words of its own here") for i in range(10)]
    want = sorted(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard_join, "IDS_SENT", 0)
    got = sorted(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect()))
    assert got == want and len({r[2] for r in got}) < len(rows)
