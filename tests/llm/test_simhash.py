"""SimHash near-duplicates against all pairs of fingerprints."""

import random
import re

import numpy as np
import xxhash

from llm_cases import EDGE_ROWS, frame
from skyroll.llm import simhash
from skyroll.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_hand(fps):
    """The smallest index of each fingerprint's component, by all pairs."""
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        after = np.array([label[row].min() for row in near])
        if (after == label).all():
            return label
        label = after


def components_of(spark, fps, group):
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    found = {r.node: r.component for r in components(simhash.links(distinct, group)).collect()}
    return fps, [found.get(f, f) for f in signed]


def same_parts(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def families(seed):
    """Random fingerprints, chains of small steps, and families that agree in a whole
    half, so that signatures are refined round by round."""
    r, out = random.Random(seed), []
    for _ in range(200):
        out.append(r.getrandbits(64))
    for _ in range(40):
        at = r.getrandbits(64)
        for _ in range(6):
            for b in r.sample(range(64), r.randint(1, 5)):
                at ^= 1 << b
            out.append(at)
    for low, width in ((0, 32), (32, 32), (0, 8), (56, 8), (16, 16), (28, 8)):
        base = r.getrandbits(64)
        out += [base & ~(((1 << width) - 1) << low) | r.getrandbits(width) << low for _ in range(200)]
    return out


def test_components_of_families(spark):
    for seed, group in ((1, 4096), (2, 4), (3, 16)):
        fps, got = components_of(spark, families(seed), group)
        assert same_parts(got, by_hand(fps)), (seed, group)


def test_every_pair_of_up_to_three_bits_meets(spark):
    r = random.Random(5)
    pairs = []
    for bits in (1, 2, 3, 4):
        for _ in range(150):
            a = r.getrandbits(64)
            b = a
            for at in r.sample(range(64), bits):
                b ^= 1 << at
            pairs.append((a, b, bits))
    for group in (4096, 1):
        fps, got = components_of(spark, [x for a, b, _ in pairs for x in (a, b)], group)
        part = dict(zip(fps, got))
        assert all((part[a] == part[b]) == (bits <= 3) for a, b, bits in pairs)


def test_rows_against_by_hand(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = EDGE_ROWS + [(1000 - i, base.replace(f"w{7 * i} ", "other ")) for i in range(50)]
    rows += [(2000 + i, base) for i in range(300)] + [(11, "One TWO"), (12, "one\ttwo")]
    got = simhash.simhash_components(frame(spark, rows)).collect()
    marks = [mark(t) for _, t in rows]
    smallest = {}
    part = by_hand(marks)
    for (i, _), p in zip(rows, part):
        if i is not None:
            smallest[p] = min(smallest.get(p, i), i)
    want = sorted(((i, f"{m:016x}", smallest.get(p)) for (i, _), m, p in zip(rows, marks, part)),
                  key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    marks = [mark(r.text) for r in docs]
    part = by_hand(marks)
    smallest = {}
    for r, p in zip(docs, part):
        smallest[p] = min(smallest.get(p, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{m:016x}", smallest[p]) for r, m, p in zip(docs, marks, part))
    got = simhash.op13_simhash_near_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_empty_table(spark, none):
    assert simhash.simhash_components(none).collect() == []
