"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from llm_cases import EDGE_ROWS, LONG, brute_components, frame, shingles  # noqa: I001
from skyroll.llm import (binary_output, decontamination, exact_dedup, jaccard_join, langid,
                         packing, quality, toxicity)

SF = "/root/testdata/sf0.001"
HELD = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(y, s):
    y, s = np.array(y), np.array(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


# 1 best-fit packing

def packed(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from skyroll.llm.common import saved
    return packing.pack(saved(packing.pieces(docs, path), "pieces")).collect()


def check_packing(got, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], dtype="<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for off, n in sorted(parts):
            assert off == end
            end += n
        assert end <= 2048
    return len(seqs)


def test_packing_edges(spark, edge, none):
    check_packing(packed(spark, edge), EDGE_ROWS)
    assert packed(spark, none) == []


def test_packing_is_tight(spark):
    docs = table(spark, "documents")
    got = packed(spark, docs)
    made = check_packing(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert made <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1


@pytest.mark.parametrize("lengths", [[6] * 70, [9] * 60 + [1] * 3, [6, 7, 8] * 20 + [2, 3] * 4])
def test_packing_ends_where_pieces_fill_no_sequence(spark, lengths):
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    got = packing.pack(rows, capacity=10, group_pieces=20).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 10


def test_sum_of_squares_choice_is_the_minimum():
    rng = np.random.default_rng(3)
    lengths, cap = rng.integers(1, 20, 300), 20
    where, _ = packing.sum_of_squares(lengths, cap)
    gaps = {}
    for s, b in zip(lengths.tolist(), where.tolist(), strict=True):
        def cost(change):
            n = Counter(g for g in {**gaps, **change}.values() if g)
            return sum(v * v for v in n.values())
        options = [cost({k: g - s}) for k, g in gaps.items() if g >= s] + [cost({-1: cap - s})]
        chosen = cost({b: gaps[b] - s}) if b in gaps else cost({-1: cap - s})
        assert chosen == min(options)
        gaps[b] = gaps.get(b, cap) - s


# 4 Jaccard join

def jaccard(docs):
    return sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).select(
        "doc_id", "n_shingles", "component_id").collect())


def test_jaccard_matches_brute_force(spark):
    docs = table(spark, "documents")
    assert jaccard(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_on_families_and_thresholds(spark):
    """Families of edited copies whose links chain, and pairs on both sides of 0.75."""
    rng = np.random.default_rng(5)
    rows, passage = [], [f"common{k}" for k in range(25)]
    for fam in range(6):
        base = [f"f{fam}w{k}" for k in range(60)] + passage
        for _ in range(25):
            t = list(base)
            for k in rng.integers(0, len(t), rng.integers(0, 5)):
                t[k] = f"e{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(t)))
            base = t if rng.random() < 0.3 else base
    for n in range(20, 60):
        words = [f"p{n}x{k}" for k in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-(n // 5)]))]
    assert jaccard(frame(spark, rows)) == brute_components(rows)


def test_jaccard_edges(spark, edge, none):
    got = jaccard_join.jaccard_components(edge).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE_ROWS)
    assert [by[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0]
    assert by[3].component_id == 3 and by[5].component_id == 4 and by[8].component_id == 7
    assert by[None].component_id is None
    assert jaccard_join.jaccard_components(none).collect() == []


# 5 toxicity, 10 quality, 8 language: held-out rows and edges

@pytest.mark.parametrize("run, column, least", [
    (toxicity.op5_toxicity, "toxic", 0.8), (quality.op10_quality_rank, "quality", 0.95)])
def test_held_out_labels(spark, run, column, least):
    """Toxic: 6 held-out toxic rows only, of which the texts of two look clean."""
    got = run(spark, HELD).join(table(spark, "labels", HELD), "doc_id").where("held_out").collect()
    assert auc([r[column] for r in got], [r.score for r in got]) >= least
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_folding_and_exceptions():
    model = toxicity.ToxicModel({" badword ": 5.0}, frozenset(), (-3.0, 1.0, 0.0, 0.0), True)
    assert model.score("a b4dw0rd here") == model.score("a badword here")
    assert model.score("a bаdwоrd here") == model.score("a badword here")   # Cyrillic a, o
    assert model.score("a badword here") > model.score("a good one here")
    spared = toxicity.ToxicModel({" badword ": 5.0}, frozenset({"no badword"}),
                                 (-3.0, 1.0, 0.0, 0.0), True)
    assert spared.facts("no badword")[0] == 0


def test_scores_on_edges(spark, edge, none):
    labels = table(spark, "labels")
    docs = table(spark, "documents")
    tox, rank = toxicity.train_toxicity(docs, labels), quality.train_quality(docs, labels)
    for score, model in ((toxicity.score_toxicity, tox), (quality.score_quality, rank)):
        got = score(edge, model).collect()
        assert len(got) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in got)
        assert score(none, model).collect() == []
    assert quality.train_quality(docs, labels.limit(0)) is None
    untrained = quality.score_quality(edge, None).collect()
    assert {r.score for r in untrained} == {quality.NO_MODEL_SCORE}
    empty = toxicity.train_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(edge, empty).collect()} == {0.0}


def test_language_held_out_and_edges(spark, edge, none):
    docs = table(spark, "documents", HELD)
    got = (langid.op8_language_id(spark, HELD).join(docs.select("doc_id", "lang", "text"), "doc_id")
           .where("held_out AND lang IS NOT NULL AND length(text) > 40").collect())
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    model = langid.train_languages(docs)
    by = {r.doc_id: r for r in langid.label_languages(edge, model).collect()}
    assert len(by) == len({i for i, _ in EDGE_ROWS})
    assert [by[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4
    assert langid.label_languages(none, model).collect() == []


# 6 exact dedup

def test_dedup_against_brute_force_and_second_batch(spark, edge, none):
    index = exact_dedup.DigestIndex(spark)
    got = index.ingest(edge).collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in EDGE_ROWS:
        groups[hashlib.sha256(key(t).encode()).hexdigest()].append(
            (-len(t or ""), i is None, i))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, min(g)[2], len(g), h) for h, g in groups.items() for _, _, i in g)
    assert sum(r.kept for r in got) == len(groups)
    again = index.ingest(frame(spark, [(50, "onetwothree"[:6] + " three"), (51, "fresh")])).collect()
    verdict = {r.doc_id: (r.keep_id, r.kept) for r in again}
    assert verdict == {50: (4, False), 51: (51, True)}
    assert index.ingest(none).collect() == []


# 7 benchmark decontamination

def test_decontamination(spark, edge, none):
    docs = table(spark, "documents")
    bench = table(spark, "benchmark")
    pairs = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    flat = lambda t: " ".join((t or "").lower().split())
    for r in docs.collect():
        for item, text in items:
            if len(flat(text).split()) >= 8 and flat(text) in flat(r.text):
                assert (r.doc_id, item) in pairs
    planted = [(900 + k, f"opening line here. {t} and a closing one") for k, (_, t) in
               enumerate(items[:5])] + [(990, "entirely other words that no item has at all")]
    found = {(r.doc_id, r.item_id)
             for r in decontamination.contaminated(frame(spark, planted), bench).collect()}
    assert {(900 + k, items[k][0]) for k in range(5)} <= found
    assert 990 not in {d for d, _ in found}
    assert decontamination.contaminated(none, bench).collect() == []
    assert decontamination.contaminated(edge, bench.limit(0)).collect() == []


def test_lcs_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, 20).astype(np.uint64), rng.integers(0, 6, 30).tolist()
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            prev = list(row)
            for j, y in enumerate(b, 1):
                row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
        assert decontamination.lcs(decontamination._masks(a), len(a), b) == row[-1]


# 9 binary output

def test_binary_round_trip(spark, edge, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    binary_output.write_ids(edge, str(tmp_path / "a"), path)
    got = binary_output.read_ids(spark, str(tmp_path / "a")).collect()
    want = Counter()
    for i, t in EDGE_ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    end = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    binary_output.write_ids(none, str(tmp_path / "b"), path)
    assert binary_output.read_ids(spark, str(tmp_path / "b")).collect() == []


def test_random_access_inside_a_segment():
    rng = np.random.default_rng(4)
    ids = np.where(rng.random(5000) < 0.05, rng.integers(0, 1 << 31, 5000),
                   rng.integers(0, 900, 5000)).astype(np.uint32)
    seg = binary_output.Segment(memoryview(binary_output.segment([1], np.array([5000]), ids)))
    for a, b in ((0, 5000), (255, 257), (700, 701), (4999, 5000)):
        assert np.array_equal(seg.ids(a, b), ids[a:b])


def test_long_text_is_whole(spark):
    row = jaccard_join.jaccard_components(frame(spark, [(1, LONG)])).collect()[0]
    assert row.n_shingles == len(shingles(LONG))
