"""The pipeline's verdicts hold for rows: null and repeated doc_ids."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from llm_cases import EDGE_ROWS, brute_components, frame
from skyroll.llm import decontamination, quality

SF = "/root/testdata/sf0.001"


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def prose(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_quality_stage_judges_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = quality.score_quality(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = next(texts[r.doc_id] for r in verdict if r.predicted)
    bad = next(texts[r.doc_id] for r in verdict if not r.predicted)
    # The ids of these rows have no label, so the model stays the same.
    rows = [(None, good), (None, bad), (1 << 40, good), (1 << 40, bad)]
    more = frame(spark, rows).select(*docs.columns)
    got = pipeline.quality_stage(spark, docs.unionByName(more), SF)
    assert pipeline.ROW in got.columns
    here = {k: n for k, n in kept(got).items() if k[0] is None or k[0] == 1 << 40}
    assert here == {(None, good): 1, (1 << 40, good): 1}
    assert sum(kept(got).values()) == sum(r.predicted for r in verdict) + 2


def test_exact_stage_judges_rows(spark):
    a, b, c, d = map(prose, "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, c), (6, c), (7, d), (7, c), (None, d)]
    got = kept(pipeline.exact_stage(spark, frame(spark, rows), SF))
    assert got == Counter([(None, a), (None, b), (5, c), (7, d)])


def test_near_stage_judges_rows(spark):
    a, b, c, d = map(prose, "abcd")
    rows = [(None, a), (None, b), (None, b + " tail"), (5, c), (5, c), (7, c + " tail"), (7, d),
            (None, d), (8, ""), (None, None)]
    got = kept(pipeline.near_stage(spark, frame(spark, rows), SF))
    got_b = {t for i, t in got if i is None and t and t.startswith("b0")}
    assert len(got_b) == 1 and got_b <= {b, b + " tail"}
    assert got == Counter([(None, a), (None, got_b.pop()), (5, c), (7, d), (8, ""), (None, None)])


def test_decontamination_stage_judges_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, prose("a")), (None, f"x y z. {item}"), (5, prose("c")), (5, f"u v w. {item}")]
    got = kept(pipeline.decontamination_stage(spark, frame(spark, rows), SF))
    assert got == Counter([(None, prose("a")), (5, prose("c"))])


STAGES = dict(pipeline.STAGES)
FILTERS = [n for n in STAGES if n != "best-fit packing"]


@pytest.mark.parametrize("name", FILTERS)
def test_a_clashing_row_column_decides_nothing(spark, name):
    rows = [(i, prose(x)) for i, x in enumerate("abcdef")]
    docs = frame(spark, rows)
    plain = set(kept(STAGES[name](spark, docs, SF)))
    # the same number in every row, nulls, and another type
    for value in (F.lit(7).cast("long"), F.lit(None).cast("long"), F.lit("x")):
        got = STAGES[name](spark, docs.withColumn(pipeline.ROW, value), SF)
        assert set(kept(got)) == plain
        assert {r[pipeline.ROW] for r in got.collect()} <= {7, None, "x"}


@pytest.mark.parametrize("name", STAGES)
def test_an_empty_table_gives_no_rows(spark, name, none):
    assert STAGES[name](spark, none, SF).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_long_and_odd_texts(spark, name, edge):
    got = STAGES[name](spark, edge, SF).collect()
    if name in ("benchmark decontamination", "best-fit packing"):
        assert len({r.doc_id for r in got}) == len({i for i, _ in EDGE_ROWS})
    assert {r.doc_id for r in got} <= {i for i, _ in EDGE_ROWS}


def test_packing_stage_places_every_id(spark):
    rows = [(1, "one two"), (2, None), (3, " ".join(f"n{i}" for i in range(3000))), (3, "again")]
    got = pipeline.packing_stage(spark, frame(spark, rows), SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_the_whole_against_plain_python(spark):
    """Every decision again, text by text: the model's scores, equal texts, all pairs
    of shingle sets, and word runs of the benchmark items."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [r.doc_id for r in quality.score_quality(docs, model).collect() if r.predicted]
    best = {}
    for i in sorted(left):
        key = re.sub(r"[\x20\x09-\x0d]", "", texts[i] or "")
        if key not in best or len(texts[i] or "") > len(texts[best[key]] or ""):
            best[key] = i
    left = sorted(best.values())
    left = sorted({c for _, _, c in brute_components([(i, texts[i]) for i in left])})
    items = [" ".join(re.findall(r"\w+", r.text.lower()))
             for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {i: " ".join(re.findall(r"\w+", (texts[i] or "").lower())) for i in left}
    dirty = {i for i in left if any(x and f" {x} " in f" {plain[i]} " for x in items)}
    got = pipeline.run(spark, SF)
    packed = {r.doc_id for r in got.collect()}
    assert packed <= set(left) - dirty
    # beyond whole items word by word, the stage also finds items with some words replaced
    more = set(left) - dirty - packed
    found = decontamination.contaminated(docs.where(F.col("doc_id").isin(sorted(more) or [-1])),
                                         spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in found.collect()} == more
