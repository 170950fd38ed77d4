"""Decontamination finds literal copies of numbers and of common words."""

from llm_cases import frame
from skyroll.llm import decontamination


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def pairs(spark, docs, items):
    return sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(
        frame(spark, docs), bench(spark, items)).collect())


def test_numbers_are_words(spark):
    items = ["12 + 7 = 19; 88 - 3 = 85", "12 + 7 = 19; 44 * 2 = 88; 90 + 1 = 91", "+ - * /"]
    docs = [(1, f"see {items[0]} there"), (2, f"and {items[1]}"), (3, "71 + 5 = 76; 10 - 3 = 7"),
            (4, "+ - * /")]
    assert pairs(spark, docs, items) == [(1, 0), (2, 1)]


def test_widely_copied_item_among_rare_words(spark):
    """The item's words are in nearly every document and so weigh almost nothing."""
    item = " ".join(f"common{k}" for k in range(33))
    docs = [(i, item) for i in range(60)]
    rare = [" ".join(f"r{d}x{k}" for k in range(300)) for d in range(3)]
    docs += [(100 + d, f"{t} {item} {t[::-1]}") for d, t in enumerate(rare)] + [(200, rare[0])]
    assert pairs(spark, docs, [item]) == [(i, 0) for i, t in docs if i != 200]
