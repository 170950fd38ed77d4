"""What a task holds for the texts of a batch is bounded by bytes, not by rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from skyroll.llm import jaccard_join
from skyroll.llm.common import by_bytes


def test_slices_hold_so_many_bytes_or_one_row():
    texts = ["ab", None, "", "abcdef", "é" * 9, "x", "yz", "w"]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    got = [s.column("text").to_pylist() for s in by_bytes([b, b.slice(0, 0), b.slice(5)], 4)]
    assert got == [["ab", None, ""], ["abcdef"], ["é" * 9], ["x", "yz", "w"], ["x", "yz", "w"]]


def test_hashes_do_not_depend_on_where_they_are_cut(monkeypatch):
    texts = pa.array([None, "", " one TWO\tone", "twO", "é" * 50 + " two", "  ", "last one "])
    whole, at = jaccard_join.word_hashes(texts)
    assert whole[0] == whole[2] == whole[7] and whole[1] == whole[3] == whole[5]
    for n in (1, 4, 9, 30):
        monkeypatch.setattr(jaccard_join, "HASHED_AT_ONCE", n)
        h, cut = jaccard_join.word_hashes(texts)
        assert np.array_equal(h, whole) and np.array_equal(cut, at)


def test_memory_of_hashing_stays_near_that_of_the_texts():
    texts = pa.array(["words of some text " * 1000] * 600)      # 11.4 MB
    tracemalloc.start()
    jaccard_join.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * texts.nbytes
