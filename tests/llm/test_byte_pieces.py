"""Byte pieces: the ids of whole texts, with few calls of the library for new pieces."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from skyroll.llm import tokens
from skyroll.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"aZestSTlvdr'',.;-$(<|0123   \t\n\n\r\x0b\x0c\x00\x1c\x1f\x7f", "'s", "'re", "  ",
           *"éÉßþ×²½́\x85\xa0   ​   　᠎漢字😀п٣’…“"]


class Counted:
    """Counts the calls of an object's methods."""

    def __init__(self, of, calls: list):
        self._of, self._calls = of, calls

    def __getattr__(self, name):
        f = getattr(self._of, name)
        return lambda *a, **k: self._calls.append(name) or f(*a, **k)


@pytest.mark.parametrize("joined", [1, 40, 1 << 16])
def test_ids_are_those_of_the_whole_text(monkeypatch, joined):
    monkeypatch.setattr(tokens, "JOINED", joined)
    enc, pick = PieceEncoder(PATH, keep_blanks=True), random.Random(joined)
    texts = ["".join(pick.choices(LETTERS, k=pick.randint(0, 14))) for _ in range(10_000)]
    texts += ["<|endoftext|>x", "don't  'tis\n\n  x\n y \n", "a\n", "\nb", " ", "c ", "", None]
    for part in (texts, texts[::-1]):
        ids, at = enc.encode(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            want = enc.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids[at[i]:at[i + 1]].tolist() == want, repr(text)


def test_new_words_take_few_calls():
    pick, calls = random.Random(5), []
    words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyzéß", k=9)) for _ in range(3000)]
    texts = [f"{a} ({b}), {a}! {b}\n{a.title()} {i}:" for i, (a, b) in
             enumerate(zip(words, words[1:], strict=False))]
    enc = PieceEncoder(PATH, keep_blanks=True)
    plain = enc.tokenizer
    enc.tokenizer, enc.model = Counted(plain, calls), Counted(enc.model, calls)
    ids, at = enc.encode(pa.array(texts))
    assert len(calls) < 60
    for i in range(0, len(texts), 50):
        assert ids[at[i]:at[i + 1]].tolist() == plain.encode(texts[i], add_special_tokens=False).ids


def test_signs_and_line_ends_are_pieces_of_their_own():
    enc = PieceEncoder(PATH, keep_blanks=True)
    enc.encode(pa.array(["a house, a house. a house! (house) house\nhouse\n\nhouse 7house's house"]))
    assert sorted(p for p in enc.young if "house" in p) == [" house", "house"]
