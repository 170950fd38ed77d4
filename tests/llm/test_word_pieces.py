"""Word pieces: the ids of whole texts, with few pieces left to the whole tokenizer."""

import random

import public_tokenizers
import pyarrow as pa

from skyroll.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"aZeEsS'tT,.;-_$^`<>=|0123 \t\n\r\x0b", *"éÉßÿÞþ×÷µªºÀÑñ",
           *"̸̱́̈  ẖİıΣς漢😀ǅͅ·½²"]


def test_ids_are_those_of_the_whole_text():
    enc, pick = PieceEncoder(PATH, keep_blanks=False), random.Random(3)
    texts = ["".join(pick.choices(LETTERS, k=pick.randint(0, 14))) for _ in range(20_000)]
    texts += ["<|ENDOFTEXT|>x", "H̱", "Ấ", "a'S b'll.", "ΑΣ,", "", None]
    ids, at = enc.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = enc.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i]:at[i + 1]].tolist() == want, repr(text)


def test_forms_of_a_word_are_one_piece():
    enc, whole = PieceEncoder(PATH, keep_blanks=False), []
    plain = enc._whole
    enc._whole = lambda text: whole.append(text) or plain(text)
    enc.encode(pa.array(["x Été ÉTÉ, été*** (Été) \tété. Haus HAUS; haus&&& haus-haus"]))
    assert all(not text.strip(" .,;*&()-") for text in whole)
    assert len([p for p in enc.young if p.strip() in ("été", "haus")]) <= 5
