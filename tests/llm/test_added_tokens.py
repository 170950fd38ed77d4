"""Texts with the literal of an added token have the ids of a plain tokenizer call."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from skyroll.llm.tokens import PieceEncoder


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens(name, blanks):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    texts = ["plain text", None, "", "a <|endoftext|> b"]
    for t in tok.get_added_tokens_decoder().values():
        texts += [f"a {t.content} b", f"x{t.content}{t.content}y  z", t.content.upper(), t.content[:-1]]
    for part in (texts, texts[:3], texts[3:4]):
        for kind in (pa.string(), pa.large_string()):
            ids, at = PieceEncoder(path, blanks).encode(pa.array(part, kind))
            got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in part]
            assert ids.dtype == np.uint32
