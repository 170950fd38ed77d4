"""Whole-text tokenisation inside Arrow batches.

Words repeat, so the tokenizer's model sees each distinct word of a worker
once. A text is cut where the tokenizer's own pre-tokenisation cuts in any
case, so the ids are those of the whole text:

- byte-level vocabulary: before white space that follows a character other than
  white space; before the last character of white space that is followed by a
  surely other one, and after it unless it is a blank, which the pattern keeps
  with what comes after it; and where ASCII letters, digits and signs meet,
  save after an apostrophe (which may begin a contraction).
- word vocabulary (white space dropped): at every ASCII white space, and where
  an ASCII letter or one of U+00C0 to U+00FF and an ASCII sign other than the
  apostrophe (which may begin a contraction) meet. Its lower-casing of those
  letters is done on the bytes of all texts at once, save before a character
  that could combine with the letter.

New pieces of the byte-level vocabulary are joined, so that the whole tokenizer
cuts between them again, and encoded in a few calls; a token stands for a known
number of bytes, which tells whose it is. Within a piece of the word vocabulary,
a run of letters with plain punctuation after it is exactly two pre-tokens, which
the library's BPE model encodes directly; every other piece goes through the
whole tokenizer, and so does every text with the literal of an added token.
"""

from __future__ import annotations

import os
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

WORD_CACHE = 250_000     # pieces of a generation of a worker's cache
JOINED = 1 << 16         # characters of new pieces that are encoded at a time


def _byte_letters() -> dict[int, str]:
    """The byte-to-letter map of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = {k: v for k, v in _byte_letters().items() if chr(k) != v}
# Kinds of bytes: ASCII letters, ASCII signs without the apostrophe.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
_LATIN = 0xC3            # leads the two bytes of U+00C0 to U+00FF
_NO_LETTERS = (0x97, 0xB7)  # what follows it in the signs among them
# Kinds of bytes for the byte-level vocabulary, and what two neighbours tell.
# A lead byte is one of a character beyond ASCII that is no white space.
_OTHER, _ALPHA, _DIGIT, _MARK, _QUOTE, _BLANK, _SPACE, _HIGH, _LEAD = range(9)
_KIND = np.array([
    _LEAD if b > 0xC2 and b not in (0xE1, 0xE2, 0xE3) else _HIGH if b > 127 else _BLANK if b == 32 else _SPACE if 9 <= b <= 13 else _QUOTE if b == 39
    else _ALPHA if chr(b).isalpha() else _DIGIT if chr(b).isdigit()
    else _MARK if 33 <= b < 127 else _OTHER for b in range(256)], dtype=np.uint8)
_CUT, _CUT_BEFORE, _CUT_UNSURE = 1, 2, 4  # between them, before both, perhaps between


def _neighbours() -> np.ndarray:
    out = np.zeros((16, 16), dtype=np.uint8)
    solid = (_ALPHA, _DIGIT, _MARK, _QUOTE)
    out[_BLANK, [*solid, _LEAD]] = _CUT_BEFORE
    out[_SPACE, [*solid, _LEAD]] = _CUT | _CUT_BEFORE
    for a in solid:
        out[a, [_BLANK, _SPACE]] = _CUT
        for b in solid:
            if a != b and (a, b) not in ((_MARK, _QUOTE), (_QUOTE, _MARK), (_QUOTE, _ALPHA)):
                out[a, b] = _CUT
    out[_HIGH, [_BLANK, _SPACE]] = _CUT_UNSURE
    return out.reshape(-1)


_NEIGHBOURS = _neighbours()


def _latin_letters(data: np.ndarray) -> np.ndarray:
    """Places of the first bytes of letters from U+00C0 to U+00FF."""
    lead = np.flatnonzero(data[:-1] == _LATIN)
    return lead[~np.isin(data[lead + 1], _NO_LETTERS)]


def _lowered(data: np.ndarray) -> np.ndarray:
    """``data`` with A-Z and U+00C0 to U+00DE in lower case, where the next
    character is ASCII or one of those, so none that combines with the letter."""
    low = data.copy()
    plain = np.append((data[1:] < 0x80) | (data[1:] == _LATIN), True)
    low[(data >= 65) & (data <= 90) & plain] += 32
    second = _latin_letters(data) + 1
    low[second[(data[second] < 0x9F) & plain[second]]] += 32
    return low


class PieceEncoder:
    """Encodes a column of texts; ``keep_blanks`` tells the two vocabularies apart.

    The cache has two generations of at most ``WORD_CACHE`` pieces: what was
    not met again while the young one filled up is dropped.
    """

    def __init__(self, path: str, keep_blanks: bool):
        self.keep_blanks = keep_blanks
        self.tokenizer = Tokenizer.from_str(Path(path).read_text(encoding="utf-8"))
        self.literals = sorted({t.content for t in
                                self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model
        if keep_blanks:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks
            last = max(self.tokenizer.get_vocab().values())
            self.n_bytes = np.zeros(last + 1, dtype=np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.n_bytes[i] = len(token)  # a letter stands for a byte
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of one pre-token of letters."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run without white space."""
        got = self.young.get(run)
        if got is None:
            got = self.old.get(run)
            if got is None:
                core = run.rstrip(".,;:!?")
                if not core.isalpha() or not core.isascii():
                    got = self._whole(run)
                elif len(core) < len(run):
                    got = self._run(core) + self._run_of_signs(run[len(core):])
                else:
                    got = self._letters(run.lower())
            self.young[run] = got
        return got

    def _run_of_signs(self, signs: str) -> bytes:
        got = self.young.get(signs)
        if got is None:
            got = self.young[signs] = self._whole(signs)
        return got

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. All end with a character other than white space and begin
        with one, or with a blank and one; those without the blank are led by a line end."""
        led = [p if p[0] == " " else "\n" + p for p in pieces]
        text = "".join(led)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                       dtype=np.uint32)
        stops = np.cumsum([len(p.encode("utf-8")) for p in led])
        ends = np.cumsum(self.n_bytes[ids])
        # A byte that the vocabulary lacks, or the literal of an added token across pieces.
        if len(ids) == 0 or ends[-1] != stops[-1] or any(x in text for x in self.literals):
            return [self._whole(p) for p in pieces]
        to = np.searchsorted(ends, stops, side="right")
        lead = np.array([p[0] != " " for p in pieces])
        begin, raw = np.concatenate([[0], to[:-1]]) + lead, ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(begin.tolist(), to.tolist(), strict=True)]

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of these pieces, none of which is in the cache."""
        if not self.keep_blanks:
            return [self._piece(p) for p in pieces]
        got: list[bytes | None] = [None] * len(pieces)
        joined = [i for i, p in enumerate(pieces)
                  if (core := p.strip()) and p[p[0] == " ":] == core]
        held = np.cumsum([len(pieces[i]) for i in joined], dtype=np.int64) // JOINED
        for part in np.split(np.array(joined, dtype=np.int64), np.flatnonzero(np.diff(held)) + 1):
            here = part.tolist()
            for i, x in zip(here, self._joined([pieces[i] for i in here]), strict=True):
                got[i] = x
        return [self._whole(p) if x is None else x for p, x in zip(pieces, got, strict=True)]

    def _piece(self, piece: str) -> bytes:
        word = piece.strip(" \t\n\x0b\x0c\r")
        if word.isalpha() and max(word) <= "\xff":
            return self._letters(word.lower())
        return self._run(word) if word else b""

    def _pieces(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in ``data`` where a piece begins, for texts that end at ``ends``."""
        texts = ends[:-1][np.diff(ends) > 0]
        if self.keep_blanks:
            kind = _KIND[data]
            tells = _NEIGHBOURS[(kind[:-1] << 4) | kind[1:]]
            tells[texts[texts > 0] - 1] = 0
            cut = np.zeros(len(data) + 1, dtype=bool)
            cut[1:-1] = tells & _CUT
            cut[:-2] |= (tells & _CUT_BEFORE) > 0
            # Not (to be safe) after bytes that may end a white-space character beyond ASCII.
            unsure = np.flatnonzero(tells & _CUT_UNSURE)
            prior = data[np.maximum(unsure - 1, 0)]
            cut[unsure + 1] = (prior != 0xC2) & (prior != 0x80) & (prior != 0x81) & (prior != 0x9A)
            cut[texts] = True
            return np.flatnonzero(cut)
        letter, sign = _LETTER[data], _SIGN[data]
        begins, ends_letter = letter.copy(), letter
        latin = _latin_letters(data)
        begins[latin], ends_letter[latin + 1] = True, True
        cut = (data == 32) | ((data >= 9) & (data <= 13))
        cut[1:] |= (ends_letter[:-1] & sign[1:]) | (sign[:-1] & begins[1:])
        starts = np.sort(np.concatenate([texts, np.flatnonzero(cut)]), kind="stable")
        return starts[np.diff(starts, prepend=-1) > 0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls are empty) and where each text's ids begin."""
        texts = texts.fill_null("")
        special = np.zeros(len(texts), dtype=bool)
        for literal in self.literals:
            special |= pc.match_substring(texts, literal, ignore_case=True).to_numpy(
                zero_copy_only=False)
        if not special.any():
            return self._encode(texts)
        ids, at = self._encode(pc.if_else(pa.array(special), pa.scalar("", texts.type), texts))
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(special).tolist():
            parts[i] = np.frombuffer(self._whole(texts[i].as_py()), np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without nulls and literals of added tokens."""
        if len(self.young) > WORD_CACHE:
            self.young, self.old = {}, self.young
        n = len(texts)
        wide = pa.types.is_large_string(texts.type)
        raw = texts.buffers()
        if not n or raw[2] is None:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        ends = np.frombuffer(raw[1], np.int64 if wide else np.int32)
        ends = ends[texts.offset:texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        if not self.keep_blanks:
            data = _lowered(data)
        starts = self._pieces(data, ends)
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)),
            pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        idx = coded.indices.to_numpy(zero_copy_only=False)
        words, young, new = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.young, []
        distinct = list(map(young.get, words))
        for i, got in enumerate(distinct):
            if got is None:
                got = distinct[i] = self.old.get(words[i])
                if got is None:
                    new.append(i)
                else:
                    young[words[i]] = got
        for i, got in zip(new, self._new([words[i] for i in new]), strict=True):
            distinct[i] = young[words[i]] = got
        pool = np.frombuffer(b"".join(distinct), np.uint32)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        at = np.cumsum(sizes) - sizes
        size = sizes[idx]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(at[idx] - place[:-1], size) + np.arange(place[-1])]
        return ids, place[np.searchsorted(starts, ends, side="left")]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keep_blanks: bool) -> PieceEncoder:
    """The worker's encoder; kept from task to task with its cache."""
    key = (path, keep_blanks)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keep_blanks)
    return _ENCODERS[key]
