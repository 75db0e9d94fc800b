"""Token ids of whole texts, with a memo of blank-delimited words.

Most public word and byte-pair tokenizers never join across ASCII blanks and give blanks
no ids, so the ids of a text are those of its blank-delimited words in a row.  ``WordIds``
checks this for its tokenizer when it is made; where it holds, every distinct word is
encoded once by the tokenizers library and then looked up, once for a run of texts, whose
ids are gathered as arrays; else whole texts are encoded.

Words of plain Latin letters with punctuation after them need no normalizing beyond lower
case: their letters and their punctuation go to the library's model one by one, if the
same check shows that this gives equal ids.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PROBES = ["a", "The", "é", "x1", "7", "!!", "...", "'s", "'", "́o", "ß,", "<|endoftext|>", "日本", " ", "#$", "Σ"]
BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n "]


#: Letters whose lower case and composed form are their own, each one character.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#]*)")
PLAIN_PROBES = ["The", "tion.", "ÉAU,", "ñandú!!", "a|", "Straße", "ÿÝ***", "x#$%&", "THEDNT!!", "for;:", "über?"]


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level tokenizers use for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """A dict that fills itself by a function."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordIds:
    """``encode(texts)`` gives, per UTF-8 text, its ids as little-endian unsigned 32-bit bytes.

    ``most_words`` and ``most_parts`` bound the known words and parts between runs; what is
    full is emptied, which costs time only.
    """

    def __init__(self, path: str, most_words: int = 250_000, most_parts: int = 50_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.most_words, self.most_parts = most_words, most_parts
        self.parts = _Memo(self._part)
        self._forget()
        self.by_words = self._splits_at_blanks()
        self.by_parts = False
        self.by_parts = self.by_words and all(self._parts_of(p) == self._packed(self._ids(p)) for p in PLAIN_PROBES)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _splits_at_blanks(self) -> bool:
        alone = {p: self._ids(p) for p in PROBES}
        return all(
            self._ids(f"{blank}{a}{blank}{b}{blank}") == alone[a] + alone[b]
            for blank in BLANKS
            for i, a in enumerate(PROBES)
            for b in (PROBES[i - 1], PROBES[i], PROBES[(i + 3) % len(PROBES)])
        )

    def _part(self, part: str) -> bytes:
        """Ids of letters in lower case, or of punctuation, from the model alone."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part)])

    def _parts_of(self, text: str) -> bytes | None:
        if not (m := PLAIN.fullmatch(text)):
            return None
        return self.parts[m[1].lower()] + (self.parts[m[2]] if m[2] else b"")

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        got = self._parts_of(text) if self.by_parts else None
        return self._packed(self._ids(text)) if got is None else got

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [self._packed(e.ids) for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))  # at the six ASCII blanks
        coded = words.flatten().dictionary_encode()
        places = self._places(coded.dictionary.view(pa.binary()))
        return list(_gathered(self.pool, self.begins, places[coded.indices.to_numpy()], words.offsets.to_numpy()))

    def _forget(self) -> None:
        self.known, self.pool, self.begins = pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each word lies among the known ones; those that were not known are encoded and added."""
        if len(self.known) > self.most_words:
            self._forget()
        found = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(found.is_null())
        places = found.fill_null(-1).to_numpy().copy()
        places[places < 0] = np.arange(len(self.known), len(self.known) + len(new))
        ids = list(map(self._word, new.to_pylist()))
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        self.known = pa.concat_arrays([self.known, new])
        self.begins = np.append(self.begins, self.begins[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        return places


def _gathered(pool: np.ndarray, begins: np.ndarray, codes: np.ndarray, offsets: np.ndarray, most: int = 1 << 18):
    """Bytes of each text's ids.

    ``pool`` has the ids of all codes in a row, ``begins`` where each code's begin and the
    last one's end, ``offsets`` where each text's codes begin and the last one's end.

    At most ``most`` codes are gathered at a time, so that a very long text needs no larger arrays.
    """
    ends, text, pieces = offsets[1:], 0, []
    for first in range(0, len(codes), most):
        some = codes[first : first + most]
        sizes = begins[some + 1] - begins[some]
        upto = np.cumsum(sizes)
        data = pool[np.repeat(begins[some] - upto + sizes, sizes) + np.arange(upto[-1])].tobytes()
        upto, last = np.append(0, upto), 0
        while text < len(ends) and ends[text] <= first + len(some):
            at = 4 * int(upto[max(ends[text] - first, 0)])
            pieces.append(data[last:at])
            yield b"".join(pieces)
            text, last, pieces = text + 1, at, []
        pieces.append(data[last:])
    for _ in range(text, len(ends)):
        yield b"".join(pieces)
        pieces = []


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One ``WordIds`` a Python worker and file, kept between tasks."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
