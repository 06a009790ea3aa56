"""Token ids of whole texts with a public word-BPE vocabulary.

The vocabulary's own pre-tokenizer cuts a text into words that hold no white space, and a word's ids
depend on the word alone. So a text of simple characters is lower-cased and cut into words at once.
Each worker keeps the ids of words it has seen, in a young and an old generation of at most ``CACHE``
each: what is seen again moves to the young one, and when that is full the old one goes. Only unknown
words go through the tokenizer's merge model.
"""

from __future__ import annotations

import re
import struct

CACHE = 100_000
#: The vocabulary's split pattern, written for Python's ``re`` and lower-cased SIMPLE text.
SPLIT = re.compile("[a-z\xdf-\xf6\xf8-\u017f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|(?:[^\\s\\w]|_)+")
#: ASCII and letters of the Latin blocks below U+0180 with one-to-one lower case: here Python's character
#: classes and the tokenizer's are the same, and every text is in normal form C. Anything else goes to
#: the tokenizer whole.
SIMPLE = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*+")
#: White space to Python's split, not to the tokenizer.
ASCII_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Seen(dict):
    """Ids by key; ``make`` gives those of an unknown key. At most two generations of ``CACHE`` keys are kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(key)
        self[key] = ids = self.make(key) if ids is None else ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TokenIds:
    """ids(text) -> little-endian unsigned 32-bit ids as bytes; equal to the tokenizer's own encode()."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these go to the tokenizer whole: it turns its special literals into one
        #: id wherever they stand.
        self.whole = (*ASCII_SEPARATORS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.model = self.tokenizer.model
        self.letters = str.maketrans(_byte_letters())
        #: Words of simple chunks, and whole chunks of other characters.
        self.words, self.chunks = _Seen(self._word), _Seen(self._whole)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1")
        return _packed([t.id for t in self.model.tokenize(spelled.translate(self.letters))])

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        if any(mark in text for mark in self.whole):
            return self._whole(text)
        if SIMPLE.fullmatch(text):
            return self._simple(text)
        return b"".join(self._simple(c) if SIMPLE.fullmatch(c) else self.chunks[c] for c in text.split())
