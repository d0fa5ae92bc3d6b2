"""Whole texts to ids with a tokenizers file, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array

import regex

# Parts of texts and words remembered per Python worker; bounds on memory only (about
# 250 MB), results never depend on them.
PARTS, WORDS = 600_000, 800_000
LONG_WORD = 64

# The words of a byte-level pre-tokenizer, and the letters that stand for
# bytes in its vocabulary (visible Latin-1 characters for themselves, the others in
# order from U+0100).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _SEEN} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_SEEN}))}
# Characters whose classes are the same in every version of Unicode; others are left to
# the library's own pre-tokenizer.
_SETTLED = re.compile("[\t-\r -~\u00a1-\u052f]*").fullmatch

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, added: bool = False) -> "Encoder":
    """The encoder of a file, loaded once per Python worker."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


class _Memory(dict):
    """A dict that makes missing values and keeps a bounded number of them."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.missed = make, size, 0

    def __missing__(self, key: str):
        value = self.make(key)
        self.missed += 1
        if self.missed > 5 * self.size:  # the words in use have changed
            self.clear()
            self.missed = 0
        if len(self) < self.size and len(key) <= LONG_WORD:
            self[key] = value
        return value


class Encoder:
    """Byte-level BPE with the library's model, word by word.

    A text is cut only before a blank that a non-blank follows. There the
    pre-tokenizer always starts a new word (its words hold one blank at most, in
    front), and merges never cross words; so the ids of the parts, one after the
    other, are the ids of the whole text. With `added`, a text that holds the string of
    a token added to the vocabulary (special or not) goes through the library's own
    encode, as it stands; without, such strings are text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        kind = repr(whole.pre_tokenizer)
        if whole.normalizer is not None or "ByteLevel" not in kind or "add_prefix_space=False" not in kind or "use_regex=True" not in kind:
            raise ValueError(f"not a byte-level vocabulary without a normalizer: {path}")
        self._split, self._model = whole.pre_tokenizer.pre_tokenize_str, whole.model
        self._words = _Memory(self._word, WORDS)
        self._parts = _Memory(self._part, PARTS)
        self.size = whole.get_vocab_size()
        self._whole = whole
        self._added = [t.content for t in whole.get_added_tokens_decoder().values()] if added else []

    def _letters(self, letters: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        return self._letters(word.encode().decode("latin-1").translate(_LETTERS))

    def _part(self, part: str) -> bytes:
        """A part and the blank before it."""
        if _SETTLED(part):
            # A plain word is remembered once, as a part.
            if part.isalpha():
                return self._word(" " + part)
            if part[-1] in ".,;:!?" and part[:-1].isalpha():
                return self._parts[part[:-1]] + self._words[part[-1]]
        return self._encode(" " + part)

    def _encode(self, text: str) -> bytes:
        if _SETTLED(text):
            return b"".join([self._words[w] for w in _WORDS(text)])
        return b"".join([self._letters(letters) for letters, _ in self._split(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is an empty text."""
        if not text:
            return b""
        if any(a in text for a in self._added):
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        if text[-1] == " " or re.search(r" \s", text):
            first, *rest = re.split(r" (?=\S)", text)
        else:
            first, *rest = text.split(" ")
        return (self._encode(first) if first else b"") + b"".join(map(self._parts.__getitem__, rest))
