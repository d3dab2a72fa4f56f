"""Exact use of the two ``tokenizers`` files, word by word.

A corpus repeats its words far more often than its texts, so each Python worker keeps the tokens of
words it has met (up to ``CACHE_WORDS``; beyond that they are encoded again, never dropped).  Cutting a text
in front of a run of ASCII white space never changes the tokens, as long as the text has no other
white space and no special string; the remaining texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np

from .common import kept

CACHE_WORDS = 250_000
#: White space beyond ASCII, separators that Python and the tokenizers class differently, or the start of a special string.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0  -     　]|<\\|")
#: A stop or comma right behind another sign: the two are one piece and must not be cut apart.
_IN_RUN = re.compile(r"[.,](?<![^\W_][.,])(?<!\s[.,])")
_RUNS = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: A word of letters that fold and compose to themselves in every Unicode version (Latin, without the dotted capital I), then other ASCII signs but apostrophes.
_PLAIN = re.compile(r"""( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([!"#$%&(-/:-@[-`{-~]*)""")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


def version(path: str) -> str:
    """Digest of the tokenizer file: counts made with one file are never taken for another's."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordTokenizer:
    """``ids(text)`` and ``count(text)`` as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        # a file that drops white space and folds case (end-of-word merges), or one that keeps both
        self.drops_space = self.library.normalizer is not None
        self.known: dict = {}
        self.stems: dict[str, array] = {}

    def _piece(self, piece: str) -> array:
        """The merges of one piece that holds no cut."""
        if not piece.isascii():
            piece = "".join(map(_BYTE_LETTERS.__getitem__, piece.encode()))
        elif piece[0] == " ":
            piece = _BYTE_LETTERS[0x20] + piece[1:]
        return array("I", [t.id for t in self.model.tokenize(piece)])

    def _encode(self, word: str) -> array:
        m = _PLAIN.fullmatch(word)
        if not m:
            return array("I", self.library.encode(word, add_special_tokens=False).ids)
        space, letters, signs = m.groups()
        letters = letters.lower() if self.drops_space else space + letters
        ids = self.stems.get(letters)
        if ids is None:
            ids = self._piece(letters)
            if len(self.stems) < CACHE_WORDS // 3:
                self.stems[letters] = ids
        return ids + self._piece(signs) if signs else ids

    def _words(self, text: str) -> list[str] | None:
        latin = text.isascii()
        if latin:
            if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return None
        elif _UNUSUAL.search(text):
            return None
        if not self.drops_space:
            return _RUNS.findall(text)
        if not latin:
            try:
                text.encode("latin-1")
                latin = True
            except UnicodeEncodeError:
                pass
        if latin:
            # the tokenizer folds case itself, and Latin-1 letters fold one to one; a stop or comma
            # that no other sign precedes or follows is a piece of its own with or without a blank
            text = text.lower()
            if not _IN_RUN.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def _known(self, words: list[str], value) -> list:
        """What is known of each word; unknown words are encoded, and kept while there is room."""
        known = self.known
        out = list(map(known.get, words))
        at = -1
        while True:
            try:
                at = out.index(None, at + 1)
            except ValueError:
                return out
            word = words[at]
            got = known.get(word)
            if got is None:
                got = value(self._encode(word))
                if len(known) < CACHE_WORDS:
                    known[word] = got
            out[at] = got

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self._words(text)
        if words is None:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self._known(words, array.tobytes))

    def count(self, text: str) -> int:
        words = self._words(text)
        if words is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(self._known(words, len))


def tokenizer(path: str, purpose: str) -> WordTokenizer:
    """One tokenizer per worker process and purpose (ids and counts keep different caches)."""
    return kept("tokenizer", (path, purpose), lambda: WordTokenizer(path))
