"""Hashing of words and their shingles."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from .common import kept

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


#: Bytes of a text whose words are hashed at once.
_PIECE = 1 << 21
#: Words whose hashes a process remembers for each key, and the longest of them.
_KNOWN_WORDS, _KNOWN_BYTES = 300_000, 64
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _known(key: bytes) -> dict[bytes, int]:
    # each run has a key of its own, so an earlier run's hashes are of no use to anyone
    return kept(("words", key), key, dict)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text is cut between words."""
    at = 0
    while len(text) - at > _PIECE and (gap := _GAP.search(text, at + _PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def word_hashes(texts: list[bytes], key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z folded) of all texts, and the number of words in each.

    64 bits of BLAKE2b under ``key``: whoever doesn't know the key can't make two words that share a hash.
    """
    known, blake = _known(key), hashlib.blake2b
    out, per_text = [np.zeros(0, U)], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            words = piece.lower().split()
            got = [*map(known.get, words)]
            if None in got:
                for k, v in enumerate(got):
                    if v is None:
                        w = words[k]
                        v = known.get(w)
                        if v is None:
                            v = int.from_bytes(blake(w, digest_size=8, key=key).digest(), "little")
                            if len(w) <= _KNOWN_BYTES and len(known) < _KNOWN_WORDS:
                                known[w] = v
                        got[k] = v
            out.append(np.array(got, U))
            per_text[i] += len(words)
    return np.concatenate(out), per_text


def shingle_sets(texts: list[bytes], words: int, key: bytes = b"") -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``words`` words; the whole text as one with fewer; none without words."""
    h, per_text = word_hashes(texts, key)
    out, at = [], 0
    for n in per_text:
        w = h[at : at + n]
        at += n
        if n == 0:
            out.append(w)
            continue
        k = min(words, int(n))
        # a shorter text's only shingle must not equal a full one of another text
        s = np.full(n - k + 1, U(k), U)
        for j in range(k):
            s = mix(s * U(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j])
        out.append(np.unique(s))
    return out
