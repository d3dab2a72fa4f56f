"""Periodic runs of words: maximal stretches that repeat one period, found from Lyndon words.

Under each of the two orders of the words (one the reverse of the other), a stack scanned from right
to left gives the longest Lyndon word that starts at every place: a place's word ends where the next
smaller suffix starts.  Every run has such a word as its root under one of the orders, within its
first period.  A root is extended to both sides, and the run it lies in follows.

Suffixes are compared, and roots extended, by their longest common extension: binary search over
rolling hashes, after which the words themselves are compared.  Along a run the extensions of one
distance follow from each other and only the words between them are compared.

The scan runs on the stretches of a text in which runs can lie.  In a run that is long enough,
every few words in a row stand in it once more, one period away; a place where they don't, or only
farther away than a run of the stretch could have its period, ends a stretch.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytehash import U, mix
from .common import mapped, named

_PRIME = (1 << 61) - 1
_BASE = random.Random(12).randrange(1 << 32, _PRIME)
#: Words compared one by one before hashes are asked.
_DIRECT = 8
#: Rounds in which stretches are cut; more would cut more, and change no result.
_ROUNDS = 12


def window(min_length: int, min_exponent: int) -> int:
    """The most words in a row, up to four, that any long enough run holds twice wherever they stand in it; 0 if there is none."""
    # words t..t+k-1 of a run of L words stand in it again one period q before or behind if L >= 2q + k
    return max(0, min([4, *(max(min_length, min_exponent * q) - 2 * q for q in range(1, min_length + 2))]))


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """The parts [start, end) of a text that can hold runs; each run lies in one of them."""
    n, k = len(ids), window(min_length, min_exponent)
    if n < min_length:
        return []
    if k == 0:
        return [(0, n)]
    m = n - k + 1
    h = ids[:m].astype(U)
    for j in range(1, k):
        h = h * U(0x9E3779B97F4A7C15) + ids[j : j + m].astype(U) + U(1)
    h = mix(h)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    far = np.int64(n) * min_exponent + 1
    step = np.where(same, order[1:] - order[:-1], far)
    gap = np.full(m, far)
    gap[order[1:]] = step
    gap[order[:-1]] = np.minimum(gap[order[:-1]], step)
    alive = gap * min_exponent <= n
    for _ in range(_ROUNDS):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2] + k - 1
        length = np.repeat(ends - starts, edge[1::2] - starts)
        at = np.flatnonzero(alive)
        bad = (gap[at] * min_exponent > length) | (length < min_length)
        if not bad.any():
            break
        alive[at[bad]] = False
    return [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= min_length]


class Extensions:
    """Longest common extensions of two places of a sequence of words, in both directions."""

    def __init__(self, words: np.ndarray):
        self.raw = words.astype("<u4").tobytes()
        self.words = words.tolist()
        self.n = len(self.words)
        self.hash = [*accumulate(self.words, lambda h, w: (h * _BASE + w + 1) % _PRIME, initial=0)]
        self.power = [*accumulate(range(self.n), lambda p, _: p * _BASE % _PRIME, initial=1)]
        self.last: dict[int, tuple[int, int]] = {}

    def equal(self, i: int, j: int, n: int) -> bool:
        """The words themselves."""
        return self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]

    def _same(self, i: int, j: int, n: int) -> bool:
        h, p = self.hash, self.power[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % _PRIME == 0

    def _search(self, most: int, same) -> int:
        """The greatest number of words, up to ``most``, for which ``same`` holds."""
        low, step = 0, _DIRECT
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if same(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def forward(self, i: int, j: int) -> int:
        """The number of equal words from i < j on.  Places are asked for from right to left."""
        w, n = self.words, self.n
        if j >= n or w[i] != w[j]:
            return 0
        d = j - i
        known = self.last.get(d)
        most = n - j
        if known and (gap := known[0] - i) <= most and self.equal(i, j, gap):
            found = gap + known[1]
        else:
            found = 1
            while found < _DIRECT and found < most and w[i + found] == w[j + found]:
                found += 1
            if found == _DIRECT < most:
                found = self._search(most, lambda k: self._same(i, j, k))
                if not self.equal(i, j, found):
                    # two different strings of one hash
                    found = self._search(most, lambda k: self.equal(i, j, k))
        self.last[d] = (i, found)
        return found

    def backward(self, i: int, j: int) -> int:
        """The number of equal words before i and j > i."""
        found = self._search(i, lambda k: self._same(i - k, j - k, k))
        return found if self.equal(i - found, j - found, found) else self._search(i, lambda k: self.equal(i - k, j - k, k))


def runs_in(words: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of one stretch."""
    ext = Extensions(words)
    n, w, forward = ext.n, ext.words, ext.forward
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for reverse in (False, True):
        ext.last.clear()
        smaller = [n] * n
        for i in range(n - 1, -1, -1):
            j, reach = i + 1, 0
            while j < n:
                a, b = w[i], w[j]
                if a != b:
                    reach = 0
                    if (a < b) == reverse:
                        break
                else:
                    reach = forward(i, j)
                    # the end is the least word of the one order and the greatest of the other
                    end = j + reach == n
                    if (not reverse) if end else (w[i + reach] < w[j + reach]) == reverse:
                        break
                j = smaller[j]
            smaller[i] = j
            p = j - i
            # the root within a run's first period is followed by all but two periods of it at least
            if j < n and reach > (min_exponent - 2) * p and (p, j + reach) not in found:
                start = i - ext.backward(i, j)
                found[p, j + reach] = (start, j + reach - start, p)
    return {r for r in found.values() if r[1] >= max(min_length, min_exponent * r[2])}


def find_runs(ids: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs of a text by start, then period; ids are numbers of its words."""
    found: set[tuple[int, int, int]] = set()
    for s, e in stretches(ids, min_length, min_exponent):
        found |= {(s + a, length, p) for a, length, p in runs_in(ids[s:e], min_length, min_exponent)}
    for a, length, p in found:
        z = a + length
        if not (np.array_equal(ids[a : z - p], ids[a + p : z]) and (a == 0 or ids[a - 1] != ids[a - 1 + p]) and (z == len(ids) or ids[z] != ids[z - p])):
            raise AssertionError(f"no run: start {a}, length {length}, period {p}")
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equals the first, then the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _of_text(text: str | None, min_length: int, min_exponent: int) -> tuple[int, list[tuple[int, int, int]], str]:
    """(words, runs, the words outside the repeats of runs)."""
    # exactly the bytes 0x20 and 0x09 to 0x0D separate words
    words = (text or "").encode().split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = find_runs(ids, min_length, min_exponent)
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            cover[start + period] += 1
            cover[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return len(ids), runs, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_words, runs, strongest, kept``.

    ``runs``: all stretches of consecutive words with smallest period q, of at least ``min_length``
    words and ``min_exponent`` periods (2 at least), that no neighbouring word extends, as structs
    ``start, length, period`` by start, then period.  ``strongest`` is the run of the greatest
    length / period (ties: least start, then period; null without runs).  ``kept``: the words that
    no run contains behind its first period, joined by one blank.  Words are runs of characters
    other than 0x20 and 0x09 to 0x0D, compared as they are.

    Null and empty texts have no words: no runs, ``kept`` empty.  Repeated rows and null ids are rows
    of their own; columns of other names don't matter; an empty table gives an empty result.  Texts
    are read whole, each in one task, with memory in proportion to its length.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    rows = named(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType
    arrow_id, run = to_arrow_type(id_type), pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def cells(r: tuple[int, int, int] | None) -> dict | None:
        return r and dict(zip(("start", "length", "period"), r, strict=True))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_of_text(t, min_length, min_exponent) for t in b.column(1).to_pylist()]
            columns = [
                b.column(0).cast(arrow_id),
                pa.array([n for n, _, _ in out], pa.int64()),
                pa.array([[cells(r) for r in runs] for _, runs, _ in out], pa.list_(run)),
                pa.array([cells(strongest(runs)) for _, runs, _ in out], run),
                pa.array([kept for _, _, kept in out], pa.string()),
            ]
            yield pa.record_batch(columns, names=["id", "n_words", "runs", "strongest", "kept"])

    kind = "struct<start: long, length: long, period: long>"
    return mapped(rows, of_batches, f"id {id_type.simpleString()}, n_words long, runs array<{kind}>, strongest {kind}, kept string")
