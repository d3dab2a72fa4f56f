"""Content-defined sample positions of texts, the runs between them, and their windows (NumPy)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .bytehash import U, mix

#: Bytes of a position's sampling key.
GRAM = 8
#: Text bytes handled at once, few enough for their keys to stay in a core's cache; positions in a buffer take the low 24 bits of a sampling key.
BUFFER = 1 << 16
#: More than any text is long: texts of a batch lie this far apart on one line of positions.
FAR = 1 << 40


def buffers(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Byte buffers, with (text, offset in the text, start, end) of each stretch in them.

    A text longer than a buffer comes in stretches that overlap by ``width - 1`` bytes, so each of its
    windows lies in exactly one stretch.  Texts without a window are left out.
    """
    parts: list[bytes] = []
    spans: list[tuple[int, int, int, int]] = []
    held = 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= width:
            piece = t[at : at + BUFFER + width - 1]
            if held and held + len(piece) > BUFFER:
                yield np.frombuffer(b"".join(parts), np.uint8), spans
                parts, spans, held = [], [], 0
            parts.append(piece)
            spans.append((i, at, held, held + len(piece)))
            held += len(piece)
            at += BUFFER
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), spans


def _in_buffer(data: np.ndarray, spans: list[tuple[int, int, int, int]], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, sample position, first key window that has it) in one buffer; a window has ``reach`` keys and its least one, the last on ties, is its sample."""
    grams = np.lib.stride_tricks.as_strided(data, (len(data) - GRAM + 1, GRAM), (1, 1)).copy().view("<u8").ravel()
    key = (mix(grams + U(0x1234567)) & ~U(0xFFFFFF)) | (U(0xFFFFFF) - np.arange(len(grams), dtype=U))
    # the least of ``reach`` keys from minima over 1, 2, 4, .. of them
    least, size = key, 1
    while 2 * size <= reach:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(key) - reach + 1], least[reach - size :])
    starts, count = np.array([s[2] for s in spans]), np.array([s[3] - s[2] - reach - GRAM + 2 for s in spans])
    # windows whose sample isn't that of the window before, and the first one of each span
    window = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, starts)
    span = np.searchsorted(starts, window, "right") - 1
    inside = window < starts[span] + count[span]
    window, span = window[inside], span[inside]
    return span, (U(0xFFFFFF) - (least[window] & U(0xFFFFFF))).astype(np.int64), window


def samples(texts: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, first key window) of every sample, in order.

    Equal strings have equal samples at equal places: whether a position is the sample of a key
    window depends on the bytes of that window alone, and every window has one.
    """
    found = [(np.zeros(0, np.int64),) * 3]
    for data, spans in buffers(texts, reach + GRAM - 1):
        span, p, first = _in_buffer(data, spans, reach)
        at = np.array(spans)[span]
        shift = at[:, 1] - at[:, 2]
        found.append((at[:, 0], p + shift, first + shift))
    text, p, first = (np.concatenate(x) for x in zip(*found, strict=True))
    # the sample at the border of two stretches of one text was found in both
    fresh = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(p) != 0)])[: len(p)]
    return text[fresh], p[fresh], first[fresh]


def phrase_names(texts: list[bytes], text: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit cryptographic digest of each stretch from a sample to the key of the next one, in two halves; the last sample of a text has none (zeros)."""
    last = np.concatenate([text[1:] != text[:-1], [True]])[: len(text)]
    out, digest = [], hashlib.blake2b
    ends = np.concatenate([p[1:], [0]])[: len(p)] + GRAM
    for t, a, z, stop in zip(text.tolist(), p.tolist(), ends.tolist(), last.tolist(), strict=True):
        out.append(bytes(16) if stop else digest(texts[t][a:z], digest_size=16).digest())
    names = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
    return names[:, 0], names[:, 1]


class Ranks:
    """The ranks of a batch of texts by level: level k ranks the run of 2**k stretches at a sample; 0 where it has none."""

    def __init__(self):
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def put(self, level: int, place: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(place, kind="stable")
        self.at[level] = (place[order], rank[order])

    def get(self, level: int, place: np.ndarray) -> np.ndarray:
        have, rank = self.at.get(level, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        if not len(have):
            return np.zeros(len(place), np.int64)
        i = np.minimum(np.searchsorted(have, place), len(have) - 1)
        return np.where(have[i] == place, rank[i], 0)

    def of_runs(self, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two ranks, of overlapping runs of 2**k stretches, that name a run of n at a sample; 0 and 0 if one of them is unique, and so the run."""
        first, second = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        level = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            rows = np.flatnonzero((level == k) & (n > 0))
            first[rows], second[rows] = self.get(int(k), place[rows]), self.get(int(k), place[rows] + n[rows] - (1 << int(k)))
        both = (first > 0) & (second > 0)
        return np.where(both, first, 0), np.where(both, second, 0)


def pairs_at(place: np.ndarray, position: np.ndarray, rank: np.ndarray, offset: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, k) of ranks that stand ``offset`` samples apart in one text and not farther than ``longest`` bytes; places are sorted."""
    k = np.minimum(np.searchsorted(place, place + offset), max(len(place) - 1, 0))
    i = np.flatnonzero(place[k] == place + offset) if len(place) else np.zeros(0, np.int64)
    i = i[position[k[i]] - position[i] <= longest]
    return i, k[i]


def pieces(first: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts [lo, hi] cut where the first or the last inner sample changes: (range, start, end, first sample, last sample).

    ``first``: the first key window of each sample, ascending over the whole batch; a window's last
    key window begins ``shift`` after it.
    """
    cuts = np.unique(np.concatenate([first, first - shift]))
    a, z = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "right")
    count = z - a + 1
    owner = np.repeat(np.arange(len(lo)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.where(k == 0, lo[owner], cuts[np.minimum(a[owner] + k - 1, max(len(cuts) - 1, 0))] if len(cuts) else lo[owner])
    end = np.where(k == count[owner] - 1, hi[owner], cuts[np.minimum(a[owner] + k, len(cuts) - 1)] - 1 if len(cuts) else hi[owner])
    return owner, start, end, np.searchsorted(first, start, "right") - 1, np.searchsorted(first, start + shift, "right") - 1
