"""Benchmark decontamination by pigeonhole edit matching.

A test item of n letters may occur with k = floor(n * error_rate) edits.  Cut into k + 1 pieces,
at least one piece must then occur unchanged.  All pieces of a block of items are searched in each
document at once (Aho-Corasick); a hit marks the stretch of text in which the item can lie, and
Myers' bit-parallel algorithm gives the exact least edit distance of the item to any substring of
the merged stretches.

Items are a query set: they are read in blocks of bounded size, and each block meets all documents.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, named, written

#: Edits allowed per letter of an item.
ERROR_RATE = 0.08
#: Normalised letters of items that are searched for at once; bounds what is sent to the executors.
BLOCK_CHARS = 1_000_000
#: Shorter items are searched with a blank at either end, which counts as a letter of theirs, so
#: that they occur as words and not inside of others.
MIN_CHARS = 24
_SIGNS = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Letters and digits in lower case, with one blank for every run of anything else."""
    return _SIGNS.sub(" ", (text or "").lower()).strip()


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of the text, the first end of such a substring), by Myers' algorithm."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score, best, end = ones, 0, m, m, 0
    get = peq.get
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & ones
        mv = ph & xv & ones
    return best, end


class Matcher:
    """The automaton of one block of items: ``(item_id, normalised text)``."""

    def __init__(self, items: tuple[tuple[int, str], ...], error_rate: float):
        long, short = ([(i, t) for i, t in items if (len(t) < MIN_CHARS) == is_short] for is_short in (False, True))
        self.long = _Search([(i, t, int(len(t) * error_rate)) for i, t in long])
        self.short = _Search([(i, f" {t} ", int(len(t) * error_rate)) for i, t in short])

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of every item that occurs within its budget."""
        found = self.long.matches(text)
        if self.short.items and text:
            # without the blanks before the text and after the item
            found += [(i, d, min(max(end - 2, 0), len(text))) for i, d, end in self.short.matches(f" {text} ")]
        return sorted(found)


class _Search:
    """The automaton of ``(item_id, text, edits allowed)``."""

    def __init__(self, items: list[tuple[int, str, int]]):
        import ahocorasick

        self.items = items
        pieces: dict[str, list[tuple[int, int]]] = {}
        for row, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:z], []).append((row, a))
        self.automaton = None
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, at in pieces.items():
                self.automaton.add_word(piece, (len(piece), at))
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the text) of every item that occurs within its budget."""
        found: list[tuple[int, int, int]] = []
        if not self.automaton:
            return found
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            start = end - length + 1
            for row, offset in places:
                _, t, k = self.items[row]
                lo, hi = start - offset - k, start - offset + len(t) + k
                mine = stretches.setdefault(row, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(lo, mine[-1][0]), max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        for row, mine in stretches.items():
            item_id, t, k = self.items[row]
            best = (k + 1, 0)
            for lo, hi in mine:
                lo = max(0, lo)
                window = text[lo:hi]
                at = window.find(t)
                d, end = (0, at + len(t)) if at >= 0 else best_match(t, window)
                best = min(best, (d, lo + end))
                if best[0] == 0:
                    break
            if best[0] <= k:
                found.append((item_id, *best))
        return found


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], error_rate: float) -> Matcher:
    return Matcher(items, error_rate)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[tuple[int, str], ...]]:
    block: list[tuple[int, str]] = []
    held = 0
    for item_id, text in named(benchmark, id=id_col, text=text_col).toLocalIterator(prefetchPartitions=False):
        t = normalised(text)
        if item_id is None or not t:
            continue
        if block and held + len(t) > BLOCK_CHARS:
            yield tuple(block)
            block, held = [], 0
        block.append((item_id, t))
        held += len(t)
    yield tuple(block)


def _search(items: tuple[tuple[int, str], ...], error_rate: float, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, error_rate)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            got = [[{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.matches(normalised(x))] for x in b.column("text_").to_pylist()]
            names = [n for n in b.schema.names if keep_text or n != "text_"]
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(got, kind)], names=[*names, "found"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id, matches`` and the columns in ``keep``; matches are ``(item_id, distance, end)`` by item.

    Null and empty texts match nothing, nor do null, empty or id-less items.  Texts are searched
    whole.  Repeated items are reported under each of their ids, repeated documents in each of
    their rows; empty tables match nothing.
    """
    rows = named(docs, id=id_col, text_=text_col, **{f"keep_{c}": c for c in keep})
    blocks = _blocks(benchmark, item_col, item_text_col)
    found = "array<struct<item_id:long,distance:int,end:long>>"
    out, items = rows.withColumn("matches", F.array().cast(found)), next(blocks)
    while items is not None:
        after = next(blocks, None)
        passed = [f for f in out.schema if after is not None or f.name != "text_"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed)
        out = mapped(out, _search(items, error_rate, after is not None), f"{schema}, found {found}").withColumn("matches", F.array_sort(F.concat("matches", "found"))).drop("found")
        # one block's search is done before the next one begins
        out, items = written(out, "decontamination-block") if after is not None else out, after
    return out.select("id", "matches", *(F.col(f"keep_{c}").alias(c) for c in keep))
