"""Language identification by rank-order n-gram profiles.

A profile is a language's ``PROFILE`` most frequent letter n-grams (1 to 3 letters, words padded
by a blank) in order of frequency.  A document's own most frequent n-grams are ranked the same way,
and its distance to a language is the sum, over them, of how far each is out of place; an n-gram
that a profile lacks costs the maximum.  The nearest profile wins.

Letters are folded, and an n-gram is numbered by its code points, so that every letter of every
script is one of its own.  Counting is one pass over the whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, named

#: N-grams in a profile.
PROFILE = 300
#: Labelled documents per language that the profiles are learned from at most: those with the smallest hashes.
SAMPLE = 400
#: Code points; three of them fit into 63 bits.  Blank, and all that is no letter, is 0.
_BASE = 0x110000
#: Bytes of text that are counted at once; a longer text is counted in pieces that overlap by two letters.
_PIECE = 1 << 22


@functools.cache
def _letter_codes() -> np.ndarray:
    """Each code point's number: its own if it is a letter, else 0."""
    letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(_BASE)), np.uint8)
    return np.where(letters, np.arange(_BASE), 0).astype(np.int32)


class Coder:
    """Texts to n-gram counts."""

    def __init__(self):
        self.codes = _letter_codes()

    def counts(self, text: str) -> np.ndarray:
        """(n-gram number, count) of the whole text, in two rows; no columns without a letter."""
        # folded before it is cut: a letter may fold to several
        text, step = text.lower(), _PIECE
        starts = range(0, max(1, len(text)), step)
        seen: list[np.ndarray] = []
        for i in starts:
            # a later piece repeats two letters, so that no n-gram is lost or counted twice
            piece = text[max(0, i - 2) : i + step]
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            c = self.codes[points].astype(np.int64)
            first, last = i == 0, i + step >= len(text)
            c = np.concatenate([np.zeros(int(first), np.int64), c, np.zeros(int(last), np.int64)])
            old = 1 if first else 2
            one = c[old:]
            a, z = c[old - 1 : -1], c[old:]
            mid = c[1:-1]
            # a blank counts beside a letter only
            two = (a * _BASE + z)[(a > 0) | (z > 0)]
            three = ((c[:-2] * _BASE + mid) * _BASE + c[2:])[mid > 0]
            seen += [one[one > 0], two + _BASE, three + _BASE + _BASE**2]
        grams, n = np.unique(np.concatenate(seen), return_counts=True)
        return np.stack([grams, n])

    def top(self, text: str) -> np.ndarray:
        """The document's most frequent n-grams in order, ties by number; empty if the text has no letter."""
        if not text:
            return np.zeros(0, np.int64)
        grams, n = self.counts(text)
        if len(grams) == 0:
            return grams
        keep = np.lexsort((grams, -n))[:PROFILE]
        return grams[keep]


class Profiles:
    """Ranked n-grams of the languages; a pickle of this is what the executors get (a few kB for each language)."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.languages, self.ranked = sorted(ranked), ranked
        self._ready: tuple | None = None

    def __getstate__(self):
        return {"languages": self.languages, "ranked": self.ranked, "_ready": None}

    def _index(self) -> tuple:
        """Coder, all n-grams of the profiles in order, where each one's entries begin, and the entries' languages and ranks."""
        grams = np.concatenate([self.ranked[x] for x in self.languages])
        langs = np.repeat(np.arange(len(self.languages)), [len(self.ranked[x]) for x in self.languages])
        ranks = np.concatenate([np.arange(len(self.ranked[x])) for x in self.languages])
        order = np.argsort(grams, kind="stable")
        known, first = np.unique(grams[order], return_index=True)
        return Coder(), known, np.append(first, len(grams)), langs[order], ranks[order]

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 without a letter.  The score is 1 for a document in the profile's very order and 0 for one that shares nothing with it."""
        if not self.languages:
            return "und", 0.0
        if self._ready is None:
            self._ready = self._index()
        coder, known, first, langs, ranks = self._ready
        mine = coder.top(text or "")
        if len(mine) == 0:
            return "und", 0.0
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        place = np.flatnonzero(known[at] == mine)
        begin, n = first[at[place]], first[at[place] + 1] - first[at[place]]
        entry = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        # what a shared n-gram saves of the maximum
        saved = PROFILE - np.abs(ranks[entry] - np.repeat(place, n))
        out = PROFILE * len(mine) - np.bincount(langs[entry], weights=saved, minlength=len(self.languages))
        best = int(out.argmin())
        return self.languages[best], float(1.0 - out[best] / (PROFILE * len(mine)))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of all labels, from at most ``sample`` documents of each.

    The sample is a bounded one of labelled rows, the same in every run: the smallest hashes of id
    and text.  Rows without text or label are left out; without any labelled row there are no
    profiles, and every document is ``und``.
    """
    rows = named(docs, id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    # a hash threshold that passes about twice the sample, so the rows kept for the top-k are few
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * sample) / F.count(F.lit(1))).alias("share"))
    rows = rows.join(F.broadcast(shares), "lang")
    # of id and text: rows may share either, or have no id
    h = F.xxhash64("id", "text", F.lit("profile"))
    unit = (h.cast("double") / F.lit(2.0**63) + 1) / 2
    picked = rows.withColumn("h", h).where(unit <= F.col("share")).select("lang", "h", "text")
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= sample)
    grams = mapped(picked.select("lang", "text"), _gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= PROFILE).orderBy("lang", "k").collect()
    ranked: dict[str, list[int]] = {}
    for r in best:
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(v) for k, v in ranked.items()})


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Coder()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                grams, n = coder.counts(text)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id, lang_pred, score`` and the columns in ``keep``.

    Null texts and texts without a letter are ``und`` with score 0.  Only the text counts, so
    repeated rows and copies agree.  An empty table gives an empty result.
    """
    columns = {f"keep_{c}": c for c in keep}
    rows = named(docs, id=id_col, text_=text_col, **columns)
    fields = [f.name for f in rows.schema if f.name != "text_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            judged = [profiles.judge(x) for x in b.column("text_").to_pylist()]
            yield pa.record_batch([*(b.column(f) for f in fields), pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())], names=[*fields, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in fields)
    return mapped(rows, run, f"{schema}, lang_pred string, score double").select("id", "lang_pred", "score", *(F.col(f"keep_{c}").alias(c) for c in keep))


def in_fold(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether the id falls into the held-out fold: crc32 of its decimal text modulo ``folds``; null ids don't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
