"""Alignment of two tokenizers over the bytes that both cover.

A document's bytes are one line.  For each tokenizer a packed bitset marks the bytes at which its
tokens end; the AND of the two marks the shared cuts.  Popcounts give ranks: the number of tokens of
either side that end up to a cut, hence the token range of each group.  Links are then expanded from
the groups: the last tokens before a cut end together.

How often each pair of ids is linked is a statistic of the whole corpus, and common pairs occur
everywhere.  So links are kept in *blocks* of bounded length: a block numbers its distinct pairs,
counts them, and packs its links as those numbers.  Only (block, pair, count) rows are shuffled for
the corpus-wide counts, with at most one row of a pair from each block; the counts come back to their
block as one array, and a block's links are looked up there.  No token, link or document is a row.

Text is cut in front of single blanks that follow a sign other than white space.  No token of either
vocabulary goes over such a place (the piece vocabulary is looked through for that when it is
loaded), nor between a Latin letter and the signs found the same way.  So the parts can be encoded one
by one, and the alignment of frequent parts is remembered.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped, named, written

#: Links of a block; a longer document's links lie in several blocks.
BLOCK_LINKS = 1 << 19
#: Parts, and words or signs in them, whose alignment a worker remembers, and the longest of them; others are aligned again.
KNOWN_PARTS, KNOWN_STEMS, KNOWN_CHARS = 150_000, 200_000, 48
#: Characters handled at once, of one text (a longer one is cut at a part) and of several.
PIECE_CHARS, TOGETHER_CHARS = 1 << 20, 1 << 18
_CUT = re.compile(r"(?<=\S) ")
_LOOSE = re.compile(r"\s ")
#: letters of one case pair each, which every Unicode version counts as such
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]"
U = np.uint64


def marks(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """The packed bitset of the given ends: bit k of the line is set if a token ends right after byte k."""
    flags = np.zeros(-(-max(n_bytes, 1) // 64) * 64, np.uint8)
    flags[ends - 1] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def select(bits: np.ndarray) -> np.ndarray:
    """The places of all set bits."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of bits set up to and including each place."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word, bit = at >> 6, (at & 63).astype(U)
    upto = np.bitwise_count(bits[word] & (~U(0) >> (U(63) - bit)))
    return before[word] + upto


def shared_cuts(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two ways to cut the same bytes into tokens of at least one byte: the shared ends, and how many tokens of each lie before them."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    n = int(a_end[-1]) if len(a_end) else 0
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    a, b = marks(a_end, n), marks(b_end, n)
    cuts = select(a & b)
    return cuts + 1, rank(a, cuts), rank(b, cuts)


class ByteLevel:
    """A byte-level vocabulary of the ``tokenizers`` library; special strings inside texts are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_of = [b""] * max(self.library.get_vocab_size(), max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(letters.__getitem__, token)) if set(token) <= letters.keys() else token.encode()
        self.length = np.array([*map(len, self.bytes_of)])

    def encode(self, text: str) -> list[int]:
        """The text with a blank in front of it."""
        return self.library.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """A ``sentencepiece`` model, which puts the blank in front of a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length = np.array([*map(len, self.bytes_of)])
        self.blank = self.library.piece_to_id("▁")
        inner = {p[k : k + 2] for i, p in enumerate(names) if not self.library.is_byte(i) for k in range(len(p) - 1)}
        #: whether a text may be cut in front of a blank that follows another sign
        self.cuts = not any(x[1] == "▁" != x[0] for x in inner)
        #: the signs in front of which a text may be cut if they follow a Latin letter
        self.signs = "".join(c for c in "\n" + string.punctuation if c != "'" and not any(x[1] == c and re.match(_LETTER, x[0]) for x in inner))

    def encode(self, text: str) -> list[int]:
        # the library adds no blank to an empty text: a lone blank at the end of one
        return self.library.encode(text) if text else [self.blank]


class Aligner:
    """Aligns texts, each of them with a blank in front; one per worker process.

    The value of a text or part is (A tokens, B tokens, groups, group text, links); False where
    either tokenizer changes the bytes.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.known: dict[str, tuple | bool] = {}
        self.stems: dict[str, tuple | bool] = {}
        self.stem = re.compile(f"({_LETTER}+)([{re.escape(self.b.signs)}].*)", re.DOTALL) if self.b.signs else None
        self.lead = self.value("a")

    def parts(self, text: str) -> list[str]:
        """The text without the blanks in front of its parts."""
        if not self.b.cuts:
            return [text]
        if text[:1] != " " and not _LOOSE.search(text):
            return text.split(" ")
        return _CUT.split(text)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of bounded length, cut at parts where there are any, without the blank at a cut."""
        at = 0
        while len(text) - at > PIECE_CHARS and self.b.cuts:
            cut = _CUT.search(text, at + PIECE_CHARS)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def value(self, part: str) -> tuple | bool:
        return self.line([part])[0]

    def values(self, parts: list[str]) -> dict[str, tuple | bool]:
        """The values of distinct parts.  What ends in white space must be the end of its line, as it was the end of its text."""
        solid = [p for p in parts if p and not p[-1].isspace() and self.b.cuts]
        found = dict(zip(solid, self.line(solid), strict=True)) if solid else {}
        return found | {p: self.value(p) for p in parts if p not in found}

    def line(self, parts: list[str]) -> list[tuple | bool]:
        """The values of parts that lie on one line of bytes, one behind the other: their ends are shared cuts."""
        whole = " ".join(parts)
        ids_a, ids_b, raw = self.a.encode(whole), self.b.encode(whole), (" " + whole).encode()
        if raw != b"".join(map(self.a.bytes_of.__getitem__, ids_a)) or raw != b"".join(map(self.b.bytes_of.__getitem__, ids_b)):
            # find the parts that are changed
            half = len(parts) // 2
            return self.line(parts[:half]) + self.line(parts[half:]) if half else [False]
        line_a, line_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        cuts, a_to, b_to = shared_cuts(self.a.length[line_a], self.b.length[line_b])
        links = ((line_a[a_to - 1] << 32) | line_b[b_to - 1]).tobytes()
        stops = np.searchsorted(cuts, np.cumsum([len(p.encode()) + 1 for p in parts]), "right").tolist()
        a_to, b_to = a_to.tolist(), b_to.tolist()
        text_a, text_b = [*map(str, ids_a)], [*map(str, ids_b)]
        out, g, i, j = [], 0, 0, 0
        for stop in stops:
            first, a0, b0, names = g, i, j, []
            while g < stop:
                names.append(",".join(text_a[i : a_to[g]]) + "|" + ",".join(text_b[j : b_to[g]]))
                i, j, g = a_to[g], b_to[g], g + 1
            out.append((i - a0, j - b0, g - first, ";".join(names).encode(), links[8 * first : 8 * g]))
        return out

    def of_stems(self, stems: list[str]) -> dict[str, tuple | bool]:
        """The values of short parts that many parts share."""
        found = {x: self.stems.get(x) for x in stems}
        new = [x for x, v in found.items() if v is None]
        if new:
            fresh = self.values(new)
            found |= fresh
            room = KNOWN_STEMS - len(self.stems)
            self.stems |= dict([*fresh.items()][: max(0, room)])
        return found

    def of_parts(self, parts: list[str]) -> list[tuple | bool]:
        got = [*map(self.known.get, parts)]
        if None not in got:
            return got
        new = [*dict.fromkeys(p for p, v in zip(parts, got, strict=True) if v is None)]
        # a word of Latin letters and the signs behind it are aligned one by one
        cut = {p: (m[1], "a" + m[2]) if self.stem and len(p) <= KNOWN_CHARS and (m := self.stem.fullmatch(p)) else (p,) for p in new}
        short = self.of_stems([x for p, xs in cut.items() if len(p) <= KNOWN_CHARS for x in xs])
        long = [p for p in new if len(p) > KNOWN_CHARS]
        found = self.values(long)
        lead = self.lead
        for p, xs in cut.items():
            if p not in found:
                v = short[xs[0]]
                if len(xs) == 2 and v and (w := short[xs[1]]):
                    # without the letter that stands for the word
                    found[p] = (v[0] + w[0] - lead[0], v[1] + w[1] - lead[1], v[2] + w[2] - lead[2], v[3] + w[3][len(lead[3]) :], v[4] + w[4][len(lead[4]) :])
                else:
                    found[p] = v if len(xs) == 1 else False
                if len(self.known) < KNOWN_PARTS:
                    self.known[p] = found[p]
        return [found[p] if v is None else v for p, v in zip(parts, got, strict=True)]

    def align(self, text: str | None) -> tuple[int, int, int, str, bytes]:
        """(A tokens, B tokens, groups, digest of the groups, links as A id << 32 | B id) of a text."""
        return next(self.align_all([text]))

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """``align`` of several texts, whose unknown parts lie on one line."""
        at = 0
        while at < len(texts):
            some, chars = [], 0
            while at + len(some) < len(texts) and (not some or chars + len(texts[at + len(some)] or "") <= TOGETHER_CHARS):
                some.append(texts[at + len(some)] or "")
                chars += len(some[-1])
            if chars > PIECE_CHARS:
                yield self._sum(self.of_parts(self.parts(p)) for p in self.pieces(some[0]))
            else:
                parts = [self.parts(t) if t else [] for t in some]
                got, i = self.of_parts([*itertools.chain.from_iterable(parts)]), 0
                for p in parts:
                    yield self._sum([got[i : i + len(p)]] if p else [])
                    i += len(p)
            at += len(some)

    def _sum(self, pieces: Iterable[list[tuple | bool]]) -> tuple[int, int, int, str, bytes]:
        n_a = n_b = groups = 0
        digest, links = hashlib.sha256(), []
        for got in pieces:
            if False in got:
                return 0, 0, 0, "", b""
            digest.update((b";" if groups else b"") + b";".join([v[3] for v in got]))
            n_a += sum([v[0] for v in got])
            n_b += sum([v[1] for v in got])
            groups += sum([v[2] for v in got])
            links.append(b"".join([v[4] for v in got]))
        return n_a, n_b, groups, digest.hexdigest() if groups else "", b"".join(links)


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _blocks(a_path: str, b_path: str, id_type: pa.DataType):
    """One row per block: the documents with links in it, their links as numbers of pairs, the pairs and how often each occurs."""
    names = ["key", "id", "n_a", "n_b", "n_groups", "groups_sha256", "n"]
    kinds = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def row(block: int, docs: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
        pairs, number, count = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True, return_counts=True)
        packed = number.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()
        columns = [pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*docs, strict=True), kinds, strict=True)]
        return pa.record_batch([pa.array([block], pa.int64()), *columns, pa.array([packed], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([count.astype(np.int64)], pa.list_(pa.int64()))], names=["block", *names, "links", "pairs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_all = aligner(a_path, b_path).align_all
        task = TaskContext.get().partitionId()
        block, key, docs, links, room = task << 32, task << 40, [], [], BLOCK_LINKS
        for b in batches:
            for id_, (n_a, n_b, groups, digest, raw) in zip(b.column(0).to_pylist(), align_all(b.column(1).to_pylist()), strict=True):
                mine = np.frombuffer(raw, np.int64)
                while True:
                    here, mine = mine[:room], mine[room:]
                    docs.append((key, id_, n_a, n_b, groups, digest, len(here)))
                    links.append(here)
                    # each document costs a place as well, so that blocks of documents without links end too
                    room = max(0, room - len(here) - 1)
                    if room == 0:
                        yield row(block, docs, links)
                        block, docs, links, room = block + 1, [], [], BLOCK_LINKS
                    if not len(mine):
                        break
                    n_a = n_b = groups = 0
                key += 1
        if docs:
            yield row(block, docs, links)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of a block: how many of its links are their B id's most frequent, and the sum of the links' counts."""
    for b in batches:
        for k in range(b.num_rows):
            at = {name: b.column(name)[k] for name in b.schema.names}
            n = at["n"].values.to_numpy()
            total, best = (np.asarray(at[c].values.to_numpy(zero_copy_only=False)).astype(np.int64) if at[c].is_valid else np.zeros(0, np.int64) for c in ("total", "best"))
            links = np.frombuffer(at["links"].as_py(), "<u2" if len(total) <= 1 << 16 else "<u4")
            ends = np.cumsum(n)
            cum = [np.concatenate([[0], np.cumsum(v[links])]) for v in (total, best)]
            yield pa.record_batch([*(at[c].values for c in ("key", "id", "n_a", "n_b", "n_groups", "groups_sha256", "n")), *(pa.array(c[ends] - c[ends - n], pa.int64()) for c in cum)], names=["key", "id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "count_sum", "n_best"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, total, best``: how many links of the corpus have each pair of ids, and whether no other pair of its B id has more."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("r")).select("r.pairs", "r.counts")
    counts = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    return counts.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a_path``: a byte-level file of ``tokenizers``; ``b_path``: a ``sentencepiece`` model that adds
    a blank in front; both read the text with that blank.  Null and empty texts, and texts whose
    bytes either tokenizer changes (a literal U+2581, which stands for a blank), have no tokens: all
    numbers 0, no digest (''), no part in any count.  Ties for the most frequent pair of a B id all
    count as best.  Repeated rows and null ids are rows of their own; columns of other names don't
    matter; an empty table gives an empty result.  Texts are read in pieces of ``PIECE_CHARS``; what
    a long text costs in memory is its own links (8 bytes each) and blocks of ``BLOCK_LINKS``.
    """
    rows = named(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    doc = f"key array<long>, id array<{id_type}>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n array<long>"
    blocks = written(mapped(rows, _blocks(a_path, b_path, to_arrow_type(rows.schema["id"].dataType)), f"block long, {doc}, links binary, pairs array<long>, counts array<long>"), "align-blocks")
    totals = pair_counts(blocks)
    numbered = blocks.select("block", F.posexplode("pairs").alias("number", "pair"))
    looked_up = numbered.join(totals, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("number", "total", "best"))).alias("r"))
    looked_up = looked_up.select("block", F.col("r.total").alias("total"), F.col("r.best").alias("best"))
    # a block without links has no pairs
    full = blocks.drop("pairs", "counts").join(looked_up, "block", "left")
    out = mapped(full.drop("block"), _sums, f"key long, id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, count_sum long, n_best long")
    # the parts of a document whose links lie in several blocks
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.groupBy("key", "id").agg(*sums, F.max("groups_sha256").alias("groups_sha256")).drop("key")
