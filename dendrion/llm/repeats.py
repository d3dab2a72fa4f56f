"""Removal of repeated byte strings by distributed prefix doubling.

*Samples.*  The suffixes that are ranked begin at sampled positions: every window of ``reach``
8-byte keys samples its least key, so equal strings have equal samples at equal places, and there
are about 2 / reach of them per byte (a sparse suffix array).  The stretch from a sample to the
next is one letter of a shorter text; its first rank comes from its content.

*Doubling.*  Level k ranks the string of 2**k stretches at a sample.  Spark counts the pairs
(rank at j, rank at j + 2**k), sorts those that occur more than once and numbers them in that
order: the ranks of level k + 1.  A position whose pair is unique leaves, for good and as a
partner, and a pair longer than the threshold needs is not formed; so the offsets grow 1, 2, 4, ..
until nothing is left.  Two overlapping ranks of one level name a run of any length.

*Windows.*  All windows that begin between a sample and the next repeat if the run that covers
them all does; these runs are counted first and settle nearly everything.  The rest lies at the
ends of repeats.  There a window is its inner run, from its first inner sample to its last one,
with the bytes before and after: runs are compared by their ranks, then, where they agree, the
bytes around them, first for all windows of a piece at once and at last window by window.  One
place of each settled run stays as a partner, so a window is compared with all others.

Ranks are integers that Spark's sort gives; no equality rests on a rolling hash (the first letters
and the single windows at the ends are named by 128-bit BLAKE2b digests of their bytes).  No group
is gathered: every decision is a count by a key with partial aggregation, and a join back.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, named, reclaim, written
from .windows import FAR, GRAM, Ranks, pairs_at, phrase_names, pieces, samples

#: Length in bytes of a string whose repetition counts.
WIDTH = 400
#: Texts handled at once.
_ROWS = 256
#: A text is hot with more than this share of all rows; there can't be more hot texts than parts.
HOT_PARTS = 1000
#: Numbers of a batch's texts on the line of samples.
_APART = 1 << 32
_RUN = ["n", "r1", "r2"]


def reach_of(width: int) -> int:
    """Keys in a sampling window: a third of those in a string of ``width`` bytes, so that its first and last windows never share a sample."""
    return max(1, (width - GRAM + 1) // 3)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _ROWS):
            yield b.slice(i, _ROWS)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _lists(owner: np.ndarray, rows: int, *columns: np.ndarray) -> list[pa.ListArray]:
    offsets = pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, the elements) of a column of lists."""
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


#: A text's samples and the ranks at them travel as bytes: lists would be taken apart value by value wherever they pass.
_PLACE = np.dtype([("pos", "<i4"), ("first", "<i4")])
_ITEM = np.dtype([("rank", "<i8"), ("j", "<i4"), ("level", "<i4")])


def _packed(owner: np.ndarray, rows: int, kind: np.dtype, **columns: np.ndarray) -> pa.BinaryArray:
    """The records of each row, whose owners ascend, as bytes."""
    records = np.empty(len(owner), kind)
    for name, values in columns.items():
        records[name] = values
    offsets = (np.searchsorted(owner, np.arange(rows + 1)) * kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])


def _unpacked(column: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(row of each record, the records) of a column that ``_packed`` made."""
    rows = column.to_pylist()
    return np.repeat(np.arange(len(rows)), [len(x) // kind.itemsize for x in rows]), np.frombuffer(b"".join(rows), kind)


_SAMPLES = "k1 long, k2 long, n_bytes int, pos array<int>, h1 array<long>, h2 array<long>, places binary"


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            texts = b.column(2).to_pylist()
            owner, p, first = samples(texts, reach_of(width))
            h1, h2 = phrase_names(texts, owner, p)
            sizes = pa.array([len(t) for t in texts], pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), sizes, *_lists(owner, b.num_rows, p.astype(np.int32), h1, h2), _packed(owner, b.num_rows, _PLACE, pos=p, first=first)], names=["k1", "k2", "n_bytes", "pos", "h1", "h2", "places"])

    return run


_PAIRS = "t long, c int, j int, pos int, r1 long, r2 long"


def _paired(offset: int, longest: int):
    """The ranks of each text to pairs of ranks ``offset`` samples apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            owner, items = _flat(b.column(2))
            j, pos, rank = (_numbers(items.field(i)) for i in range(3))
            order = np.lexsort((j, owner))
            owner, j, pos, rank = owner[order], j[order], pos[order], rank[order]
            i, k = pairs_at(owner * _APART + j, pos, rank, offset, longest)
            t, c = _numbers(b.column(0))[owner[i]], _numbers(b.column(1))[owner[i]]
            yield pa.record_batch([pa.array(x) for x in (t, c, j[i], pos[i], rank[i], rank[k])], names=["t", "c", "j", "pos", "r1", "r2"])

    return run


_STATE = "t long, c int, n_bytes int, places binary, items binary"


def _joined_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of all levels of a text as one string of bytes."""
    for b in _runs(batches):
        row, levels = _flat(b.column(4))
        which, items = _flat(levels.field(1))
        packed = _packed(row[which], b.num_rows, _ITEM, rank=_numbers(items.field(1)), j=_numbers(items.field(0)), level=_numbers(levels.field(0))[which])
        yield pa.record_batch([*(b.column(i) for i in range(4)), packed], names=["t", "c", "n_bytes", "places", "items"])


class _Texts:
    """The samples and ranks of a batch of texts, flattened: sample i is number ``j[i]`` of text ``owner[i]``, at ``at[i]`` on a line that holds all texts."""

    def __init__(self, b: pa.RecordBatch):
        self.t, self.c, self.n_bytes = (_numbers(b.column(i)).astype(np.int64) for i in range(3))
        self.owner, places = _unpacked(b.column(3), _PLACE)
        self.pos = places["pos"].astype(np.int64)
        self.first = places["first"].astype(np.int64) + self.owner * FAR
        self.at = self.pos + self.owner * FAR
        begin = np.searchsorted(self.owner, np.arange(b.num_rows + 1))
        self.begin, self.end = begin[:-1], begin[1:]
        self.place = np.arange(len(self.pos)) - begin[self.owner] + self.owner * _APART
        self.ranks = Ranks()
        row, items = _unpacked(b.column(4), _ITEM)
        place, level, rank = row * _APART + items["j"], items["level"], items["rank"]
        for k in np.unique(level):
            mine = level == k
            self.ranks.put(int(k), place[mine], rank[mine])


_COVERS = "t long, c int, j int, n int, r1 long, r2 long"


def _covers(width: int):
    """For every stretch the shortest run from its sample that covers all windows beginning in it, where that run may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            x = _Texts(b)
            i = np.flatnonzero(np.arange(len(x.pos)) + 1 < x.end[x.owner])
            m = np.searchsorted(x.at, x.at[i + 1] + width - 1 - GRAM)
            i, m = i[m < x.end[x.owner[i]]], m[m < x.end[x.owner[i]]]
            r1, r2 = x.ranks.of_runs(x.place[i], m - i)
            i, n, r1, r2 = (v[r1 > 0] for v in (i, m - i, r1, r2))
            o = x.owner[i]
            yield pa.record_batch([pa.array(x.t[o]), pa.array(x.c[o].astype(np.int32)), pa.array((i - x.begin[o]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(r1), pa.array(r2)], names=["t", "c", "j", "n", "r1", "r2"])

    return run


_PIECES = "t long, c int, lo int, hi int, n int, r1 long, r2 long, a int, z int, open boolean"


def _cut_pieces(width: int):
    """Windows outside settled stretches (open, but for copied texts, which go whole), those of one place of each settled run, and the settled spans (n = 0)."""
    shift = width - GRAM + 1 - reach_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            x = _Texts(b)
            row, done = _flat(b.column(5))
            status = np.zeros(len(x.pos), np.int8)
            if len(row):
                status[x.begin[row] + _numbers(done.field(0))] = np.where(_numbers(done.field(1)), 2, 1)
            # settled stretches that follow one another are one span
            s = np.flatnonzero(status)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(x.owner[s]) != 0)]))[: len(s)]
            last = np.concatenate([new[1:], [len(s)]])[: len(new)] - 1
            spans = (x.owner[s[new]], x.pos[s[new]], x.pos[np.minimum(s[last] + 1, max(len(x.pos) - 1, 0))] - 1)
            # windows that begin before the first sample, and those from each sample to the next
            after = np.where(np.arange(len(x.pos)) + 1 < x.end[x.owner], np.append(x.pos[1:], 0)[: len(x.pos)] - 1, FAR)
            rows = np.arange(b.num_rows)
            owner = np.concatenate([rows, x.owner])
            lo = np.concatenate([np.zeros(b.num_rows, np.int64), x.pos])
            hi = np.minimum(np.concatenate([x.pos[np.minimum(x.begin, len(x.pos) - 1)] - 1, after]), x.n_bytes[owner] - width)
            state = np.concatenate([np.zeros(b.num_rows, np.int8), status])
            wanted = (lo <= hi) & (state != 1)
            owner, lo, hi, state = (v[wanted] for v in (owner, lo, hi, state))
            r, lo, hi, a, z = pieces(x.first, lo + owner * FAR, hi + owner * FAR, shift)
            r1, r2 = x.ranks.of_runs(x.place[a], z - a)
            keep = r1 > 0
            o = owner[r][keep]
            cols = [x.t[o], x.c[o], lo[keep] - o * FAR, hi[keep] - o * FAR, (z - a)[keep], r1[keep], r2[keep], x.pos[a[keep]], x.pos[z[keep]] + GRAM, (state[r][keep] == 0) & (x.c[o] < 2)]
            so, zero = spans[0], np.zeros(len(s[new]), np.int64)
            cols = [np.concatenate(p) for p in zip(cols, [x.t[so], x.c[so], spans[1], spans[2], zero, zero, zero, zero, zero, zero > 0], strict=True)]
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32, bool)
            yield pa.record_batch([pa.array(c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["t", "c", "lo", "hi", "n", "r1", "r2", "a", "z", "open"])

    return run


_ENDS = "h1 long, h2 long, run binary, l_lo int, l_hi int, ends binary, t long, lo int, hi int, open boolean, c int"


def _with_ends(width: int):
    """The bytes around the inner run of each wanted piece, and a digest of run, place and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            texts = b.column(1).to_pylist()
            owner, items = _flat(b.column(2))
            f = {name: items.field(i) for i, name in enumerate(("lo", "hi", "n", "r1", "r2", "a", "z", "open", "c"))}
            lo, hi, a, z = (_numbers(f[k]).astype(np.int64) for k in ("lo", "hi", "a", "z"))
            ends = [texts[o][p:q] + texts[o][r:e] for o, p, q, r, e in zip(owner.tolist(), lo.tolist(), a.tolist(), z.tolist(), (hi + width).tolist(), strict=True)]
            head = np.stack([_numbers(f[k]).astype(np.int64) for k in _RUN] + [a - hi, a - lo], 1)
            heads = [r.tobytes() for r in head]
            h = _digests([r + e for r, e in zip(heads, ends, strict=True)])
            t = pa.array(_numbers(b.column(0))[owner])
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([r[:24] for r in heads], pa.binary()), pa.array((a - hi).astype(np.int32)), pa.array((a - lo).astype(np.int32)), pa.array(ends, pa.binary()), t, f["lo"], f["hi"], f["open"], f["c"]], names=["h1", "h2", "run", "l_lo", "l_hi", "ends", "t", "lo", "hi", "open", "c"])

    return run


def _digests(strings: list[bytes]) -> np.ndarray:
    """128-bit digests as two integers each."""
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(s, digest_size=16).digest() for s in strings]), np.int64).reshape(-1, 2)


_WINDOWS = "h1 long, h2 long, m long, t long, s int, want boolean"


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a piece, named by its run, the bytes it has before it, and all its bytes around it."""
    for b in _runs(batches):
        l_lo, l_hi, lo = (_numbers(b.column(k)).astype(np.int64) for k in ("l_lo", "l_hi", "lo"))
        strings = []
        for run, e, least, most in zip(b.column("run").to_pylist(), b.column("ends").to_pylist(), l_lo.tolist(), l_hi.tolist(), strict=True):
            q = len(e) - (most - least)
            strings += [run + (most - i).to_bytes(4, "little") + e[i : i + q] for i in range(most - least + 1)]
        o = np.repeat(np.arange(b.num_rows), l_hi - l_lo + 1)
        k = np.arange(len(o)) - np.searchsorted(o, o)
        h = _digests(strings)
        take = lambda c: b.column(c).take(pa.array(o))
        yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), take("m"), take("t"), pa.array((lo[o] + k).astype(np.int32)), take("want")], names=["h1", "h2", "m", "t", "s", "want"])


def _hashed(keys: DataFrame) -> DataFrame:
    """Distinct keys, fewer than the rows they are joined with: hashed part by part, so those rows needn't be sorted (and a frequent key's can still be split)."""
    return keys.hint("shuffle_hash")


def _ranked(pairs: DataFrame) -> DataFrame:
    """``r1, r2, r``: pairs that occur more than once, sorted and numbered in ascending order (with gaps)."""
    repeated = pairs.groupBy("r1", "r2").agg(F.sum("c").alias("m")).where("m > 1").select("r1", "r2")
    ordered = repeated.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2")
    return written(ordered.select("r1", "r2", (F.monotonically_increasing_id() + 1).alias("r")), "repeat-ranks")


def _by_text(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """``t, c, items``: the ranked positions of each text; those whose pair is unique are gone."""
    rows = pairs.join(_hashed(ranks), ["r1", "r2"]).select("t", "c", F.struct("j", "pos", "r").alias("item"))
    return written(rows.groupBy("t").agg(F.max("c").alias("c"), F.collect_list("item").alias("items")), "repeat-level")


def _doubled(base: DataFrame, longest: int) -> list[DataFrame]:
    """The levels, ``t, c, items`` each: ranks of 1, 2, 4, .. stretches, up to the longest run that is needed."""
    cells = F.slice(F.arrays_zip("pos", "h1", "h2"), F.lit(1), F.size("pos") - 1)
    pairs = base.select("t", "c", F.posexplode(cells).alias("j", "x")).select("t", "c", "j", "x.pos", F.col("x.h1").alias("r1"), F.col("x.h2").alias("r2"))
    levels: list[DataFrame] = []
    while True:
        ranks = _ranked(pairs)
        if ranks.isEmpty():
            return levels
        levels.append(_by_text(pairs, ranks))
        discard(ranks)
        reclaim(base.sparkSession)
        pairs = mapped(levels[-1], _paired(1 << (len(levels) - 1), longest), _PAIRS)


def _level_items(level: DataFrame) -> DataFrame:
    """``t, items`` of a written level, where an item's position isn't even read."""
    folder = level.inputFiles()[0].rpartition("/")[0]
    return level.sparkSession.read.schema("t long, items array<struct<j:int,r:long>>").parquet(folder)


def repeated_spans(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Spans ``k1, k2, found`` (array of start, end, overlapping) of repeated strings in the distinct texts ``k1, k2, text``, and texts ``k1, k2, c, n_bytes``, c being 2 where more than one row has them."""
    spark = texts.sparkSession
    found = texts.where(F.octet_length("text") >= width).select("k1", "k2", "text")
    once = mapped(found, _sampled(width), _SAMPLES).groupBy("k1", "k2").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("c"), *(F.any_value(c).alias(c) for c in ("n_bytes", "pos", "h1", "h2", "places")))
    named_base = written(once.withColumn("t", F.monotonically_increasing_id()), "repeat-samples")
    known = written(named_base.select("t", "c", "n_bytes", "places", "k1", "k2"), "repeat-known")
    reclaim(spark)
    levels = _doubled(named_base, width + 2 * reach_of(width))
    discard(named_base)
    if not levels:
        return known.where("false").select("k1", "k2", F.array().cast("array<struct<start:int,end:int>>").alias("found")), known.select("k1", "k2", "c", "n_bytes")
    by_level = [_level_items(level).select("t", F.struct(F.lit(k).alias("level"), "items").alias("level")) for k, level in enumerate(levels)]
    stacked = functools.reduce(DataFrame.unionByName, by_level).groupBy("t").agg(F.collect_list("level").alias("levels"))
    stacked = known.join(stacked, "t").select("t", "c", "n_bytes", "places", "levels")
    state = written(mapped(stacked, _joined_levels, _STATE), "repeat-state")
    discard(*levels)
    reclaim(spark)

    covers = written(mapped(state, _covers(width), _COVERS), "repeat-covers")
    kinds = covers.groupBy(*_RUN).agg(F.sum("c").alias("m"), F.min(F.struct("t", "j")).alias("rep")).where("m > 1")
    # written, here and below, so that the join deals both sides out anew and the rows of a frequent run can be split
    kinds = written(kinds, "repeat-kinds")
    settled = covers.join(_hashed(kinds), _RUN).select("t", F.struct("j", (F.struct("t", "j") == F.col("rep")).alias("is_rep")).alias("x"))
    settled = settled.groupBy("t").agg(F.collect_list("x").alias("settled"))
    cut = state.join(settled, "t", "left").select("t", "c", "n_bytes", "places", "items", F.coalesce("settled", F.array().cast("array<struct<j:int,is_rep:boolean>>")).alias("settled"))
    cut = written(mapped(cut, _cut_pieces(width), _PIECES), "repeat-pieces")
    discard(covers, state, kinds)
    reclaim(spark)
    # inner runs that an open piece shares with another piece
    alike = cut.where("n > 0").groupBy(*_RUN).agg(F.sum("c").alias("m"), F.max("open").alias("o")).where("m > 1 and o").select(_RUN)
    alike = written(alike, "repeat-shared")
    matched = cut.where("n > 0").join(_hashed(alike), _RUN)
    wanted = matched.groupBy("t").agg(F.collect_list(F.struct("lo", "hi", "n", "r1", "r2", "a", "z", "open", "c")).alias("wanted"))
    wanted = written(known.select("t", "k1", "k2").join(wanted, "t"), "repeat-wanted")
    span = lambda r, lo, hi: r.select("t", F.struct(F.col(lo).cast("int").alias("start"), (F.col(hi) + width).cast("int").alias("end")).alias("span"))
    sure = written(span(cut.where("n = 0"), "lo", "hi"), "repeat-settled")
    discard(cut)
    reclaim(spark)
    ends = written(mapped(found.join(wanted, ["k1", "k2"]).select("t", F.col("text"), "wanted"), _with_ends(width), _ENDS), "repeat-ends")
    discard(wanted)
    reclaim(spark)
    # the text of a row that is one of a few copies comes once for each of them
    folded = ends.groupBy("h1", "h2").agg(F.sum("c").alias("m"), F.max("open").alias("o"), F.min("run").alias("run"), F.min(F.struct("t", "lo")).alias("rep"))
    folded = written(folded, "repeat-folded")
    alike = written(span(ends.where("open").join(_hashed(folded.where("m > 1 and o").select("h1", "h2")), ["h1", "h2"], "left_semi"), "lo", "hi"), "repeat-alike")
    want = (F.col("m") == 1) & F.col("o")
    mixed = folded.groupBy("run").agg(F.count(F.lit(1)).alias("d"), F.max(want).alias("u")).where("d > 1 and u").select("run")
    reps = folded.join(_hashed(mixed), "run", "left_semi").select("rep.t", "rep.lo", "m", want.alias("want"))
    single = ends.join(reps, ["t", "lo"]).dropDuplicates(["t", "lo"]).select("run", "l_lo", "l_hi", "ends", "m", "t", "lo", "want")
    single = written(mapped(single, _single_windows, _WINDOWS), "repeat-windows")
    discard(ends, folded)
    reclaim(spark)
    several = single.groupBy("h1", "h2").agg(F.sum("m").alias("times"), F.max("want").alias("w")).where("times > 1 and w").select("h1", "h2")
    spans = sure.unionByName(alike).unionByName(span(single.where("want").join(_hashed(several), ["h1", "h2"]), "s", "s"))
    by_text = written(known.where("c < 2").select("t", "k1", "k2").join(spans.groupBy("t").agg(F.collect_list("span").alias("found")), "t").select("k1", "k2", "found"), "repeat-spans")
    discard(sure, alike, single)
    reclaim(spark)
    return by_text, known.select("k1", "k2", "c", "n_bytes")


def _cut(with_kept: bool, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            sizes, removed, spans, digests, kept_texts = [], [], [], [], []
            owner, items = _flat(b.column(2))
            start, end = (_numbers(items.field(i)).astype(np.int64) for i in range(2))
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order], end[order]
            begin = np.searchsorted(owner, np.arange(b.num_rows + 1))
            for i, (text, copied) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                s, e = start[begin[i] : begin[i + 1]], end[begin[i] : begin[i + 1]]
                if copied and len(text) >= width:
                    s, e = np.zeros(1, np.int64), np.full(1, len(text))
                if len(s):
                    far = np.maximum.accumulate(e)
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > far[:-1]]))
                    s, e = s[new], far[np.concatenate([new[1:], [len(far)]]) - 1]
                edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append([{"start": a, "end": z} for a, z in zip(s.tolist(), e.tolist(), strict=True)])
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_kept:
                    kept_texts.append(kept)
            out = [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string())]
            names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            yield pa.record_batch([*out, pa.array(kept_texts, pa.binary())] if with_kept else out, names=[*names, "kept"] if with_kept else names)

    return run


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, with_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_bytes, n_removed, spans, kept_sha256`` and, if asked for, the remaining bytes ``kept``.

    A byte goes if a string of ``width`` bytes (16 at least) that covers it also starts anywhere else, in this or
    another document; strings don't cross documents and are judged on the input.  Spans are
    maximal removed stretches, in bytes.  Null texts are empty; texts shorter than ``width`` stay;
    equal rows remove each other.  Ids (of any type) are only carried along, other columns are ignored.
    An empty table gives an empty result.  Very long texts are sampled piece by piece.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width is {2 * GRAM} at least")
    rows = named(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.select("id", "text", *text_keys(F.col("text")))
    # a text that many rows repeat: fewer than HOT_PARTS of them by counting, so they are broadcast and their rows stay put
    sizes = rows.where(F.octet_length("text") >= width).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes.where("rows > 1"), "repeat-copies")
    hot = sizes.where(F.col("rows") > max(100, docs.count() // HOT_PARTS)).select("k1", "k2", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), ["k1", "k2"], "left")
    # a hot text is searched once; it counts as copied all the same
    one = written(marked.where("hot").groupBy("k1", "k2").agg(F.any_value("text").alias("text")), "repeat-hot")
    spans, texts = repeated_spans(marked.where("hot is null").select("k1", "k2", "text").unionByName(one).unionByName(one), width)
    copied = texts.where("c > 1").select("k1", "k2", F.lit(True).alias("copied"))
    no_span = F.array().cast("array<struct<start:int,end:int>>")
    cold = spans.withColumn("copied", F.lit(False)).unionByName(copied.select("k1", "k2", no_span.alias("found"), "copied"))
    joined = marked.where("hot is null").join(cold, ["k1", "k2"], "left").select("id", "text", F.coalesce("found", no_span).alias("found"), F.coalesce("copied", F.lit(False)).alias("copied"))
    joined = joined.unionByName(marked.where("hot").select("id", "text", no_span.alias("found"), F.lit(True).alias("copied")))
    kind = dict(rows.dtypes)["id"]
    return mapped(joined, _cut(with_kept, width), f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_kept)


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")
