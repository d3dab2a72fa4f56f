"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

1. *Sets.*  A text is the set of its word shingles.  Texts with equal sets are one node.
2. *Signatures.*  ``chunks`` x ``CHUNK`` MinHash values of ``BITS`` bits.  Two signatures within
   Hamming distance 2 * chunks - 1 (in values) have, by the pigeonhole principle, a chunk with at
   most one differing value.  Enumerating that one error - each chunk once without each of its
   values - gives keys that every pair under the distance must share; the number of chunks is
   chosen so that pairs at the similarity limit share a key but for a chance of ``MISS``.
3. *Families.*  Nodes that share keys are tied to the key's smallest node (a star, not all pairs),
   and connected components of those stars are families: every pair that shares a key, and so
   every linked pair, lies inside one family.
4. *Links.*  A family is dealt into blocks of bounded size.  Inside a block the pairs that share a
   key are the candidates.  They are confirmed on their full sets by matrix
   products, and only a spanning forest of the links leaves the task.
   Families of several blocks are contracted by these links, dealt again so that a component's
   nodes lie together, and pairs of blocks are compared unless one component covers both.
5. *Components* of the links are the groups; the smallest id in each stays.
"""

from __future__ import annotations

import functools
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U, mix, shingle_sets
from .common import give_back, mapped, named, reclaim, written
from .components import components
from .repeats import text_keys

#: Values in a chunk, bits kept of a value, chance to miss a pair at the limit of similarity.
CHUNK, BITS, MISS = 5, 16, 1e-6
#: Shingles and nodes in a block: what one task compares at once (twice that for a pair of blocks).
BLOCK_SHINGLES, BLOCK_NODES = 1_000_000, 768


def chunks_for(similarity: float, miss: float = MISS) -> int:
    """The number of chunks that leaves a chance of ``miss`` for a pair at the limit to share no key."""
    one = similarity**CHUNK + CHUNK * (1 - similarity) * similarity ** (CHUNK - 1)
    return max(2, math.ceil(math.log(miss) / math.log(1 - one)))


@functools.cache
def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """MinHash values (low ``BITS`` bits) of non-empty sets, one row each."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), values), U)
    for k, seed in enumerate(_seeds(values)):
        x = joined * seed
        out[:, k] = np.minimum.reduceat(x ^ (x >> U(31)), starts)
    return mix(out) & U((1 << BITS) - 1)


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """The keys of each signature: chunk by chunk, its values but one; rows of chunks * CHUNK keys."""
    n, values = sigs.shape
    out = np.empty((n, values), U)
    for c in range(values // CHUNK):
        for skip in range(CHUNK):
            h = np.full(n, U(c * CHUNK + skip + 1), U)
            for j in range(CHUNK):
                if j != skip:
                    h = mix(h * U(0x9E3779B97F4A7C15) + sigs[:, c * CHUNK + j])
            out[:, c * CHUNK + skip] = h
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _node(s: np.ndarray) -> bytes | None:
    """Two independent 64-bit sums over a set stand for it; none for the empty set."""
    if len(s) == 0:
        return None
    return b"".join(int(mix(s ^ U(salt)).sum(dtype=U)).to_bytes(8, "big") for salt in (0, 0xA5A5A5A5A5A5A5A5))


def _runs(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _sketch(words: int, values: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (r for b in batches for r in _runs(b)):
            sets = shingle_sets(_bytes(b.column(1)), words, key)
            n = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            sigs = signatures(full, values) if full else np.zeros((0, values), U)
            packed = iter(s.tobytes() for s in sigs.astype(np.uint16))
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(n), pa.array([_node(s) for s in sets], pa.binary()), pa.array([next(packed) if len(s) else None for s in sets], pa.binary())], names=["id", "k1", "k2", "n_shingles", "node", "sig"])

    return run


def _listed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, keys``: made from the signatures whenever they are needed, since they take four times their room on disk."""
    for b in (r for b in batches for r in _runs(b) if r.num_rows):
        sigs = np.stack([np.frombuffer(s, np.uint16) for s in b.column("sig").to_pylist()]).astype(U)
        keys = index_keys(sigs)
        offsets = np.arange(len(sigs) + 1, dtype=np.int32) * np.int32(keys.shape[1])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
        yield pa.record_batch([b.column("node"), lists], names=["node", "keys"])


def _sets(words: int, key: bytes):
    """Shingle sets of the wanted nodes; an id that several texts share may bring others, which are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (r for b in batches for r in _runs(b)):
            sets = shingle_sets(_bytes(b.column("text")), words, key)
            wanted = pa.array([_node(s) == w for s, w in zip(sets, b.column("node").to_pylist(), strict=True)])
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.record_batch([b.column("node"), b.column("family"), b.column("block"), packed, b.column("sig")], names=["node", "family", "block", "shingles", "sig"]).filter(wanted)

    return run


def sharing_keys(sigs: np.ndarray) -> np.ndarray:
    """Which two of the signatures share a key: in some chunk they differ in one value at most.

    All pairs within distance 2 * chunks - 1 do, by the pigeonhole principle, and most pairs beyond it.
    """
    near = np.zeros((len(sigs), len(sigs)), bool)
    for c in range(0, sigs.shape[1], CHUNK):
        differ = np.zeros(near.shape, np.uint8)
        for value in sigs[:, c : c + CHUNK].T:
            differ += value[:, None] != value[None, :]
        near |= differ <= 1
    return near


def linked_forest(sets: list[np.ndarray], sigs: np.ndarray, split: int | None, per_cent: int) -> list[tuple[int, int]]:
    """(member, its component's first member) under the links between the sets.

    With ``split``, only pairs of a set before it with one from it on count.  A pair is linked when its
    signatures share a key of the index and 100 * |intersection| >= per_cent * |union|.
    """
    near = sharing_keys(sigs)
    if split is not None:
        near[:split, :split] = False
        near[split:, split:] = False
    np.fill_diagonal(near, False)
    # sets without a candidate take no part
    rows = np.flatnonzero(near.any(axis=1))
    if len(rows) == 0:
        return []
    found = _confirmed([sets[i] for i in rows], near[np.ix_(rows, rows)], per_cent)
    return [(int(rows[j]), int(rows[i])) for j, i in found]


def _confirmed(sets: list[np.ndarray], near: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    shingle, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    df = np.bincount(column, minlength=len(shingle))
    shared = df[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.cumsum(np.concatenate([[0], np.diff(column[order]) > 0])) if len(column) else column
    inter = np.zeros((n, n), np.float32)
    width = max(64, (8 << 20) // max(1, n))
    total = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, width):
        a, z = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((n, min(width, total - lo)), np.float32)
        x[row[a:z], column[a:z] - lo] = 1
        inter += x @ x.T
    link = 100 * inter.astype(np.float64) >= per_cent * (sizes[:, None] + sizes[None, :] - inter)
    link &= near
    out, seen = [], np.zeros(n, bool)
    for i in range(n):
        if seen[i]:
            continue
        seen[i], front = True, np.array([i])
        while len(front):
            reach = np.flatnonzero(link[front].any(axis=0) & ~seen)
            seen[reach] = True
            out += [(int(j), i) for j in reach]
            front = reach
    return out


_EDGES = "a binary, b binary"


def _compare(per_cent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, sides = table.column("node").to_pylist(), table.column("side").to_pylist()
        # a node may come twice, with one set
        order = [i for _, _, i in sorted({(sides[i], nodes[i]): (sides[i], nodes[i], i) for i in range(len(nodes))}.values())]
        sets = [np.frombuffer(table.column("shingles")[i].as_buffer(), U) for i in order]
        split = sum(sides[i] == 0 for i in order) if any(sides) else None
        sigs = np.stack([np.frombuffer(table.column("sig")[i].as_buffer(), np.uint16) for i in order])
        pairs = linked_forest(sets, sigs, split, per_cent) if len(sets) > 1 else []
        if len(sets) > BLOCK_NODES // 2:
            give_back()
        return pa.table({"a": pa.array([nodes[order[i]] for i, _ in pairs], pa.binary()), "b": pa.array([nodes[order[j]] for _, j in pairs], pa.binary())})

    return run


def _deal(members: DataFrame) -> DataFrame:
    """Adds ``blocks`` and ``block``: a family of one block is compared in one task, a larger one is dealt by a hash of the node."""
    family = members.groupBy("family").agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("nodes"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("nodes") / BLOCK_NODES))
    # written, so that the join deals both sides out anew and a large family's rows can be split
    family = written(family.select("family", blocks.cast("long").alias("blocks")), "near-families")
    return written(members.join(family, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "near-blocks")


def _links(sets: DataFrame, dealt: DataFrame, per_cent: int) -> DataFrame:
    """Links inside each block, then between the blocks of large families."""
    inside = sets.withColumn("side", F.lit(0))
    first = written(inside.groupBy("family", "block").applyInArrow(_compare(per_cent), _EDGES), "near-links")
    large = dealt.where("blocks > 1").select("node", "family", "n_shingles")
    if large.isEmpty():
        return first
    # contract: the nodes of one component are dealt to blocks of their own, small components share blocks
    merged = large.join(components(first.join(large.select(F.col("node").alias("a")), "a", "left_semi")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    comp = merged.groupBy("family", "component").agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("nodes"))
    weight = F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("nodes") / BLOCK_NODES)
    comp = comp.withColumn("own", F.when(weight >= 0.5, F.ceil(weight)).otherwise(F.lit(0)).cast("long")).withColumn("weight", weight)
    packs = comp.groupBy("family").agg(F.ceil(F.sum(F.when(F.col("own") == 0, F.col("weight")).otherwise(F.lit(0.0)))).cast("long").alias("packs"))
    place = F.when(F.col("own") > 0, F.xxhash64("component", F.pmod(F.xxhash64("node"), F.greatest("own", F.lit(1))))).otherwise(F.pmod(F.xxhash64("component"), F.greatest("packs", F.lit(1))))
    placed = written(merged.join(comp.select("family", "component", "own"), ["family", "component"]).join(packs, "family").withColumn("block", place).select("node", "family", "component", "block"), "near-placed")
    block = placed.groupBy("family", "block").agg(F.when(F.min("component") == F.max("component"), F.min("component")).alias("only"))
    block = written(block, "near-large-blocks")
    right = block.select("family", F.col("block").alias("block_b"), F.col("only").alias("only_b"))
    # blocks, not nodes, are paired here; a block holds hundreds of nodes
    pairs = block.join(right, "family").where((F.col("block") <= F.col("block_b")) & ~F.coalesce(F.col("only") == F.col("only_b"), F.lit(False)))
    pairs = pairs.select("family", "block", "block_b").withColumn("pair", F.xxhash64("family", "block", "block_b"))
    sides = F.when(F.col("block") == F.col("block_b"), F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side"))))
    sides = pairs.select("family", "pair", F.explode(sides).alias("s")).select("family", "pair", "s.block", "s.side")
    needed = placed.join(sides, ["family", "block"]).select("node", "pair", "side")
    second = sets.select("node", "shingles", "sig").join(needed, "node").groupBy("pair").applyInArrow(_compare(per_cent), _EDGES)
    return written(first.unionByName(second), "near-links-all")


def near_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept, group, k1, k2``.

    A-Z are folded; words are runs of characters other than U+0020 and U+0009-U+000D.  A text with
    fewer words than a shingle is one shingle; null texts and texts without words have none and
    link with nothing, so they are their own component.  Copies, repeated rows among them, share a
    component.  Null ids link like others but never name a component unless nothing else can.
    An empty table gives an empty result.  ``similarity`` counts in whole per cents.  ``group`` names
    the component also where ids are null or repeated (null without shingles), k1 and k2 the text.
    """
    per_cent = round(100 * similarity)
    values = chunks_for(similarity) * CHUNK
    # hashes differ from run to run, so that no text can be made to share another's; groups don't
    key = os.urandom(16)
    rows = named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    keyed_rows = rows.select("id", "text", *text_keys(F.col("text")))
    sketch = written(mapped(keyed_rows, _sketch(words, values, key), "id long, k1 long, k2 long, n_shingles long, node binary, sig binary"), "near-sketch")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    nodes = written(nodes.select("node", F.col("rep.id").alias("least_id"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), "n_shingles", "sig"), "near-nodes")
    keyed = mapped(nodes.select("node", "sig"), _listed_keys, "node binary, keys array<long>").select("node", F.explode("keys").alias("key"))
    # copies of a set were folded above, so a key's rows are different sets; partial aggregation folds hot keys
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
    stars = keyed.join(pivots.select("key", "pivot"), "key").where("node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    reclaim(docs.sparkSession)
    family = components(stars).select("node", F.col("component").alias("family"))
    # the keys' shuffles are the largest of all and done with: they go before the texts are shuffled
    reclaim(docs.sparkSession)
    dealt = _deal(family.join(nodes.select("node", "n_shingles", "least_id", "k1", "k2", "sig"), "node"))
    texts = _one_text(keyed_rows, sketch, dealt)
    sets = written(mapped(texts, _sets(words, key), "node binary, family binary, block long, shingles binary, sig binary"), "near-sets")
    reclaim(docs.sparkSession)
    return _assemble(sketch, nodes, _links(sets, dealt, per_cent))


def _one_text(rows: DataFrame, sketch: DataFrame, dealt: DataFrame) -> DataFrame:
    """``node, family, block, sig, text``: the text of one row of each node that has company; the same folding makes its set again.

    The row is known by its text's keys and its id.  Where rows repeat both, or have no id, their
    texts are folded first, so that copies never meet as texts.
    """
    # grows with the corpus and is no candidate for a broadcast at any size
    wanted = dealt.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("least_id").alias("w"), "node", "family", "block", "sig")
    this = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("w"))
    times = sketch.select("id", "k1", "k2").join(wanted.select("w1", "w2", "w", "node").hint("merge"), this).groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    several = written(times.where("times > 1").select("node"), "near-repeated-rows")
    if several.isEmpty():
        return rows.join(wanted.hint("merge"), this).select("node", "family", "block", "sig", "text")
    once = wanted.join(several, "node", "left_anti").hint("merge")
    single = rows.join(once, this).select("node", "family", "block", "sig", "text")
    more = wanted.join(several, "node", "left_semi")
    folded = rows.join(more.select("w1", "w2", "w", "node").hint("merge"), this).groupBy("node").agg(F.any_value("text").alias("text"))
    return single.unionByName(folded.join(more.select("node", "family", "block", "sig"), "node").select("node", "family", "block", "sig", "text"))


def _assemble(sketch: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the links, named by the least id in each, for every row."""
    comps = components(links)
    # few rows: only nodes with a link
    named_by = comps.join(nodes.select("node", "least_id"), "node")
    least = named_by.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = written(named_by.join(least, "component").select("node", "component", "component_id"), "near-components")
    label = nodes.select("node", "least_id").join(linked, "node", "left")
    label = written(label.select("node", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")), "near-labels")
    out = sketch.select("id", "k1", "k2", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", component.alias("component_id"), "group", "k1", "k2").withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group, the one with the least id (null last); those without words all stay.

    Of rows that repeat both id and text, one stays.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    groups = near_groups(docs, **options).where("group is not null")
    least = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("w"))
    stay = written(least.select(F.col("w.id").alias("_id"), F.col("w.k1").alias("_k1"), F.col("w.k2").alias("_k2")), "near-stay")
    repeated = groups.groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    once = repeated.isEmpty()
    reclaim(docs.sparkSession)
    k1, k2 = text_keys(F.col(f"`{text_col}`"))
    has_words = F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(has_words).withColumns({"_a1": k1, "_a2": k2})
    found = keyed.join(stay, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.col("_a1") == F.col("_k1")) & (F.col("_a2") == F.col("_k2")), "left_semi")
    # without repeated rows the texts needn't be shuffled once more to fold them
    found = found if once else found.dropDuplicates([id_col, "_a1", "_a2"])
    return found.drop("_a1", "_a2").unionByName(docs.where(~has_words))
