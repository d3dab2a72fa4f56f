"""Sharding by a k-d tree over metadata.

Copies of one text belong together, so the tree splits *groups* of equal texts, each a point in
metadata space (length, language, source, first id, spread hash) weighted by the bytes of all its
members.  A node splits along its widest dimension, measured against the dimension's whole range,
at the weighted median; nodes at one depth are handled in the same jobs.  Medians are found by
histogram refinement: every round sums the weights in ``BINS`` bins per open node and keeps the bin
that holds the median, so the driver sees at most nodes x bins sums and no sort is needed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, written

BINS = 256
#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 4096
_DIMS = ("d_length", "d_kind", "d_first", "d_hash")


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per distinct text digest: weight in bytes, members, and coordinates in [0, 1) by rank-free scaling.

    Every coordinate but the hash is nudged by a small share of the hash, so equal metadata (one
    language, one source, one length) still has an interior to split.
    """
    g = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("members"), F.max("size").alias("length"), F.min(F.struct("lang", "source")).alias("kind"), F.min("id_num").alias("first"))
    jitter = (F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
    kind = F.pmod(F.xxhash64("kind.lang"), F.lit(64)) / 64.0 + F.pmod(F.xxhash64("kind.source"), F.lit(1024)) / 65536.0
    g = g.select("digest", "weight", "members", F.log2(F.col("length") + F.lit(1.0)).alias("d_length"), kind.alias("d_kind"), F.coalesce("first", F.lit(0)).cast("double").alias("d_first"), jitter.alias("d_hash"))
    return g.withColumns({"d_length": F.col("d_length") + F.col("d_hash") / 64, "d_kind": F.col("d_kind") + F.col("d_hash") / 65536, "d_first": F.col("d_first") + F.col("d_hash") / 2})


def _lookup(node: Column, values: dict[int, float]) -> Column:
    """A number for each node, from a literal of at most one entry per node."""
    return F.element_at(F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), "map<string,double>"), node.cast("string"))


def _weighted_cuts(points: DataFrame, axis: dict[int, str], spans: dict[int, tuple[float, float]], shares: dict[int, float], tolerance: float) -> dict[int, float]:
    """For each node the value on its axis below which about its share of the node's weight lies."""
    value = F.lit(None).cast("double")
    for d in set(axis.values()):
        value = F.when(F.col("node").isin([n for n, a in axis.items() if a == d]), F.col(d)).otherwise(value)
    lo, hi = ({n: s[i] for n, s in spans.items()} for i in (0, 1))
    below = dict.fromkeys(axis, 0.0)
    total: dict[int, float] = {}
    cuts: dict[int, float] = {}
    for _ in range(8):
        open_nodes = [n for n in axis if n not in cuts]
        if not open_nodes:
            break
        width = (_lookup(F.col("node"), {n: hi[n] - lo[n] for n in open_nodes})) / BINS
        offset = F.floor((F.col("value") - _lookup(F.col("node"), {n: lo[n] for n in open_nodes})) / width)
        rows = points.where(F.col("node").isin(open_nodes)).withColumn("value", value).withColumn("bin", F.least(F.greatest(F.when(width > 0, offset).otherwise(F.lit(0)), F.lit(-1)), F.lit(BINS))).groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect()
        hist: dict[int, dict[int, float]] = {n: {} for n in open_nodes}
        for r in rows:
            hist[r["node"]][r["bin"]] = float(r["w"])
        for n in open_nodes:
            total.setdefault(n, sum(hist[n].values()))
            want, have, step = shares[n] * total[n], hist[n].get(-1, 0.0), (hi[n] - lo[n]) / BINS
            # the topmost point of a span falls in the bin above it at first
            for b in range(BINS + 1):
                w = hist[n].get(b, 0.0)
                if have + w >= want or b == BINS:
                    break
                have += w
            under, over = want - have, have + w - want
            left = lo[n] + b * step
            if w <= tolerance * total[n] or step <= abs(left) * 1e-15 or b == BINS:
                cuts[n] = left if under <= over else left + step
            else:
                lo[n], hi[n] = left, left + step
                cuts_guess = left if under <= over else left + step
                below[n] = cuts_guess
    return {n: cuts.get(n, below[n]) for n in axis}


def kd_tree(points: DataFrame, leaves: int, *, tolerance: float = 2e-4) -> list[tuple[int, int, int, str, float]]:
    """Splits of a tree with the given number of leaves: ``(node, left, right, dimension, cut)``; leaves carry ids below ``leaves``.

    A node that owes k leaves splits its weight floor(k/2) : ceil(k/2), so any number of leaves
    comes out near equal.  A dimension's width counts relative to its range over all points.
    """
    splits: list[tuple[int, int, int, str, float]] = []
    level, next_node, next_leaf = {0: (leaves, 0)}, 1, 0
    names: dict[int, int] = {}
    if leaves == 1:
        return []
    whole: dict[str, float] = {}
    current = points.withColumn("node", F.lit(0))
    while level:
        spans = {r["node"]: r for r in current.where(F.col("node").isin(list(level))).groupBy("node").agg(*(f(d).alias(f"{d}_{k}") for d in _DIMS for k, f in (("lo", F.min), ("hi", F.max)))).collect()}
        axis, ranges = {}, {}
        for n in level:
            r = spans.get(n)
            widths = {d: (r[f"{d}_hi"] - r[f"{d}_lo"]) if r else 0.0 for d in _DIMS}
            whole = whole or {d: w or 1.0 for d, w in widths.items()}
            axis[n] = max(_DIMS, key=lambda d, w=widths: w[d] / whole[d])
            ranges[n] = (r[f"{axis[n]}_lo"], r[f"{axis[n]}_hi"]) if r else (0.0, 0.0)
        cuts = _weighted_cuts(current, axis, ranges, {n: (k // 2) / k for n, (k, _) in level.items()}, tolerance)
        below = {}
        for n, (k, _) in level.items():
            children = []
            for owed in (k // 2, k - k // 2):
                children.append(next_node)
                if owed > 1:
                    below[next_node] = (owed, 0)
                else:
                    names[next_node], next_leaf = next_leaf, next_leaf + 1
                next_node += 1
            splits.append((n, children[0], children[1], axis[n], cuts[n]))
        current = points.withColumn("node", _node_of(splits))
        level = below
    return [(n, l, r, d, c) for n, l, r, d, c in splits] + [(n, leaf, -1, "", 0.0) for n, leaf in names.items()]


def _node_of(tree: list[tuple[int, int, int, str, float]], *, as_leaf: bool = False) -> Column:
    """The deepest node (or its leaf number) a point falls into, as one nested expression."""
    inner = {n: (l, r, d, c) for n, l, r, d, c in tree if r >= 0}
    leaf = {n: k for n, k, r, _, _ in tree if r < 0}

    def at(n: int) -> Column:
        if n not in inner:
            return F.lit(leaf.get(n, 0) if as_leaf else n)
        l, r, d, c = inner[n]
        return F.when(F.col(d) < F.lit(c), at(l)).otherwise(at(r))

    return at(0)


def shard(docs: DataFrame, *, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: ``id, size, text_crc32, shard, slot``, shards near equal in bytes.

    Either ``shards`` is given, or ``target_bytes`` for a leaf.  Size: UTF-8 bytes of the text plus
    1.  Null texts count as empty; null ids, languages and sources have fixed coordinates.  Repeated
    rows have slots of their own.  An empty table gives an empty result.  A group of copies is never
    split, so shards differ by the weight of one group at most (and the tolerance of the medians).
    """
    rows = named(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = rows.select("id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"), F.col("id").cast("long").alias("id_num"))
    rows = written(rows, "shard-rows")
    points = written(groups_of(rows), "shard-points")
    if shards is None:
        total = points.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        shards = max(1, round(total / target_bytes))
    tree = kd_tree(points, shards)
    leaf = _node_of(tree, as_leaf=True) if tree else F.lit(0)
    # few rows per group on one side, many on the other when a group is hot: the join may split it
    out = rows.select("id", "size", "text_crc32", "digest").join(points.select("digest", leaf.cast("int").alias("shard")), "digest")
    return with_slots(out, rows.count())


def with_slots(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, numbering buckets of bounded size and adding the sums of lower buckets."""
    buckets = max(4, n // BUCKET_ROWS + 1)
    rows = written(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "digest"), F.lit(buckets))), "shard-placed")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "digest")) - 1
    return rows.join(starts, ["shard", "bucket"]).select("id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
