"""Edits of skeletons.  Tables are immutable: every edit gives new node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, components, degree, dense_ids, subtree, twig_members

#: Order in which type codes win a tied vote (fixed values).
LABEL_PRIORITY = (1, -1, 2, 3, 4, 5, 6, 0)


def norm_edges(edges: DataFrame) -> DataFrame:
    """Sorted ends, no loops, no repeats."""
    return edges.select("skel_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges under ``mapping(skel_id, node_id, new_id)``; an edge that loses an end or becomes a loop goes."""
    a = mapping.select("skel_id", F.col("node_id").alias("u"), F.col("new_id").alias("nu"))
    b = mapping.select("skel_id", F.col("node_id").alias("v"), F.col("new_id").alias("nv"))
    return norm_edges(edges.join(a, ["skel_id", "u"]).join(b, ["skel_id", "v"]).select("skel_id", F.col("nu").alias("u"), F.col("nv").alias("v")))


def keep_nodes(nodes: DataFrame, edges: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes for which ``kept`` holds, and always node 0, numbered densely, with their edges."""
    left = nodes.where(kept | (F.col("node_id") == 0))
    ids = dense_ids(left)
    return left.join(ids, ["skel_id", "node_id"]).drop("node_id").withColumnRenamed("new_id", "node_id"), remap_edges(edges, ids)


def keep_listed(nodes: DataFrame, edges: DataFrame, listed: DataFrame, *, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    # the list may be as long as the nodes, whatever it was taken from
    on = listed.select("skel_id", "node_id").distinct().withColumn("_on", F.lit(True)).hint("merge")
    marked = nodes.join(on, ["skel_id", "node_id"], "left")
    on = F.coalesce("_on", F.lit(False))
    n, e = keep_nodes(marked, edges, ~on if drop else on)
    return n.drop("_on"), e


def rebuild_vert2node(node_vert: DataFrame) -> DataFrame:
    """One node per vertex: the highest id where several claim it."""
    return node_vert.groupBy("skel_id", "vert_id").agg(F.max("node_id").alias("node_id"))


def swap_ids(nodes: DataFrame, edges: DataFrame, swaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exchange two node ids per skeleton; ``swaps``: skel_id, a, b."""
    def swapped(c: str) -> Column:
        return F.when(F.col(c) == F.col("a"), F.col("b")).when(F.col(c) == F.col("b"), F.col("a")).otherwise(F.col(c))

    n = nodes.join(swaps, "skel_id", "left").withColumn("node_id", swapped("node_id")).drop("a", "b")
    e = edges.join(swaps, "skel_id", "left").select("skel_id", swapped("u").alias("u"), swapped("v").alias("v"))
    return n, norm_edges(e)


def graft(edges: DataFrame, added: DataFrame, *, nodes: DataFrame | None = None, allow_cycle: bool = True) -> DataFrame:
    """Edges with the added ones; repeats don't matter.  Without cycles, an edge inside one component is left out."""
    if not added.where("u = v").isEmpty():
        raise ValueError("an edge needs two different ends")
    if not allow_cycle:
        c = components(nodes, edges)
        a = c.select("skel_id", F.col("node_id").alias("u"), F.col("component").alias("cu"))
        b = c.select("skel_id", F.col("node_id").alias("v"), F.col("component").alias("cv"))
        added = added.join(a, ["skel_id", "u"]).join(b, ["skel_id", "v"]).where("cu <> cv").select("skel_id", "u", "v")
    return norm_edges(edges.select("skel_id", "u", "v").unionByName(added.select("skel_id", "u", "v")))


def clip(nodes: DataFrame, edges: DataFrame, cut: DataFrame, *, drop_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
    """Removes edges; with ``drop_orphans`` also what the root no longer reaches."""
    left = norm_edges(edges).join(norm_edges(cut), ["skel_id", "u", "v"], "left_anti")
    if not drop_orphans:
        return nodes, left
    return keep_listed(nodes, left, components(nodes, left).where("component = 0"))


def prune(nodes: DataFrame, edges: DataFrame, kind: str = "twigs", *, num_nodes: int | None = None, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``twigs``: all twigs of at most ``num_nodes`` nodes go.  ``nodes``: the listed ones go, but for the root and hubs that would still join two nodes."""
    if kind == "twigs" and num_nodes is not None:
        return keep_listed(nodes, edges, twig_members(nodes, edges, num_nodes), drop=True)
    if kind == "nodes" and listed is not None:
        gone = listed.select("skel_id", "node_id").where("node_id <> 0").distinct()
        return keep_listed(nodes, edges, gone.join(_staying_hubs(edges, gone), ["skel_id", "node_id"], "left_anti"), drop=True)
    raise ValueError("prune needs kind 'twigs' with num_nodes or kind 'nodes' with listed")


def _staying_hubs(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Listed hubs that still join two nodes when their turn comes, by ascending id; one that stays counts for those after it.

    Only listed hubs go through Python, each with its number of unlisted neighbours and its listed hub neighbours.
    """
    both = both_ways(norm_edges(edges))
    hubs = both.groupBy("skel_id", "node_id").agg(F.count(F.lit(1)).alias("degree")).where("degree > 2").join(gone, ["skel_id", "node_id"]).select("skel_id", "node_id")
    around = both.join(hubs, ["skel_id", "node_id"], "left_semi")
    around = around.join(gone.select("skel_id", F.col("node_id").alias("other"), F.lit(True).alias("listed")), ["skel_id", "other"], "left")
    around = around.join(hubs.select("skel_id", F.col("node_id").alias("other"), F.lit(True).alias("hub")), ["skel_id", "other"], "left")
    rows = around.groupBy("skel_id", "node_id").agg(F.count_if(F.col("listed").isNull()).alias("free"), F.collect_list(F.when(F.col("hub"), F.col("other"))).alias("hubs"))

    def judge(t):
        t, kept = t.sort_values("node_id"), set()
        for node, free, near in zip(t["node_id"], t["free"], t["hubs"], strict=True):
            if free + sum(h in kept for h in near) >= 2:
                kept.add(node)
        return t.loc[t["node_id"].isin(kept), ["skel_id", "node_id"]]

    kinds = dict(edges.dtypes)
    return rows.groupBy("skel_id").applyInPandas(judge, f"skel_id {kinds['skel_id']}, node_id {kinds['u']}")


def set_ntype(nodes: DataFrame, code: int, *, root: int | None = None, listed: DataFrame | None = None, subtrees: bool = True) -> DataFrame:
    """A type code for a subtree or for listed nodes; node 0 keeps its own."""
    if (root is None) == (listed is None):
        raise ValueError("give either root or listed")
    target = listed if root is None else (subtree(nodes, root) if subtrees else nodes.where(F.col("node_id") == root))
    on = target.select("skel_id", "node_id").distinct().withColumn("_on", F.lit(True))
    out = nodes.join(on, ["skel_id", "node_id"], "left")
    return out.withColumn("ntype", F.when(F.col("_on") & (F.col("node_id") != 0), F.lit(code)).otherwise(F.col("ntype"))).drop("_on")


def extreme_nodes(nodes: DataFrame, edges: DataFrame, axis: str, *, largest: bool = True, prefer_leaves: bool = True) -> DataFrame:
    """``skel_id, node_id``: the end of each skeleton along an axis, among its leaves if it has some; ties by id."""
    if axis not in ("x", "y", "z"):
        raise ValueError("axis is x, y or z")
    d = nodes.join(degree(nodes, edges), ["skel_id", "node_id"])
    along = -F.col(axis) if largest else F.col(axis)
    key = F.struct((F.col("degree") != 1).alias("l") if prefer_leaves else F.lit(0).alias("l"), along.alias("c"), "node_id")
    return d.groupBy("skel_id").agg(F.min_by("node_id", key).alias("node_id"))


def reroot(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each skeleton's target (skel_id, node_id) becomes node 0 and its only root label."""
    n, e = swap_ids(nodes, edges, targets.select("skel_id", F.lit(0).cast("long").alias("a"), F.col("node_id").alias("b")))
    label = F.when(F.col("node_id") == 0, F.lit(1)).when(F.col("ntype").isin(1, -1), F.lit(0)).otherwise(F.col("ntype"))
    return n.withColumn("ntype", label), e


def label_vote(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """``skel_id, new_id, ntype``: the most frequent non-zero label of the merged nodes, ties by priority, 0 if all are 0."""
    rank = F.array_position(F.array(*(F.lit(c) for c in LABEL_PRIORITY)), F.col("ntype"))
    rows = nodes.join(mapping, ["skel_id", "node_id"]).groupBy("skel_id", "new_id", "ntype").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("skel_id", "new_id").orderBy(F.col("ntype") == 0, F.desc("n"), rank)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("skel_id", "new_id", "ntype")


def prune_neurites(nodes: DataFrame, edges: DataFrame, somas: DataFrame, *, extent: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Branches of the root whose farthest node lies within ``extent`` cell body radii of its centre merge into node 0.

    ``somas``: skel_id, cx, cy, cz, radius.  A branch is what hangs together without the root.
    """
    others = nodes.where("node_id <> 0")
    branch = components(others, edges.where("u <> 0 and v <> 0"))
    at_root = both_ways(edges).where("other = 0").select("skel_id", "node_id").join(branch, ["skel_id", "node_id"]).select("skel_id", "component").distinct()
    d = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    far = others.select("skel_id", "node_id", "x", "y", "z").join(branch, ["skel_id", "node_id"]).join(somas, "skel_id").groupBy("skel_id", "component").agg(F.max(d).alias("farthest"), F.first("radius").alias("radius"))
    short = far.where(F.col("farthest") <= extent * F.col("radius")).join(at_root, ["skel_id", "component"], "left_semi")
    return keep_listed(nodes, edges, branch.join(short, ["skel_id", "component"], "left_semi").select("skel_id", "node_id"), drop=True)


def merge_near_soma(nodes: DataFrame, edges: DataFrame, somas: DataFrame, radius: str, *, near: float = 1.2, fat: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Nodes inside the cell body, or near it and fat, merge into node 0; their neighbours attach to it.

    ``somas``: skel_id, cx, cy, cz, radius.
    """
    d = [F.col(c) - F.col(f"c{c}") for c in "xyz"]
    dist = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    merged = (dist <= F.col("soma_r")) | ((dist < near * F.col("soma_r")) & (F.col(radius) > fat * F.col("soma_r")))
    s = somas.select("skel_id", "cx", "cy", "cz", F.col("radius").alias("soma_r"))
    goes = nodes.join(s, "skel_id").where((F.col("node_id") != 0) & merged).select("skel_id", "node_id")
    left = nodes.join(goes, ["skel_id", "node_id"], "left_anti")
    ids = dense_ids(left)
    mapping = ids.unionByName(goes.withColumn("new_id", F.lit(0).cast("long")))
    return left.join(ids, ["skel_id", "node_id"]).drop("node_id").withColumnRenamed("new_id", "node_id"), remap_edges(edges, mapping)
