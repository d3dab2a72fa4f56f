"""Graph questions over many skeletons at once.

``node(skel_id, node_id, ...)`` and ``edge(skel_id, u, v)`` with u < v; node 0 is the root.  Walks
along trees are pointer jumping: every round doubles the reach of all pointers with one equi-join,
so the rounds grow with the logarithm of the depth, whatever the number of skeletons.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables: where the cluster shares one (``spark.checkpoint.dir``), else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/graph-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: What keeps paths of tables in the folder, and must forget them when it goes.
ON_RELEASE: list[Callable[[], None]] = []


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames derived from them can't be read afterwards, queries make them anew."""
    for forget in ON_RELEASE:
        forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: How much larger than packed on disk the rows of such tables are, about; Spark's own guess is 1, with which it broadcasts millions of rows through the driver.
UNPACKED = "32"
_FACTOR, _ALL_KEYS = "spark.sql.sources.fileCompressionFactor", "spark.sql.requireAllClusterKeysForCoPartition"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, told that files are packed (unless it has another factor than Spark's own) and that rows dealt out by a part of a join's keys need not be dealt out again."""
    if float(spark.conf.get(_FACTOR, "1.0")) == 1.0:
        spark.conf.set(_FACTOR, UNPACKED)
    spark.conf.set(_ALL_KEYS, "false")
    return spark


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A written table."""
    return prepared(spark).read.schema(schema).parquet(path)


#: A table of more bytes on disk has large shuffles behind it.
LARGE_BYTES = 8_000_000


def drop_shuffles(spark: SparkSession, path: str) -> None:
    """Frees the disk of the shuffles behind a table that has been written, if it is large: Spark deletes their files once the driver has collected its garbage, which may be never."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > LARGE_BYTES:
        spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """Written to the folder the cluster shares (or the warehouse) and read back, so a round never recomputes its predecessors.  It stays until ``release``."""
    spark = df.sparkSession
    path = scratch_path(spark, "round")
    df.write.parquet(path)
    drop_shuffles(spark, path)
    return stored(spark, path, df.schema)


def both_ways(edges: DataFrame) -> DataFrame:
    """``skel_id, node_id, other``: each edge from both of its ends."""
    ends = F.array(F.struct(F.col("u").alias("node_id"), F.col("v").alias("other")), F.struct(F.col("v").alias("node_id"), F.col("u").alias("other")))
    return edges.select("skel_id", F.inline(ends))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, node_id, degree``, 0 for nodes without an edge."""
    counted = both_ways(edges).groupBy("skel_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("skel_id", "node_id").join(counted, ["skel_id", "node_id"], "left").select("skel_id", "node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbors(edges: DataFrame, node_id: int | None = None) -> DataFrame:
    """``skel_id, node_id, other``, of one node id if given."""
    both = both_ways(edges).distinct()
    return both if node_id is None else both.where(F.col("node_id") == node_id)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, degree, n`` with the gaps filled by zeros, from degree 1 to the largest."""
    counted = degree(nodes, edges).where("degree > 0").groupBy("skel_id", "degree").agg(F.count(F.lit(1)).alias("n"))
    full = counted.groupBy("skel_id").agg(F.max("degree").alias("m")).select("skel_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("degree"))
    return full.join(counted, ["skel_id", "degree"], "left").select("skel_id", "degree", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def high_degree_nodes(nodes: DataFrame, edges: DataFrame, percentile: float = 99.5) -> DataFrame:
    """``skel_id, node_id, degree, threshold`` of nodes strictly above the percentile of their skeleton's degrees."""
    d = degree(nodes, edges)
    cut = d.groupBy("skel_id").agg(F.percentile("degree", percentile / 100).alias("threshold"))
    return d.join(cut, "skel_id").where("degree > threshold").select("skel_id", "node_id", "degree", "threshold")


def nodes_of_degree(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``skel_id, node_id`` of degree k; the root never counts."""
    if k < 0:
        raise ValueError("a degree is not negative")
    return degree(nodes, edges).where((F.col("degree") == k) & (F.col("node_id") != 0)).select("skel_id", "node_id")


def node_summary(nodes: DataFrame, edges: DataFrame, radius: str) -> DataFrame:
    """Degree and radius of each node, with its neighbours' as an array of structs by id."""
    own = degree(nodes, edges).join(nodes.select("skel_id", "node_id", F.col(radius).alias("radius")), ["skel_id", "node_id"])
    there = own.select("skel_id", F.col("node_id").alias("other"), F.col("degree").alias("d"), F.col("radius").alias("r"))
    near = both_ways(edges).join(there, ["skel_id", "other"]).groupBy("skel_id", "node_id").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("node_id"), F.col("d").alias("degree"), F.col("r").alias("radius")))).alias("neighbors"))
    return own.join(near, ["skel_id", "node_id"], "left")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``skel_id, node_id, component``: the least node id that can be reached.

    Each round takes the least label among the neighbours and then follows labels once, so labels
    travel exponentially far.
    """
    both = settled(both_ways(edges))
    labels = settled(nodes.select("skel_id", "node_id", F.col("node_id").alias("component")))
    for _ in range(max_rounds):
        there = labels.select("skel_id", F.col("node_id").alias("other"), F.col("component").alias("c"))
        least = both.join(there, ["skel_id", "other"]).groupBy("skel_id", "node_id").agg(F.min("c").alias("c"))
        hooked = labels.join(least, ["skel_id", "node_id"], "left").select("skel_id", "node_id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        onward = hooked.select("skel_id", F.col("node_id").alias("component"), F.col("component").alias("next"))
        jumped = settled(hooked.join(onward, ["skel_id", "component"]).select("skel_id", "node_id", F.col("next").alias("component"), (F.col("next") != F.col("old")).alias("moved")))
        labels = jumped.select("skel_id", "node_id", "component")
        if jumped.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, connected, n_components, isolated``: isolated nodes can't be reached from node 0."""
    c = components(nodes, edges)
    return c.groupBy("skel_id").agg((F.max("component") == 0).alias("connected"), F.count_distinct("component").alias("n_components"), F.sort_array(F.collect_list(F.when(F.col("component") != 0, F.col("node_id")))).alias("isolated"))


def acyclicity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, n_nodes, n_edges, n_components, acyclic``: a forest has as many edges as nodes less components."""
    c = components(nodes, edges).groupBy("skel_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("component").alias("n_components"))
    e = edges.groupBy("skel_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = c.join(e, "skel_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)).cast("long"))
    return out.withColumn("acyclic", F.col("n_edges") == F.col("n_nodes") - F.col("n_components"))


def parents_from_edges(nodes: DataFrame, edges: DataFrame, weights: Column | None = None, max_rounds: int = 100_000) -> DataFrame:
    """``skel_id, node_id, parent_id, depth`` of the breadth-first tree from node 0, by frontier joins; unreached nodes are absent.

    A node seen from several frontier nodes takes the least as its parent.
    """
    both = settled(both_ways(edges).distinct())
    seen = settled(nodes.where("node_id = 0").select("skel_id", "node_id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("depth")))
    front = seen
    for _ in range(max_rounds):
        reached = front.select("skel_id", "node_id", "depth").join(both, ["skel_id", "node_id"]).groupBy("skel_id", "other").agg(F.min("node_id").alias("parent_id"), F.min("depth").alias("d"))
        front = settled(reached.select("skel_id", F.col("other").alias("node_id"), "parent_id", (F.col("d") + 1).alias("depth")).join(seen.select("skel_id", "node_id"), ["skel_id", "node_id"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = settled(seen.unionByName(front))
    raise RuntimeError("the graph is deeper than the number of rounds")


def climb(tree: DataFrame, stop: Column | None = None, max_rounds: int = 40) -> DataFrame:
    """Pointer jumping on ``tree(skel_id, node_id, parent_id, step[, is_stop])``.

    Gives ``skel_id, node_id, top, hops, length``: the first ancestor at which ``stop`` holds (the
    root without it), the edges to it and their summed ``step``.  The root is its own top.
    """
    marked = tree.withColumn("is_stop", F.col("parent_id").isNull() if stop is None else F.col("parent_id").isNull() | stop)
    halt = marked.select("skel_id", F.col("node_id").alias("top"), F.col("is_stop").alias("done"))
    start = marked.select("skel_id", "node_id", F.coalesce("parent_id", "node_id").alias("top"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("parent_id").isNull(), 0.0).otherwise(F.col("step")).alias("length"))
    at = settled(start.join(halt, ["skel_id", "top"]))
    for _ in range(max_rounds):
        if at.where("not done").isEmpty():
            return at.select("skel_id", "node_id", "top", "hops", "length")
        onward = at.select("skel_id", F.col("node_id").alias("top"), F.col("top").alias("t"), F.col("hops").alias("h"), F.col("length").alias("l"), F.col("done").alias("d"))
        still = at.where("not done").join(onward, ["skel_id", "top"]).select("skel_id", F.col("t").alias("top"), "node_id", (F.col("hops") + F.col("h")).alias("hops"), (F.col("length") + F.col("l")).alias("length"), F.col("d").alias("done"))
        at = settled(at.where("done").unionByName(still))
    raise RuntimeError("the parent pointers hold a cycle")


def tree_of(nodes: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """``skel_id, node_id, parent_id, step`` from nodes with parents; step is the distance to the parent."""
    p = nodes.select("skel_id", F.col("node_id").alias("parent_id"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    d = [F.col(a) - F.col(f"p{a}") for a in "xyz"]
    return nodes.join(p, ["skel_id", "parent_id"], "left").select("skel_id", "node_id", "parent_id", F.coalesce(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0)).alias("step"))


def leaf_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, node_id, depth``: hops from the root to each leaf but the root."""
    leaves = nodes_of_degree(nodes, edges, 1)
    return climb(tree_of(nodes)).join(leaves, ["skel_id", "node_id"]).select("skel_id", "node_id", F.col("hops").alias("depth"))


def twigs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, leaf, base, length``: chains from a leaf to the first branching node or the root, which ``length`` leaves out."""
    d = degree(nodes, edges)
    tree = tree_of(nodes).join(d, ["skel_id", "node_id"])
    up = climb(tree, F.col("degree") > 2)
    leaves = d.where("degree = 1 and node_id <> 0").select("skel_id", "node_id")
    return up.join(leaves, ["skel_id", "node_id"]).select("skel_id", F.col("node_id").alias("leaf"), F.col("top").alias("base"), F.col("hops").alias("length"))


def twigs_of_length(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    return twigs(nodes, edges).where(F.col("length") == k)


def twig_members(nodes: DataFrame, edges: DataFrame, max_length: int) -> DataFrame:
    """``skel_id, node_id, leaf`` of every node on a twig of at most ``max_length`` nodes; bases stay out."""
    d = degree(nodes, edges)
    tree = nodes.select("skel_id", "node_id", "parent_id").join(d, ["skel_id", "node_id"])
    short = twigs(nodes, edges).where(F.col("length") <= max_length)
    front = short.select("skel_id", "leaf", F.col("leaf").alias("node_id"))
    out = front
    for _ in range(max_length - 1):
        front = front.join(tree, ["skel_id", "node_id"]).select("skel_id", "leaf", F.col("parent_id").alias("node_id"))
        front = front.join(d.where("degree <= 2 and node_id <> 0").select("skel_id", "node_id"), ["skel_id", "node_id"])
        out = out.unionByName(front)
    return out.select("skel_id", "node_id", "leaf").distinct()


def branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, top, bottom, length``: maximal paths between end points (degree other than 2, or the root), ends counted."""
    d = degree(nodes, edges)
    tree = tree_of(nodes).join(d, ["skel_id", "node_id"])
    ends = d.where("degree <> 2 or node_id = 0").select("skel_id", "node_id")
    up = climb(tree, F.col("degree") != 2).where("hops > 0")
    return up.join(ends, ["skel_id", "node_id"]).select("skel_id", "top", F.col("node_id").alias("bottom"), (F.col("hops") + 1).alias("length"))


def subtree(nodes: DataFrame, root: int) -> DataFrame:
    """``skel_id, node_id`` of all descendants of node ``root`` in each skeleton that has it, itself included: those whose climb ends there."""
    if root < 0:
        raise ValueError("a node id is not negative")
    tree = nodes.select("skel_id", "node_id", "parent_id", F.lit(0.0).alias("step"))
    below = climb(tree, F.col("node_id") == root).where((F.col("top") == root) & (F.col("node_id") != root)).select("skel_id", "node_id")
    return below.unionByName(nodes.where(F.col("node_id") == root).select("skel_id", "node_id"))


def _jumps(at: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 40) -> DataFrame:
    """Pointer doubling on ``at(skel_id, node_id, up, ..)`` until no pointer is left; ``fold(at, far)`` merges what lies behind each pointer, ``far`` having the pointer's columns as far_*."""
    at = settled(at)
    for _ in range(max_rounds):
        if at.where("up is not null").isEmpty():
            return at
        far = at.select("skel_id", F.col("node_id").alias("up"), *(F.col(c).alias(f"far_{c}") for c in at.columns if c not in ("skel_id", "node_id")))
        at = settled(fold(at, far))
    raise RuntimeError("the parent pointers hold a cycle")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """``skel_id, node_id, size``.

    After k rounds a node counts its descendants fewer than 2**k steps below; those behind nodes
    exactly that far below are added.  Work grows with nodes times the logarithm of the depth.
    """

    def fold(at: DataFrame, far: DataFrame) -> DataFrame:
        below = at.where("up is not null").groupBy("skel_id", F.col("up").alias("node_id")).agg(F.sum("size").alias("more"))
        grown = at.join(below, ["skel_id", "node_id"], "left").join(far.select("skel_id", "up", "far_up"), ["skel_id", "up"], "left")
        return grown.select("skel_id", "node_id", F.col("far_up").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    start = nodes.select("skel_id", "node_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("size"))
    return _jumps(start, fold).select("skel_id", "node_id", "size")


def out_of_bounds(nodes: DataFrame, box) -> DataFrame:
    """``skel_id, node_id, head``: subtrees below the first node outside the box; an outside root takes the whole tree."""
    from ..functions.geometry import in_box, parse_box, vector

    lo, hi = parse_box(box)

    def fold(at: DataFrame, far: DataFrame) -> DataFrame:
        # the outermost of the outside nodes on the way is the head
        return at.join(far, ["skel_id", "up"], "left").select("skel_id", "node_id", F.col("far_up").alias("up"), F.coalesce("far_head", "head").alias("head"))

    start = nodes.select("skel_id", "node_id", F.col("parent_id").alias("up"), F.when(~in_box(vector(), lo, hi), F.col("node_id")).alias("head"))
    return _jumps(start, fold).where("head is not null").select("skel_id", "node_id", "head")


def suspicious_tips(nodes: DataFrame, edges: DataFrame, somas: DataFrame, near_factor: float = 1.2, path_ratio: float = 2.0) -> DataFrame:
    """Leaves near the cell body but far along the tree: ``skel_id, node_id, d_euclid, d_path, ratio``, largest ratio first.

    ``somas``: skel_id, cx, cy, cz, radius (the largest axis).
    """
    leaves = nodes_of_degree(nodes, edges, 1)
    path = climb(tree_of(nodes)).select("skel_id", "node_id", F.col("length").alias("d_path"))
    at = nodes.join(leaves, ["skel_id", "node_id"]).join(somas, "skel_id")
    d = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    at = at.withColumn("d_euclid", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("d_euclid") <= F.lit(near_factor) * F.col("radius"))
    out = at.join(path, ["skel_id", "node_id"]).where("d_euclid > 0").withColumn("ratio", F.col("d_path") / F.col("d_euclid")).where(F.col("ratio") >= path_ratio)
    return out.select("skel_id", "node_id", "d_euclid", "d_path", "ratio").orderBy(F.desc("ratio"), "skel_id", "node_id")


def dense_ids(kept: DataFrame) -> DataFrame:
    """``skel_id, node_id, new_id``: the kept nodes numbered from 0 in their old order."""
    return kept.select("skel_id", "node_id", (F.row_number().over(Window.partitionBy("skel_id").orderBy("node_id")) - 1).cast("long").alias("new_id"))
