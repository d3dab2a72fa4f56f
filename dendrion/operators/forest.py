"""Minimum spanning forests by Borůvka rounds over all skeletons at once.

In a round every component takes its least outgoing edge, components hook along these edges, and
pointer jumping names the merged ones.  Each round at least halves the components that can still
grow, and every step is an aggregation or an equi-join, so neither rounds nor tasks grow with the size of
one skeleton.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, settled


def _roots(hooks: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``skel_id, comp, root`` from ``hooks(skel_id, comp, root)``, pointers without cycles whose ends point to themselves."""
    at = settled(hooks)
    for _ in range(max_rounds):
        onward = at.select("skel_id", F.col("comp").alias("root"), F.col("root").alias("next"))
        far = settled(at.join(onward, ["skel_id", "root"]).select("skel_id", "comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        at = far.drop("moved")
        if far.where("moved").isEmpty():
            return at
    raise RuntimeError("the pointers hold a cycle")


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``skel_id, u, v``: the edges of the minimum spanning forest of ``edges(skel_id, u, v, len)``; of equal lengths the least (u, v) counts as shorter."""
    order = F.struct("len", "u", "v")
    live = edges.where("u <> v").groupBy("skel_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("len").alias("len"))
    live = settled(live.select("skel_id", "len", F.col("a").alias("u"), F.col("b").alias("v"), F.col("a").alias("cu"), F.col("b").alias("cv")))
    chosen = None
    for _ in range(max_rounds):
        if live.isEmpty():
            return live.select("skel_id", "u", "v") if chosen is None else chosen
        ends = F.array(*(F.struct(F.col(p).alias("comp"), F.col(q).alias("other"), order.alias("e")) for p, q in (("cu", "cv"), ("cv", "cu"))))
        pick = settled(live.select("skel_id", F.inline(ends)).groupBy("skel_id", "comp").agg(F.min(F.struct("e", "other")).alias("p")).select("skel_id", "comp", "p.other", "p.e.u", "p.e.v"))
        taken = pick.select("skel_id", "u", "v").distinct()
        chosen = taken if chosen is None else chosen.unionByName(taken)
        # two components that take the same edge point at each other: the less one is the root
        back = pick.select("skel_id", F.col("comp").alias("other"), F.col("other").alias("back"))
        hooks = pick.join(back, ["skel_id", "other"], "left").select("skel_id", "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root"))
        roots = _roots(hooks)
        for c in ("cu", "cv"):
            live = live.join(roots.select("skel_id", F.col("comp").alias(c), F.col("root").alias(f"r{c}")), ["skel_id", c]).withColumn(c, F.col(f"r{c}")).drop(f"r{c}")
        # of the edges between two components only the least can be taken
        apart = live.where("cu <> cv").groupBy("skel_id", F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.min(order).alias("e"))
        live = settled(apart.select("skel_id", "e.len", "e.u", "e.v", "cu", "cv"))
    raise RuntimeError("the forest did not settle")


def rooted(edges: DataFrame, roots: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``skel_id, node_id, parent_id, enter, leave`` of all nodes but the roots in the trees of a forest that hold one of ``roots`` (skel_id, node_id).

    An Euler tour: behind the edge u - v comes the edge from v to its next neighbour in cyclic order, and
    the tour ends with the last edge back to the root.  Pointer jumping along the tour tells how far each
    directed edge is from the end, and of an edge's two directions the earlier one leads away from the root.
    ``enter`` and ``leave`` count down from the tour's beginning: w stands above v if v's ``enter`` lies
    between those of w.  The rounds grow with the logarithm of the tree, whatever its depth.
    """
    once = edges.where("u <> v").select("skel_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = once.select("skel_id", F.inline(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("u", "v"), ("v", "u"))))))
    around = Window.partitionBy("skel_id", "p").orderBy("q")
    ring = both.withColumns({"next": F.lead("q").over(around), "first": F.min("q").over(Window.partitionBy("skel_id", "p"))})
    # after p - q: from q to the neighbour that follows p there; at a root the last one ends the tour
    root = roots.select("skel_id", F.col("node_id").alias("p")).distinct().withColumn("is_root", F.lit(True))
    ring = ring.join(root, ["skel_id", "p"], "left").select("skel_id", F.col("p").alias("q"), F.col("q").alias("p"), F.when(F.col("is_root"), F.col("next")).otherwise(F.coalesce("next", "first")).alias("to"))
    at = settled(ring.select("skel_id", "p", "q", F.when(F.col("to").isNotNull(), F.col("q")).alias("sp"), F.col("to").alias("sq"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("left")))
    for _ in range(max_rounds):
        onward = at.select("skel_id", F.col("p").alias("sp"), F.col("q").alias("sq"), F.col("sp").alias("np"), F.col("sq").alias("nq"), F.col("left").alias("more"))
        open_ = at.where("sp is not null").join(onward, ["skel_id", "sp", "sq"]).select("skel_id", "p", "q", F.col("np").alias("sp"), F.col("nq").alias("sq"), (F.col("left") + F.col("more")).alias("left"))
        rest = at.where("sp is null")
        at = settled(rest.unionByName(open_))
        # in a tree without a root the tour has no end, and its counts outgrow it
        if at.where("sp is not null").isEmpty() or at.agg(F.min(F.when(F.col("sp").isNotNull(), F.col("left")))).first()[0] > at.count():
            break
    done = at.where("sp is null")
    back = done.select("skel_id", F.col("p").alias("q"), F.col("q").alias("p"), F.col("left").alias("leave"))
    return settled(done.join(back, ["skel_id", "p", "q"]).where("left > leave").select("skel_id", F.col("q").alias("node_id"), F.col("p").alias("parent_id"), F.col("left").alias("enter"), "leave"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``skel_id, component, pos, node_id``: one cycle of each component that has any, in order.

    The forest of the least edges (by their ends) leaves the edges that close cycles; the least of
    them in a component closes the cycle that is given, from its lesser end along the tree to the other.
    """
    e = settled(edges.where("u <> v").select("skel_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    tree = settled(spanning_forest(e.withColumn("len", F.lit(1.0))))
    label = components(nodes, e)
    closing = e.join(tree, ["skel_id", "u", "v"], "left_anti").join(label.withColumnRenamed("node_id", "u"), ["skel_id", "u"])
    closing = settled(closing.groupBy("skel_id", "component").agg(F.min(F.struct("u", "v")).alias("e")).select("skel_id", "component", "e.u", "e.v"))
    near = tree.join(label.withColumnRenamed("node_id", "u"), ["skel_id", "u"]).join(closing.select("skel_id", "component"), ["skel_id", "component"], "left_semi").select("skel_id", "u", "v")
    at = rooted(near, closing.select("skel_id", F.col("u").alias("node_id"))).join(label, ["skel_id", "node_id"])
    end = closing.join(at.select("skel_id", F.col("node_id").alias("v"), F.col("enter").alias("here")), ["skel_id", "v"]).select("skel_id", "component", "here")
    way = at.join(end, ["skel_id", "component"]).where("here between leave and enter").select("skel_id", "component", "enter", "node_id")
    way = way.unionByName(closing.select("skel_id", "component", F.lit(None).cast("long").alias("enter"), F.col("u").alias("node_id")))
    order = Window.partitionBy("skel_id", "component").orderBy(F.desc_nulls_first("enter"))
    return way.select("skel_id", "component", (F.row_number().over(order) - 1).cast("long").alias("pos"), "node_id")
