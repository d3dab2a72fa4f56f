"""Fewer nodes where radii hardly change: runs of like radius become one node each.

Between anchors (the root, end points, branching nodes) a tree consists of corridors.  Two climbs, up
and down, give every inner node its corridor and its place in it.  Corridors are cut into runs, and all
else is joins and aggregates over runs: what a run is worth, whether the anchor beside it takes it, and
the tree that is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import climb, degree, dense_ids, settled


def run_numbers(radii, rtol: float, atol: float) -> list[int]:
    """The run of each radius of a corridor: a new one starts where a radius is not like the mean of the run so far."""
    out, total, n, k = [], 0.0, 0, -1
    for r in radii:
        if n == 0 or abs(r - total / n) > atol + rtol * max(abs(total / n), abs(r)):
            total, n, k = 0.0, 0, k + 1
        total, n = total + r, n + 1
        out.append(k)
    return out


def _worth(how: str, radii: Column) -> Column:
    """One radius for several: their median, mean, or that of the mean cross-section."""
    n = F.size(radii)
    if how == "median":
        s = F.sort_array(radii)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    total = lambda f: F.aggregate(radii, F.lit(0.0), lambda s, r: s + f(r))
    if how == "mean":
        return total(lambda r: r) / n
    if how == "area":
        return F.sqrt(total(lambda r: r * r) / n)
    raise ValueError("how is median, mean or area")


def corridors(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors ``skel_id, node_id, degree`` and inner nodes ``skel_id, corridor, a, z, pos, node_id``.

    A corridor is named by its lower anchor; ``a`` is the anchor of the lesser id, from which places count, ``z`` the other.
    """
    d = settled(degree(nodes, edges))
    inner = (F.col("degree") == 2) & (F.col("node_id") != 0)
    tree = nodes.select("skel_id", "node_id", "parent_id").join(d, ["skel_id", "node_id"])
    tree = settled(tree.withColumns({"inner": inner & F.col("parent_id").isNotNull(), "step": F.lit(1.0)}))
    up = climb(tree.drop("inner"), ~inner).select("skel_id", "node_id", F.col("top").alias("upper"), F.col("hops").alias("above"))
    child = tree.where("parent_id is not null").select("skel_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    below = tree.where("inner").join(child, ["skel_id", "node_id"]).select("skel_id", "node_id", F.col("child").alias("parent_id"), "step")
    down = climb(below.unionByName(tree.where("not inner").select("skel_id", "node_id", F.lit(None).cast("long").alias("parent_id"), "step")))
    down = down.select("skel_id", "node_id", F.col("top").alias("lower"), F.col("hops").alias("under"))
    at = tree.where("inner").select("skel_id", "node_id").join(up, ["skel_id", "node_id"]).join(down, ["skel_id", "node_id"])
    first = F.col("upper") < F.col("lower")
    at = at.select("skel_id", F.col("lower").alias("corridor"), F.least("upper", "lower").alias("a"), F.greatest("upper", "lower").alias("z"), F.when(first, F.col("above")).otherwise(F.col("under")).alias("pos"), "node_id")
    return tree.where("not inner").select("skel_id", "node_id", "degree"), settled(at)


def downsample(nodes: DataFrame, edges: DataFrame, radius: str, *, rtol: float = 0.05, atol: float = 0.0, how: str = "area", merge_ends: bool = True, slide_branches: bool = True, max_shift: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``node`` (skel_id, node_id, x, y, z, radius), ``edge`` (skel_id, u, v) and ``old_to_new`` (skel_id, node_id, new_id) of trees with fewer nodes.

    Every run of like radius is one node, at the centre of its polyline (pieces count by their length).
    Anchors stay.  The run beside an anchor other than the root goes into it if their radii are alike:
    into an end point with ``merge_ends``, into a branching node with ``slide_branches``; the lesser anchor
    of a corridor chooses first.  The anchor then stands at the centre of both, of several runs that of the
    last corridor (by its lesser anchor and the node next to it), unless that is farther than ``max_shift``
    from where it stood in the beginning.  New ids follow the least old id of each node.
    """
    anchors, inner = corridors(nodes, edges)
    at = nodes.select("skel_id", "node_id", "x", "y", "z", F.col(radius).alias("r"))
    inner = inner.withColumnRenamed("z", "far")
    listed = inner.join(at, ["skel_id", "node_id"]).groupBy("skel_id", "corridor", "a", "far").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "x", "y", "z", "r"))).alias("m"))

    @F.pandas_udf("array<int>")
    def numbered(radii: pd.Series) -> pd.Series:
        return radii.map(lambda r: run_numbers(r, rtol, atol))

    listed = settled(listed.withColumn("runs", numbered(F.col("m.r"))))
    rows = listed.select("skel_id", "corridor", "a", "far", F.get("m", F.lit(0))["node_id"].alias("b"), F.element_at("runs", -1).alias("last"), F.explode(F.arrays_zip("m", "runs")).alias("e"))
    rows = rows.select("skel_id", "corridor", "a", "far", "b", "last", "e.m.*", F.col("e.runs").alias("run"))
    w = Window.partitionBy("skel_id", "corridor", "run").orderBy("pos")
    steps = {f"d{c}": F.col(c) - F.lag(c).over(w) for c in "xyz"}
    rows = rows.withColumns(steps).withColumn("step", F.coalesce(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")), F.lit(0.0)))
    middles = [F.sum(F.when(F.col("step") > 0, F.col("step") * (F.col(c) - F.col(f"d{c}") / 2)).otherwise(0.0)).alias(f"m{c}") for c in "xyz"]
    ends = [f(F.struct("x", "y", "z"), "pos").alias(n) for n, f in (("head", F.min_by), ("tail", F.max_by))]
    runs = rows.groupBy("skel_id", "corridor", "a", "far", "b", "last", "run").agg(F.collect_list("r").alias("radii"), F.count(F.lit(1)).alias("n"), F.sum("step").alias("length"), *middles, *(F.sum(c).alias(f"s{c}") for c in "xyz"), F.min("node_id").alias("name"), *ends)
    runs = settled(runs.withColumn("own", _worth(how, F.col("radii"))))
    full = anchors.join(at, ["skel_id", "node_id"])

    def beside(end: str, side: str) -> list[Column]:
        """What the anchor at one end needs: whether it takes the run, and where it would stand."""
        here = {c: F.col(f"{side}{c}") for c in ("x", "y", "z", "r", "degree")}
        near = F.col(end)
        gap = F.sqrt(sum(((here[c] - near[c]) * (here[c] - near[c]) for c in "yz"), (here["x"] - near["x"]) * (here["x"] - near["x"])))
        total = F.col("length") + gap
        place = {c: F.when(total > 0, (F.col(f"m{c}") + gap * (here[c] + near[c]) / 2) / total).otherwise((F.col(f"s{c}") + here[c]) / (F.col("n") + 1)) for c in "xyz"}
        alike = F.abs(here["r"] - F.col("own")) <= F.lit(float(atol)) + F.lit(float(rtol)) * F.greatest(F.abs(here["r"]), F.abs(F.col("own")))
        takes = alike & (F.col(side) != 0) & ((here["degree"] == 1) & F.lit(merge_ends) | (here["degree"] >= 3) & F.lit(slide_branches))
        if max_shift is not None:
            shift = F.sqrt(sum(((place[c] - here[c]) * (place[c] - here[c]) for c in "yz"), (place["x"] - here["x"]) * (place["x"] - here["x"])))
            takes = takes & (shift <= max_shift)
        return [takes, F.struct(*(place[c].alias(c) for c in "xyz"), _worth(how, F.concat("radii", F.array(here["r"]))).alias("r"))]

    for side in ("a", "far"):
        runs = runs.join(full.select("skel_id", F.col("node_id").alias(side), *(F.col(c).alias(f"{side}{c}") for c in ("x", "y", "z", "r", "degree"))), ["skel_id", side])
    (to_a, at_a), (to_z, at_z) = beside("head", "a"), beside("tail", "far")
    runs = runs.withColumns({"to_a": (F.col("run") == 0) & to_a, "at_a": at_a, "at_z": at_z})
    runs = runs.withColumn("to_z", (F.col("run") == F.col("last")) & ~F.col("to_a") & to_z)
    target = F.when(F.col("to_a"), F.col("a")).when(F.col("to_z"), F.col("far")).otherwise(F.col("name"))
    runs = settled(runs.select("skel_id", "corridor", "run", "a", "b", "own", target.alias("target"), (F.col("to_a") | F.col("to_z")).alias("taken"), F.when(F.col("to_a"), F.col("at_a")).when(F.col("to_z"), F.col("at_z")).alias("place"), *(F.when(F.col("length") > 0, F.col(f"m{c}") / F.col("length")).otherwise(F.col(f"s{c}") / F.col("n")).alias(c) for c in "xyz")))
    moved = runs.where("taken").groupBy("skel_id", F.col("target").alias("node_id")).agg(F.max_by("place", F.struct("a", "b")).alias("p"))
    stay = full.join(moved, ["skel_id", "node_id"], "left").select("skel_id", "node_id", *(F.coalesce(F.col("p")[c], F.col(c)).alias(c) for c in ("x", "y", "z", "r")))
    made = settled(stay.unionByName(runs.where("not taken").select("skel_id", F.col("target").alias("node_id"), "x", "y", "z", F.col("own").alias("r"))))
    ids = settled(dense_ids(made))
    to = rows.select("skel_id", "corridor", "run", "node_id").join(runs.select("skel_id", "corridor", "run", "target"), ["skel_id", "corridor", "run"]).select("skel_id", "node_id", "target")
    to = to.unionByName(anchors.select("skel_id", "node_id", F.col("node_id").alias("target")))
    to = settled(to.join(ids.withColumnRenamed("node_id", "target"), ["skel_id", "target"]).select("skel_id", "node_id", "new_id"))
    e = edges.select("skel_id", "u", "v")
    for end in ("u", "v"):
        e = e.join(to.select("skel_id", F.col("node_id").alias(end), F.col("new_id").alias(f"n{end}")), ["skel_id", end])
    e = e.where("nu <> nv").select("skel_id", F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct()
    node = made.join(ids, ["skel_id", "node_id"]).select("skel_id", F.col("new_id").alias("node_id"), "x", "y", "z", F.col("r").alias(radius))
    return node, e, to
