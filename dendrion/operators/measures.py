"""Lengths, volumes, distances and radii of skeletons."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .nearest import Index, index, nearest


def with_ends(nodes: DataFrame, edges: DataFrame, *radii: str) -> DataFrame:
    """Each edge with the coordinates (ax.. bz) and the given radii (a_<r>, b_<r>) of its ends."""
    a = nodes.select("skel_id", F.col("node_id").alias("u"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *(F.col(r).alias(f"a_{r}") for r in radii))
    b = nodes.select("skel_id", F.col("node_id").alias("v"), *(F.col(c).alias(f"b{c}") for c in "xyz"), *(F.col(r).alias(f"b_{r}") for r in radii))
    return edges.select("skel_id", "u", "v").join(a, ["skel_id", "u"]).join(b, ["skel_id", "v"])


def edge_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return with_ends(nodes, edges).select("skel_id", "u", "v", g.distance(g.vector("a"), g.vector("b")).alias("length"))


def path_length(nodes: DataFrame, edges: DataFrame, box=None) -> DataFrame:
    """``skel_id, length, n_edges``: summed edge length, of the parts inside the closed box if there is one, and the edges that add to it."""
    a, b = g.vector("a"), g.vector("b")
    part = g.distance(a, b) if box is None else g.clipped_length(a, b, *g.parse_box(box))
    rows = with_ends(nodes, edges).select("skel_id", part.alias("part"))
    return rows.groupBy("skel_id").agg(F.sum("part").alias("length"), F.count_if(F.col("part") > 0).alias("n_edges"))


def bounds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("skel_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def convert_unit(nodes: DataFrame, old: str, new: str, radii: tuple[str, ...]) -> DataFrame:
    """Coordinates and every radius column scaled once each."""
    k = F.lit(g.unit_factor(old, new))
    return nodes.withColumns({c: F.col(c) * k for c in ("x", "y", "z", *radii)})


def recommend_radius(nodes: DataFrame, mean: str = "r_mean", median: str = "r_median", trim: str | None = "r_trim") -> DataFrame:
    """``skel_id, choice, p50, p75`` from the ratio mean / median over nodes where both are positive.

    Nearly symmetric radii (p75 below 1.02) take the mean, slightly skewed ones (p50 below 1.05) the
    trimmed mean, others the median; so do skeletons without a usable ratio.
    """
    ratio = F.when((F.col(mean) > 0) & (F.col(median) > 0), F.col(mean) / F.col(median))
    s = nodes.groupBy("skel_id").agg(F.percentile(ratio, 0.5).alias("p50"), F.percentile(ratio, 0.75).alias("p75"))
    choice = F.when(F.col("p75") < 1.02, "mean")
    if trim is not None:
        choice = choice.when(F.col("p50") < 1.05, "trim")
    return s.select("skel_id", choice.otherwise("median").alias("choice"), "p50", "p75")


def radius_estimates(members: DataFrame, keys: tuple[str, ...], value: str = "d", *, trim: float = 0.05, percentile: float = 0.8) -> DataFrame:
    """median, mean, max, min, percentile and trimmed mean (bounds inclusive) of a distance per group."""
    q = members.groupBy(*keys).agg(F.percentile(value, trim).alias("lo"), F.percentile(value, 1 - trim).alias("hi"))
    inside = F.when(F.col(value).between(F.col("lo"), F.col("hi")), F.col(value))
    return members.join(q, list(keys)).groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.percentile(value, percentile).alias("percentile"), F.avg(inside).alias("trim"))


def _against_points(rows: DataFrame, points: DataFrame, block_points: int) -> DataFrame:
    """``rows`` with every query point (point_id, px, py, pz), block by block: a broadcast never holds many more than ``block_points`` points."""
    p = points.select("point_id", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    # every row meets every point, so that rows few enough for one task would keep one core busy
    spark = rows.sparkSession
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = -(-p.count() // block_points)
    if blocks <= 1:
        return rows.join(F.broadcast(p))
    block = F.pmod(F.xxhash64("point_id", "px", "py", "pz"), F.lit(blocks))
    return functools.reduce(DataFrame.unionByName, (rows.join(F.broadcast(p.where(block == i))) for i in range(blocks)))


def distances(points: DataFrame, nodes: DataFrame, edges: DataFrame, *, radius: str | None = None, block_points: int = 100_000, allowed_nodes: DataFrame | None = None, allowed_edges: DataFrame | None = None, unit: str | None = None, point_unit: str | None = None) -> DataFrame:
    """``point_id, skel_id, distance`` of every point to every skeleton's centre line, or with ``radius`` to its surface (0 inside).

    Exact: all edges count, and nodes without an edge as balls.  The points are a query set, broadcast
    in blocks of about ``block_points``; edges never move for it, and minima combine before the shuffle.
    With ``allowed_nodes`` (skel_id, node_id) or ``allowed_edges`` (skel_id, u, v) only these nodes with
    their edges and these edges count; skeletons with none of them have no row.  Points in another
    unit than the skeletons' are converted, and so is the result.
    """
    if unit is not None and point_unit is not None:
        k = g.unit_factor(point_unit, unit)
        points = points.withColumns({c: F.col(c) * F.lit(k) for c in "xyz"})
    else:
        k = 1.0
    args = (g.vector("p"), g.vector("a"), g.vector("b"))
    d = g.point_capsule_distance(*args, F.col(f"a_{radius}"), F.col(f"b_{radius}")) if radius else g.point_segment_distance(*args)
    e = with_ends(nodes, whitelisted(nodes, edges, allowed_nodes, allowed_edges), *([radius] if radius else []))
    out = _against_points(e, points, block_points).groupBy("point_id", "skel_id").agg(F.min(d).alias("distance"))
    return out.withColumn("distance", (F.greatest("distance", F.lit(0.0)) if radius else F.col("distance")) / F.lit(k))


def whitelisted(nodes: DataFrame, edges: DataFrame, allowed_nodes: DataFrame | None = None, allowed_edges: DataFrame | None = None) -> DataFrame:
    """``skel_id, u, v`` of the edges that count: all of them, or the listed ones and those at listed nodes; a node that counts without an edge is one of no length."""
    e = edges.select("skel_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if allowed_nodes is None and allowed_edges is None:
        ends = e.select("skel_id", F.explode(F.array("u", "v")).alias("node_id"))
        alone = nodes.select("skel_id", "node_id").join(ends, ["skel_id", "node_id"], "left_anti")
        return e.unionByName(alone.select("skel_id", F.col("node_id").alias("u"), F.col("node_id").alias("v")))
    out = e.where("false")
    if allowed_edges is not None:
        listed = allowed_edges.select("skel_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v")
        for end in ("u", "v"):
            listed = listed.join(nodes.select("skel_id", F.col("node_id").alias(end)), ["skel_id", end], "left_semi").select("skel_id", "u", "v")
        out = out.unionByName(listed)
    if allowed_nodes is not None:
        ok = allowed_nodes.select("skel_id", "node_id").join(nodes, ["skel_id", "node_id"], "left_semi").distinct()
        out = out.unionByName(ok.select("skel_id", F.col("node_id").alias("u"), F.col("node_id").alias("v")))
        for end in ("u", "v"):
            out = out.unionByName(e.join(ok.withColumnRenamed("node_id", end), ["skel_id", end], "left_semi").select("skel_id", "u", "v"))
    return out.distinct()


def checked_points(points: list, spark) -> DataFrame:
    """``point_id, x, y, z`` from one triple or a list of them."""
    rows = [points] if points and not hasattr(points[0], "__len__") else list(points)
    if any(len(p) != 3 for p in rows):
        raise ValueError("a point has three coordinates")
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "point_id long, x double, y double, z double")


def distances_by_nearest_nodes(points: DataFrame, nodes: DataFrame, edges: DataFrame, *, k: int = 4, radius: str | None = None, block_points: int = 100_000) -> DataFrame:
    """As ``distances``, but only over edges at the k nodes nearest to the point: a heuristic that may miss the nearest edge."""
    near = _against_points(nodes.select("skel_id", "node_id", "x", "y", "z"), points, block_points).withColumn("d", g.distance(g.vector("p"), g.vector()))
    w = Window.partitionBy("point_id", "skel_id").orderBy("d", "node_id")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("point_id", "skel_id", "node_id", "px", "py", "pz")
    e = with_ends(nodes, edges, *([radius] if radius else []))
    e = e.withColumn("node_id", F.explode(F.array("u", "v")))
    args = (g.vector("p"), g.vector("a"), g.vector("b"))
    d = F.greatest(F.lit(0.0), g.point_capsule_distance(*args, F.col(f"a_{radius}"), F.col(f"b_{radius}"))) if radius else g.point_segment_distance(*args)
    return near.join(e, ["skel_id", "node_id"]).groupBy("point_id", "skel_id").agg(F.min(d).alias("distance"))


def edge_index(nodes: DataFrame, edges: DataFrame, radius: str | None = None, *, allowed_nodes: DataFrame | None = None, allowed_edges: DataFrame | None = None) -> Index:
    """All edges that count (and nodes without one) in one hierarchy of cells, for ``nearest_skeletons``; it can be used for many sets of points."""
    e = with_ends(nodes, whitelisted(nodes, edges, allowed_nodes, allowed_edges), *([radius] if radius else []))
    wide = F.greatest(F.lit(0.0), F.col(f"a_{radius}"), F.col(f"b_{radius}")) if radius else F.lit(0.0)
    box = [(fold(f"a{c}", f"b{c}") + sign * wide).alias(f"{n}_{c}") for c in "xyz" for n, fold, sign in (("lo", F.least, -1), ("hi", F.greatest, 1))]
    return index(e.select(F.lit(0).alias("space"), *e.columns, *box), owner="skel_id")


def nearest_skeletons(points: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 1, radius: str | None = None, *, unit: str | None = None, point_unit: str | None = None, within: float | None = None, tree: Index | None = None, **allowed) -> DataFrame:
    """``point_id, rank, skel_id, distance``: the k nearest skeletons (all of them where there are fewer), ties by id; options as for ``distances``.

    Branch and bound: of all edges a point meets only those in cells that can hold one of its k
    nearest skeletons.  Skeletons farther away than ``within`` (in the points' unit) are left out.
    """
    if k < 1:
        raise ValueError("k is positive")
    scale = g.unit_factor(point_unit, unit) if unit is not None and point_unit is not None else 1.0
    tree = tree or edge_index(nodes, edges, radius, **allowed)
    p = points.select(F.lit(0).alias("space"), "point_id", *((F.col(c) * F.lit(scale)).alias(f"p{c}") for c in "xyz"))
    args = (g.vector("p"), g.vector("a"), g.vector("b"))
    d = F.greatest(F.lit(0.0), g.point_capsule_distance(*args, F.col(f"a_{radius}"), F.col(f"b_{radius}"))) if radius else g.point_segment_distance(*args)
    out = nearest(p, tree, lambda rows: rows.withColumn("distance", d), owner="skel_id", k=k, within=None if within is None else within * scale)
    return out.select("point_id", F.col("rank").cast("int").alias("rank"), "skel_id", (F.col("distance") / F.lit(scale)).alias("distance"))


def structured_matches(points: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 1, *, return_all: bool = False, **options) -> DataFrame:
    """``point_id, x, y, z, matches`` and, if asked for, ``all_distances``: per point its nearest skeletons, or all, as an array of (rank, skel_id, distance)."""
    if k < 1:
        raise ValueError("k is positive")
    entry = F.struct(F.col("distance"), F.col("skel_id"))
    ranked = F.array_sort(F.collect_list(entry))
    rows = distances(points, nodes, edges, **options).groupBy("point_id").agg(ranked.alias("all")) if return_all else nearest_skeletons(points, nodes, edges, k, **options).groupBy("point_id").agg(ranked.alias("all"))
    best = F.transform(F.slice("all", 1, k), lambda x, i: F.struct((i + 1).alias("rank"), x["skel_id"].alias("skel_id"), x["distance"].alias("distance")))
    everything = F.map_from_entries(F.transform("all", lambda x: F.struct(x["skel_id"].alias("skel_id"), x["distance"].alias("distance"))))
    out = rows.select("point_id", best.alias("matches"), *([everything.alias("all_distances")] if return_all else []))
    return points.select("point_id", "x", "y", "z").join(out, "point_id")


def distance_matrix(points: DataFrame, nodes: DataFrame, edges: DataFrame, skeletons: list, radius: str | None = None) -> DataFrame:
    """One row per point with one column per listed skeleton."""
    return distances(points, nodes, edges, radius=radius).groupBy("point_id").pivot("skel_id", skeletons).agg(F.min("distance"))


def voxel_grids(nodes: DataFrame, radius: str, h: Column | float | None = None, *, box=None, somas: DataFrame | None = None, max_voxels: float = 1e8) -> DataFrame:
    """``skel_id, lo_x.., nx.., h``: the grid over a box, or over each skeleton's balls and cell body.

    A voxel is a third of the lower quartile of the positive radii (or a twelfth of their first decile,
    if less), or ``h``, coarsened until the grid fits the budget.
    """
    r, positive = F.col(radius), F.when(F.col(radius) > 0, F.col(radius))
    s = nodes.groupBy("skel_id").agg(*(f.alias(n) for c in "xyz" for n, f in ((f"lo_{c}", F.min(F.col(c) - r)), (f"hi_{c}", F.max(F.col(c) + r)))), F.percentile(positive, 0.25).alias("p25"), F.percentile(positive, 0.1).alias("p10"))
    if box is not None:
        s = s.withColumns({f"{n}_{c}": F.lit(v) for n, at in zip(("lo", "hi"), g.parse_box(box), strict=True) for c, v in zip("xyz", at, strict=True)})
    elif somas is not None:
        b = somas.select("skel_id", g.ellipsoid_box(F.col("center"), F.col("axes"), F.col("rot")).alias("b"))
        s = s.join(b, "skel_id", "left").withColumns({k: v for i, c in enumerate("xyz") for k, v in ((f"lo_{c}", F.least(f"lo_{c}", F.col("b.lo")[i])), (f"hi_{c}", F.greatest(f"hi_{c}", F.col("b.hi")[i])))}).drop("b")
    span = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"}
    own = F.coalesce(F.least(F.col("p25") / 3, F.col("p10") / 12), F.greatest(*span.values()) / 256)
    s = s.withColumn("h", F.greatest(own, F.lit(1e-6)) if h is None else h if isinstance(h, Column) else F.lit(float(h)))
    cells = {c: F.greatest(F.lit(1), F.ceil(span[c] / F.col("h"))).cast("double") for c in "xyz"}
    s = s.withColumn("h", F.col("h") * F.greatest(F.lit(1.0), F.cbrt(cells["x"] * cells["y"] * cells["z"] / F.lit(max_voxels))))
    return s.select("skel_id", "lo_x", "lo_y", "lo_z", "h", *(F.greatest(F.lit(1), F.ceil(span[c] / F.col("h"))).cast("long").alias(f"n{c}") for c in "xyz"))


def _slices(rows: DataFrame, c: str, i: str, low: Column, high: Column) -> DataFrame:
    """One row for each voxel of an axis whose centre lies in [low, high], within the grid."""
    at = lambda x: (x - F.col(f"lo_{c}")) / F.col("h") - 0.5
    rows = once(rows, first=F.greatest(F.lit(0), F.ceil(at(low))).cast("long"), last=F.least(F.col(f"n{c}") - 1, F.floor(at(high))).cast("long"))
    return rows.where("first <= last").withColumn(i, F.explode(F.sequence("first", "last"))).drop("first", "last")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that what reads them refers to their values and not to copies of their expressions."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def occupied_voxels(nodes: DataFrame, edges: DataFrame, radius: str, h: Column | float | None = None, box=None, *, somas: DataFrame | None = None, include_soma: bool = True) -> DataFrame:
    """``skel_id, i, j, k, h``: voxels whose centre lies in a tapered edge or, with ``somas`` (skel_id, center, axes, rot), in the cell body; without ``include_soma`` the body is carved out.

    Every edge proposes voxels slice by slice around the stretch of it that is within reach of the
    slice; centres are tested exactly, and ``distinct`` is the union.
    """
    grid = voxel_grids(nodes, radius, h, box=box, somas=somas if include_soma else None)
    e = with_ends(nodes, edges, radius).join(grid, "skel_id").withColumns({"reach": F.greatest(f"a_{radius}", f"b_{radius}"), "t0": F.lit(0.0), "t1": F.lit(1.0)})
    for c, i in zip("xyz", "ijk", strict=True):
        # only the stretch of the edge that slices chosen so far leave within reach
        d = F.col(f"b{c}") - F.col(f"a{c}")
        e = once(e, p=F.col(f"a{c}") + F.col("t0") * d, q=F.col(f"a{c}") + F.col("t1") * d)
        # slices that only touch the edge's box stand or fall by its ends, the stretch in between may have been rounded
        slack = 1e-9 * (F.abs("p") + F.abs("q") + F.col("reach"))
        e = _slices(e, c, i, F.greatest(F.least(f"a{c}", f"b{c}") - F.col("reach"), F.least("p", "q") - F.col("reach") - slack), F.least(F.greatest(f"a{c}", f"b{c}") + F.col("reach"), F.greatest("p", "q") + F.col("reach") + slack))
        at = F.col(f"lo_{c}") + (F.col(i) + 0.5) * F.col("h") - F.col(f"a{c}")
        e = once(e, p=F.when(d != 0, (at - F.col("reach")) / d), q=F.when(d != 0, (at + F.col("reach")) / d))
        e = once(e, t0=F.when(d == 0, F.col("t0")).otherwise(F.greatest("t0", F.least("p", "q") - 1e-9)), t1=F.when(d == 0, F.col("t1")).otherwise(F.least("t1", F.greatest("p", "q") + 1e-9))).where("t0 <= t1")
    center = tuple(F.col(f"lo_{c}") + (F.col(i) + 0.5) * F.col("h") for c, i in zip("xyz", "ijk", strict=True))
    inside = g.point_capsule_distance(center, g.vector("a"), g.vector("b"), F.col(f"a_{radius}"), F.col(f"b_{radius}")) <= 0
    voxels = e.where(inside).select("skel_id", "i", "j", "k", "h")
    if somas is None:
        return voxels.distinct()
    body = somas.select("skel_id", "center", "axes", "rot").join(grid, "skel_id").withColumn("b", g.ellipsoid_box(F.col("center"), F.col("axes"), F.col("rot")))
    for n, (c, i) in enumerate(zip("xyz", "ijk", strict=True)):
        body = _slices(body, c, i, F.col("b.lo")[n], F.col("b.hi")[n])
    body = body.where(g.in_soma(center, F.col("center"), F.col("axes"), F.col("rot"))).select("skel_id", "i", "j", "k", "h")
    return voxels.unionByName(body).distinct() if include_soma else voxels.distinct().join(body, ["skel_id", "i", "j", "k"], "left_anti")


def volume(nodes: DataFrame, edges: DataFrame, radius: str, h: Column | float | None = None, box=None, **options) -> DataFrame:
    """``skel_id, voxels, volume``, 0 for a skeleton without a voxel; options as for ``occupied_voxels``."""
    v = occupied_voxels(nodes, edges, radius, h, box, **options).groupBy("skel_id", "h").agg(F.count(F.lit(1)).alias("voxels"))
    v = v.select("skel_id", "voxels", (F.col("voxels") * F.col("h") * F.col("h") * F.col("h")).alias("volume"))
    return nodes.select("skel_id").distinct().join(v, "skel_id", "left").select("skel_id", F.coalesce("voxels", F.lit(0)).cast("long").alias("voxels"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def soma_candidates(nodes: DataFrame, radius: str, percentile: float = 99.9, factor: float = 4.0, min_nodes: int = 3) -> DataFrame:
    """``skel_id, node_id, is_anchor``: fat nodes near the fattest one; skeletons with too few have none.

    Fat: radius at or above the percentile.  Anchor: the fattest (least id on ties).  Near: within
    factor times the anchor's radius.
    """
    cut = nodes.groupBy("skel_id").agg(F.percentile(radius, percentile / 100).alias("cut"), F.min_by(F.struct("node_id", "x", "y", "z", F.col(radius).alias("r")), F.struct((-F.col(radius)).alias("r"), "node_id")).alias("a"))
    near = nodes.join(cut, "skel_id").where(F.col(radius) >= F.col("cut")).where(g.distance(g.vector(), g.vector(of="a")) <= factor * F.col("a.r"))
    n = F.count(F.lit(1)).over(Window.partitionBy("skel_id"))
    return near.withColumn("n", n).where(F.col("n") >= min_nodes).select("skel_id", "node_id", (F.col("node_id") == F.col("a.node_id")).alias("is_anchor"))


def soma_fit(points: DataFrame, keys: tuple[str, ...] = ("skel_id",)) -> DataFrame:
    """Centre, axes (descending) and rotation of an ellipsoid from the covariance of points: axes are sqrt(5 * eigenvalue)."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    stats = points.groupBy(*keys).agg(*(F.avg(c).alias(f"m_{c}") for c in "xyz"), *(F.covar_samp(a, b).alias(f"c_{a}{b}") for a, b in pairs))

    def solve(batches):
        import numpy as np

        for b in batches:
            m = np.stack([np.stack([b[f"c_{min(p, q)}{max(p, q)}"] for q in "xyz"], 1) for p in "xyz"], 1)
            values, rot = np.linalg.eigh(np.nan_to_num(m))
            b["center"] = list(b[["m_x", "m_y", "m_z"]].to_numpy())
            b["axes"] = [np.sqrt(np.maximum(5 * v[::-1], 0)) for v in values]
            b["rot"] = [r[:, ::-1].tolist() for r in rot]
            yield b[[*keys, "center", "axes", "rot"]]

    schema = ", ".join(f"{k} {dict(stats.dtypes)[k]}" for k in keys)
    return stats.mapInPandas(solve, f"{schema}, center array<double>, axes array<double>, rot array<array<double>>")
