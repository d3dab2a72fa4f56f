"""The queries by name, each an operator applied to the derived tables, and SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..kernels import tree
from ..operators import contacts, edit, forest, graph, measures, mesh, projection, resample, shape, skeletonize as sk
from .registry import ORACLES, QUERIES
from .registry import query as _query
from .registry import rounded as _r
from .views import view

BOX = [20, 60, 10, 100, 10, 80]
NE = ("sk_node", "sk_edge")
_DEG = """, ends AS (SELECT skel_id, u AS node_id FROM sk_edge UNION ALL SELECT skel_id, v FROM sk_edge),
deg AS (SELECT n.skel_id, n.node_id, CAST(count(e.node_id) AS BIGINT) AS degree FROM sk_node n LEFT JOIN ends e ON e.skel_id = n.skel_id AND e.node_id = n.node_id GROUP BY 1, 2)"""
_BOTH = ", both_ways AS (SELECT skel_id, u AS node_id, v AS other FROM sk_edge UNION ALL SELECT skel_id, v, u FROM sk_edge)"
_WALK = """, walk AS (SELECT skel_id, node_id, CAST(0 AS BIGINT) AS hops, CAST(0 AS DOUBLE) AS length, x, y, z FROM sk_node WHERE parent_id IS NULL
  UNION ALL SELECT c.skel_id, c.node_id, w.hops + 1, w.length + sqrt((c.x-w.x)*(c.x-w.x) + (c.y-w.y)*(c.y-w.y) + (c.z-w.z)*(c.z-w.z)), c.x, c.y, c.z
  FROM walk w JOIN sk_node c ON c.skel_id = w.skel_id AND c.parent_id = w.node_id)"""
_ANC = """, anc AS (SELECT skel_id, node_id, node_id AS ancestor, parent_id AS up, CAST(0 AS BIGINT) AS hops FROM sk_node
  UNION ALL SELECT a.skel_id, a.node_id, p.node_id, p.parent_id, a.hops + 1 FROM anc a JOIN sk_node p ON p.skel_id = a.skel_id AND p.node_id = a.up)"""
_ENDS = "a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz"
_SEG = f", seg AS (SELECT e.skel_id, e.u, e.v, e.len, {_ENDS}, a.r_median AS ra, b.r_median AS rb FROM sk_edge e JOIN sk_node a ON a.skel_id = e.skel_id AND a.node_id = e.u JOIN sk_node b ON b.skel_id = e.skel_id AND b.node_id = e.v)"
_SELF_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az))"


@_query("SELECT skel_id, round(sum(len), 4) AS length, count(*) AS n_edges FROM sk_edge WHERE len > 0 GROUP BY skel_id", *NE)
def path_length(nodes, edges):
    return measures.path_length(nodes, edges).select("skel_id", _r("length", "length"), "n_edges")


def _slab(axis: str, lo: float, hi: float) -> str:
    a, b = f"a{axis}", "by_" if axis == "y" else f"b{axis}"
    return f"CASE WHEN {a} = {b} THEN CASE WHEN {a} BETWEEN {lo} AND {hi} THEN 0 ELSE 2 END ELSE least(({lo}-{a})/({b}-{a}), ({hi}-{a})/({b}-{a})) END", f"CASE WHEN {a} = {b} THEN 1 ELSE greatest(({lo}-{a})/({b}-{a}), ({hi}-{a})/({b}-{a})) END"


_S = [_slab(c, BOX[2 * i], BOX[2 * i + 1]) for i, c in enumerate("xyz")]


@_query(f"{_SEG}, cut AS (SELECT *, greatest(0, {', '.join(s[0] for s in _S)}) AS t0, least(1, {', '.join(s[1] for s in _S)}) AS t1 FROM seg) SELECT skel_id, round(sum(CASE WHEN t1 > t0 THEN (t1 - t0) * {_SELF_LEN} ELSE 0 END), 4) AS length FROM cut GROUP BY skel_id", *NE)
def path_length_bbox(nodes, edges):
    return measures.path_length(nodes, edges, BOX).select("skel_id", _r("length", "length"))


@_query("SELECT skel_id, u, v, round(len, 4) AS length FROM sk_edge", *NE)
def edge_lengths(nodes, edges):
    return measures.edge_lengths(nodes, edges).select("skel_id", "u", "v", _r("length", "length"))


@_query(f"{_DEG} SELECT skel_id, node_id, degree FROM deg", *NE)
def degree(nodes, edges):
    return graph.degree(nodes, edges)


@_query(f"{_DEG}, c AS (SELECT skel_id, degree, count(*) AS n FROM deg WHERE degree > 0 GROUP BY 1, 2), f AS (SELECT skel_id, unnest(range(1, max(degree) + 1)) AS degree FROM c GROUP BY skel_id) SELECT f.skel_id, f.degree, coalesce(c.n, 0) AS n FROM f LEFT JOIN c ON c.skel_id = f.skel_id AND c.degree = f.degree", *NE)
def degree_hist(nodes, edges):
    return graph.degree_histogram(nodes, edges)


@_query(f"{_DEG}, q AS (SELECT skel_id, quantile_cont(degree, 0.75) AS threshold FROM deg GROUP BY 1) SELECT skel_id, node_id, degree, round(threshold, 4) AS threshold FROM deg JOIN q USING (skel_id) WHERE degree > threshold", *NE)
def high_degree_nodes(nodes, edges):
    return graph.high_degree_nodes(nodes, edges, 75).withColumn("threshold", F.round("threshold", 4))


@_query(f"{_DEG} SELECT skel_id, node_id FROM deg WHERE degree = 1 AND node_id <> 0", *NE)
def leaves(nodes, edges):
    return graph.nodes_of_degree(nodes, edges, 1)


@_query(f"{_BOTH} SELECT skel_id, node_id, other FROM both_ways", *NE)
def neighbors(nodes, edges):
    return graph.neighbors(edges)


@_query(f"{_DEG}{_BOTH} SELECT n.skel_id, n.node_id, d.degree, n.r_median AS radius, string_agg(b.other || ':' || o.degree, ',' ORDER BY b.other) AS neighbors FROM sk_node n JOIN deg d USING (skel_id, node_id) LEFT JOIN both_ways b ON b.skel_id = n.skel_id AND b.node_id = n.node_id LEFT JOIN deg o ON o.skel_id = b.skel_id AND o.node_id = b.other GROUP BY 1, 2, 3, 4", *NE)
def node_summary(nodes, edges):
    s = graph.node_summary(nodes, edges, "r_median")
    return s.withColumn("neighbors", F.array_join(F.transform("neighbors", lambda n: F.concat(n["node_id"].cast("string"), F.lit(":"), n["degree"].cast("string"))), ","))


@_query("SELECT skel_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM sk_node GROUP BY 1", "sk_node")
def aabb(nodes):
    return measures.bounds(nodes)


@_query("""SELECT skel_id, CASE WHEN p75 < 1.02 THEN 'mean' WHEN p50 < 1.05 THEN 'trim' ELSE 'median' END AS choice, round(p50, 4) AS p50, round(p75, 4) AS p75 FROM (
SELECT skel_id, quantile_cont(r_mean / r_median, 0.5) AS p50, quantile_cont(r_mean / r_median, 0.75) AS p75 FROM sk_node WHERE r_mean > 0 AND r_median > 0 GROUP BY 1)""", "sk_node")
def recommend_radius(nodes):
    return measures.recommend_radius(nodes).select("skel_id", "choice", _r("p50", "p50"), _r("p75", "p75"))


@_query("""SELECT skel_id, round(quantile_cont(y, 0.5), 4) AS median, round(avg(y), 4) AS mean, max(y) AS max, min(y) AS min, round(quantile_cont(y, 0.8), 4) AS percentile, round(avg(CASE WHEN y BETWEEN lo AND hi THEN y END), 4) AS trim
FROM sk_node JOIN (SELECT skel_id, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM sk_node GROUP BY 1) USING (skel_id) GROUP BY skel_id""", "sk_node")
def radius_estimators(nodes):
    e = measures.radius_estimates(nodes, ("skel_id",), "y", trim=0.05)
    return e.select("skel_id", *(_r(c, c) if c in ("median", "mean", "percentile", "trim") else F.col(c) for c in ("median", "mean", "max", "min", "percentile", "trim")))


@_query("""SELECT n.skel_id, n.node_id, n.node_id = a.node_id AS is_anchor FROM sk_node n
JOIN (SELECT skel_id, quantile_cont(r_median, 0.5) AS cut FROM sk_node GROUP BY 1) q USING (skel_id)
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY skel_id ORDER BY r_median DESC, node_id) AS k FROM sk_node) WHERE k = 1) a USING (skel_id)
WHERE n.r_median >= cut AND sqrt((n.x-a.x)*(n.x-a.x) + (n.y-a.y)*(n.y-a.y) + (n.z-a.z)*(n.z-a.z)) <= 40 * a.r_median""", "sk_node")
def soma_candidates(nodes):
    return measures.soma_candidates(nodes, "r_median", 50, 40, 1)


def _ball() -> Column:
    return F.struct(F.array(*(F.lit(v) for v in (50.0, 50.0, 50.0))).alias("center"), F.array(*(F.lit(v) for v in (30.0, 30.0, 30.0))).alias("axes"), F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3))).alias("rot"))


@_query("SELECT skel_id, node_id, round(sqrt((x-50)*(x-50) + (y-50)*(y-50) + (z-50)*(z-50)) - 30, 4) AS d, (x-50)*(x-50) + (y-50)*(y-50) + (z-50)*(z-50) <= 900 AS inside FROM sk_node", "sk_node")
def soma_distance(nodes):
    s = nodes.withColumn("s", _ball())
    args = (g.vector(), F.col("s.center"), F.col("s.axes"), F.col("s.rot"))
    return s.select("skel_id", "node_id", _r(g.ellipsoid_surface_distance(*args), "d"), (g.dot(*(g.minus(g.vector(), tuple(F.lit(50.0) for _ in range(3))),) * 2) <= 900).alias("inside"))


@_query("""SELECT n.skel_id, count(*) AS n_left FROM sk_node n JOIN sk_node s ON s.skel_id = n.skel_id AND s.node_id = 0
WHERE n.node_id = 0 OR NOT (sqrt((n.x-s.x)*(n.x-s.x) + (n.y-s.y)*(n.y-s.y) + (n.z-s.z)*(n.z-s.z)) <= 20 * s.r_median
  OR (sqrt((n.x-s.x)*(n.x-s.x) + (n.y-s.y)*(n.y-s.y) + (n.z-s.z)*(n.z-s.z)) < 1.2 * 20 * s.r_median AND n.r_median > 0.2 * 20 * s.r_median)) GROUP BY 1""", *NE)
def near_soma_merge(nodes, edges):
    somas = nodes.where("node_id = 0").select("skel_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), (F.col("r_median") * 20).alias("radius"))
    return edit.merge_near_soma(nodes, edges, somas, "r_median")[0].groupBy("skel_id").agg(F.count(F.lit(1)).alias("n_left"))


@_query(f"""{_ANC}, b AS (SELECT a.skel_id, a.node_id, a.ancestor FROM anc a JOIN sk_node p ON p.skel_id = a.skel_id AND p.node_id = a.ancestor WHERE p.parent_id = 0),
f AS (SELECT b.skel_id, b.ancestor, count(*) AS size FROM b JOIN sk_node n USING (skel_id, node_id) JOIN sk_node s ON s.skel_id = b.skel_id AND s.node_id = 0 GROUP BY 1, 2
  HAVING max(sqrt((n.x-s.x)*(n.x-s.x) + (n.y-s.y)*(n.y-s.y) + (n.z-s.z)*(n.z-s.z))) > 2.5 * max(s.r_median) * 20)
SELECT n.skel_id, CAST(1 + coalesce(sum(f.size), 0) AS BIGINT) AS n_left FROM (SELECT DISTINCT skel_id FROM sk_node) n LEFT JOIN f USING (skel_id) GROUP BY 1""", *NE, recursive=True)
def prune_neurites(nodes, edges):
    somas = nodes.where("node_id = 0").select("skel_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), (F.col("r_median") * 20).alias("radius"))
    return edit.prune_neurites(nodes, edges, somas, extent=2.5)[0].groupBy("skel_id").agg(F.count(F.lit(1)).alias("n_left"))


@_query("SELECT skel_id, node_id, round(x / 1000, 6) AS x, round(r_median / 1000, 6) AS r_median FROM sk_node", "sk_node")
def convert_unit(nodes):
    return measures.convert_unit(nodes, "nm", "um", ("r_median",)).select("skel_id", "node_id", _r("x", "x", 6), _r("r_median", "r_median", 6))


@_query(""", a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY skel_id ORDER BY r_median DESC, node_id) AS k FROM sk_node) WHERE k = 1),
q AS (SELECT skel_id, quantile_cont(r_median, 0.9) AS cut FROM sk_node GROUP BY 1),
c AS (SELECT n.*, a.node_id AS anchor, a.r_median AS big FROM sk_node n JOIN q USING (skel_id) JOIN a ON a.skel_id = n.skel_id WHERE n.r_median >= cut AND sqrt((n.x-a.x)*(n.x-a.x) + (n.y-a.y)*(n.y-a.y) + (n.z-a.z)*(n.z-a.z)) <= 10 * a.r_median),
g AS (SELECT skel_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(big) AS r, max(anchor) AS anchor, min(node_id) AS least FROM c GROUP BY 1 HAVING count(*) >= 2)
SELECT n.skel_id, CASE WHEN g.r IS NULL OR least = 0 THEN 0 ELSE anchor END AS root, round(coalesce(cx, x), 4) AS x, round(coalesce(cy, y), 4) AS y, round(coalesce(cz, z), 4) AS z, coalesce(r, r_median) AS r, r IS NOT NULL AS has_soma FROM sk_node n LEFT JOIN g USING (skel_id) WHERE node_id = 0""", "sk_node")
def detect_soma(nodes):
    out, mapping, soma, _ = sk.detect_soma(nodes, percentile=90, factor=10, min_nodes=2)
    root = mapping.where("new_id = 0").select("skel_id", F.col("node_id").alias("root"))
    return out.where("node_id = 0").join(root, "skel_id").join(soma.select("skel_id", "has_soma"), "skel_id").select("skel_id", "root", _r("x", "x"), _r("y", "y"), _r("z", "z"), F.col("r_median").alias("r"), "has_soma")


_NEAR = """SELECT n.skel_id, n.node_id FROM sk_node n JOIN sk_node s ON s.skel_id = n.skel_id AND s.node_id = 0
WHERE n.node_id = 0 OR NOT (sqrt((n.x-s.x)*(n.x-s.x) + (n.y-s.y)*(n.y-s.y) + (n.z-s.z)*(n.z-s.z)) <= 20 * s.r_median
  OR (sqrt((n.x-s.x)*(n.x-s.x) + (n.y-s.y)*(n.y-s.y) + (n.z-s.z)*(n.z-s.z)) < 1.2 * 20 * s.r_median AND n.r_median > 0.2 * 20 * s.r_median))"""


@_query(f""", kept AS ({_NEAR}), k AS (SELECT skel_id, node_id, row_number() OVER (PARTITION BY skel_id ORDER BY node_id) - 1 AS new_id FROM kept),
m AS (SELECT n.skel_id, n.node_id, coalesce(k.new_id, 0) AS to_id FROM sk_node n LEFT JOIN k USING (skel_id, node_id))
SELECT DISTINCT e.skel_id, least(a.to_id, b.to_id) AS u, greatest(a.to_id, b.to_id) AS v FROM sk_edge e JOIN m a ON a.skel_id = e.skel_id AND a.node_id = e.u JOIN m b ON b.skel_id = e.skel_id AND b.node_id = e.v WHERE a.to_id <> b.to_id""", *NE)
def near_soma_edges(nodes, edges):
    """The edges after merging, those of merged nodes attached to node 0."""
    somas = nodes.where("node_id = 0").select("skel_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), (F.col("r_median") * 20).alias("radius"))
    return edit.merge_near_soma(nodes, edges, somas, "r_median")[1]


@_query(f"""{_ANC}, b AS (SELECT a.skel_id, a.node_id, a.ancestor FROM anc a JOIN sk_node p ON p.skel_id = a.skel_id AND p.node_id = a.ancestor WHERE p.parent_id = 0),
f AS (SELECT b.skel_id, b.ancestor FROM b JOIN sk_node n USING (skel_id, node_id) JOIN sk_node s ON s.skel_id = b.skel_id AND s.node_id = 0 GROUP BY 1, 2
  HAVING max(sqrt((n.x-s.x)*(n.x-s.x) + (n.y-s.y)*(n.y-s.y) + (n.z-s.z)*(n.z-s.z))) > 2.5 * max(s.r_median) * 20)
SELECT skel_id, x, y, z FROM sk_node WHERE node_id = 0 UNION ALL SELECT n.skel_id, n.x, n.y, n.z FROM b JOIN f USING (skel_id, ancestor) JOIN sk_node n ON n.skel_id = b.skel_id AND n.node_id = b.node_id""", *NE, recursive=True)
def prune_neurites_nodes(nodes, edges):
    """The places of the nodes that stay."""
    somas = nodes.where("node_id = 0").select("skel_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), (F.col("r_median") * 20).alias("radius"))
    return edit.prune_neurites(nodes, edges, somas, extent=2.5)[0].select("skel_id", "x", "y", "z")


_KEPT = ", k AS (SELECT skel_id, node_id, row_number() OVER (PARTITION BY skel_id ORDER BY node_id) - 1 AS new_id FROM sk_node WHERE node_id % 7 <> 3 OR node_id = 0)"


@_query(f"{_KEPT} SELECT DISTINCT e.skel_id, least(a.new_id, b.new_id) AS u, greatest(a.new_id, b.new_id) AS v FROM sk_edge e JOIN k a ON a.skel_id = e.skel_id AND a.node_id = e.u JOIN k b ON b.skel_id = e.skel_id AND b.node_id = e.v", *NE)
def compact_edges(nodes, edges):
    return edit.keep_nodes(nodes, edges, F.col("node_id") % 7 != 3)[1]


@_query("SELECT skel_id, least(a, b) AS u, greatest(a, b) AS v FROM (SELECT skel_id, CASE u WHEN 0 THEN 4 WHEN 4 THEN 0 ELSE u END AS a, CASE v WHEN 0 THEN 4 WHEN 4 THEN 0 ELSE v END AS b FROM sk_edge)", *NE)
def swap_root(nodes, edges):
    swaps = nodes.select("skel_id").distinct().select("skel_id", F.lit(0).cast("long").alias("a"), F.lit(4).cast("long").alias("b"))
    return edit.swap_ids(nodes, edges, swaps)[1]


@_query("""SELECT skel_id, new_id, ntype FROM (SELECT skel_id, node_id // 3 AS new_id, ntype, row_number() OVER (PARTITION BY skel_id, node_id // 3
ORDER BY ntype = 0, count(*) DESC, list_position([1, -1, 2, 3, 4, 5, 6, 0], ntype)) AS k FROM sk_node GROUP BY 1, 2, 3) WHERE k = 1""", "sk_node")
def ntype_vote(nodes):
    return edit.label_vote(nodes, nodes.select("skel_id", "node_id", F.expr("node_id div 3").alias("new_id")))


@_query("SELECT ntype, count(*) AS n FROM sk_node GROUP BY 1", "sk_node")
def ntype_hist(nodes):
    return nodes.groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_DEG}{_WALK} SELECT w.skel_id, w.node_id, hops AS depth FROM walk w JOIN deg USING (skel_id, node_id) WHERE degree = 1 AND node_id <> 0", *NE, recursive=True)
def leaf_depths(nodes, edges):
    return graph.leaf_depths(nodes, edges)


@_query(f"{_WALK} SELECT skel_id, node_id, hops, round(length, 4) AS length FROM walk", "sk_node", recursive=True)
def tree_path_length(nodes):
    return graph.climb(graph.tree_of(nodes)).select("skel_id", "node_id", "hops", _r("length", "length"))


@_query(f"""{_DEG}{_WALK} SELECT w.skel_id, w.node_id, round(d, 4) AS d_euclid, round(length, 4) AS d_path, round(length / d, 4) AS ratio FROM (
SELECT w.*, sqrt((w.x-s.x)*(w.x-s.x) + (w.y-s.y)*(w.y-s.y) + (w.z-s.z)*(w.z-s.z)) AS d, s.r_median AS r FROM walk w JOIN sk_node s ON s.skel_id = w.skel_id AND s.node_id = 0) w
JOIN deg USING (skel_id, node_id) WHERE degree = 1 AND node_id <> 0 AND d <= 40 * r AND d > 0 AND length / d >= 2""", *NE, recursive=True)
def suspicious_tips(nodes, edges):
    somas = nodes.where("node_id = 0").select("skel_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.col("r_median").alias("radius"))
    return graph.suspicious_tips(nodes, edges, somas, 40, 2).select("skel_id", "node_id", _r("d_euclid", "d_euclid"), _r("d_path", "d_path"), _r("ratio", "ratio"))


@_query(f"{_ANC} SELECT skel_id, ancestor AS node_id, count(*) AS size FROM anc GROUP BY 1, 2", "sk_node", recursive=True)
def subtree_sizes(nodes):
    return graph.subtree_sizes(nodes)


@_query(f"{_ANC} SELECT skel_id, node_id FROM anc WHERE ancestor = 5", "sk_node", recursive=True)
def subtree_members(nodes):
    return graph.subtree(nodes, 5)


_OUT = "NOT (x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 100 AND z BETWEEN 10 AND 80)"


@_query(f"{_ANC}, o AS (SELECT skel_id, node_id AS ancestor FROM sk_node WHERE {_OUT}) SELECT a.skel_id, a.node_id, arg_max(a.ancestor, a.hops) AS head FROM anc a JOIN o USING (skel_id, ancestor) GROUP BY 1, 2", "sk_node", recursive=True)
def out_of_bounds(nodes):
    return graph.out_of_bounds(nodes, BOX)


_CLIMB = f"""{_DEG}, up AS (SELECT d.skel_id, d.node_id, n.parent_id AS at, CAST(1 AS BIGINT) AS hops FROM deg d JOIN sk_node n USING (skel_id, node_id) WHERE n.parent_id IS NOT NULL AND {{start}}
UNION ALL SELECT u.skel_id, u.node_id, n.parent_id, u.hops + 1 FROM up u JOIN deg d ON d.skel_id = u.skel_id AND d.node_id = u.at JOIN sk_node n ON n.skel_id = u.skel_id AND n.node_id = u.at WHERE NOT ({{stop}}) AND n.parent_id IS NOT NULL)
SELECT u.skel_id, {{out}} FROM up u JOIN deg d ON d.skel_id = u.skel_id AND d.node_id = u.at WHERE {{stop}} OR u.at = 0"""


@_query(_CLIMB.format(start="degree = 1 AND d.node_id <> 0", stop="d.degree > 2", out="u.node_id AS leaf, u.at AS base, hops AS length"), *NE, recursive=True)
def twigs(nodes, edges):
    return graph.twigs(nodes, edges)


@_query(_CLIMB.format(start="degree <> 2", stop="d.degree <> 2", out="u.at AS top, u.node_id AS bottom, hops + 1 AS length"), *NE, recursive=True)
def branches(nodes, edges):
    return graph.branches(nodes, edges)


_CUT = ", cut AS (SELECT * FROM sk_edge WHERE v % 11 <> 5)"


@_query(f"""{_CUT}, b2 AS (SELECT skel_id, u AS p, v AS q FROM cut UNION ALL SELECT skel_id, v, u FROM cut),
reach AS (SELECT skel_id, node_id, node_id AS r FROM sk_node UNION SELECT b2.skel_id, b2.q, reach.r FROM reach JOIN b2 ON b2.skel_id = reach.skel_id AND b2.p = reach.node_id)
SELECT skel_id, node_id, min(r) AS component FROM reach GROUP BY 1, 2""", *NE, recursive=True)
def components_after_clip(nodes, edges):
    n, e = edit.clip(nodes, edges, edges.where("v % 11 = 5"))
    return graph.components(n, e)


@_query("SELECT n.skel_id, n.c AS n_nodes, coalesce(e.c, 0) AS n_edges, CAST(1 AS BIGINT) AS n_components, coalesce(e.c, 0) = n.c - 1 AS acyclic FROM (SELECT skel_id, count(*) AS c FROM sk_node GROUP BY 1) n LEFT JOIN (SELECT skel_id, count(*) AS c FROM sk_edge GROUP BY 1) e USING (skel_id)", *NE)
def acyclicity(nodes, edges):
    return graph.acyclicity(nodes, edges).select("skel_id", "n_nodes", "n_edges", "n_components", "acyclic")


@_query(f"""{_CUT}, b2 AS (SELECT skel_id, u AS p, v AS q FROM cut UNION ALL SELECT skel_id, v, u FROM cut),
reach AS (SELECT skel_id, node_id, node_id AS r FROM sk_node UNION SELECT b2.skel_id, b2.q, reach.r FROM reach JOIN b2 ON b2.skel_id = reach.skel_id AND b2.p = reach.node_id),
c AS (SELECT skel_id, node_id, min(r) AS component FROM reach GROUP BY 1, 2)
SELECT c.skel_id, max(component) = 0 AS connected, count(DISTINCT component) AS n_components, coalesce(string_agg(CASE WHEN component <> 0 THEN c.node_id END, ',' ORDER BY c.node_id), '') AS isolated, max(e.n) AS n_edges, max(e.n) = count(*) - count(DISTINCT component) AS acyclic FROM c JOIN (SELECT skel_id, count(*) AS n FROM cut GROUP BY 1) e USING (skel_id) GROUP BY 1""", *NE, recursive=True)
def connectivity_after_clip(nodes, edges):
    n, e = edit.clip(nodes, edges, edges.where("v % 11 = 5"))
    a = graph.acyclicity(n, e).select("skel_id", "n_edges", "acyclic")
    return graph.connectivity(n, e).join(a, "skel_id").select("skel_id", "connected", "n_components", F.array_join("isolated", ",").alias("isolated"), "n_edges", "acyclic")


_T = "CASE WHEN l2 > 0 THEN greatest(0, least(1, ((p.x-ax)*(bx-ax) + (p.y-ay)*(by_-ay) + (p.z-az)*(bz-az)) / l2)) ELSE 0 END"
_PD = f"""{_SEG}, s2 AS (SELECT *, (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az) AS l2 FROM seg),
pt AS (SELECT p.point_id, s2.*, p.x AS px, p.y AS py, p.z AS pz, {_T} AS t FROM s2, sk_point p),
pd AS (SELECT *, sqrt((px-ax-t*(bx-ax))*(px-ax-t*(bx-ax)) + (py-ay-t*(by_-ay))*(py-ay-t*(by_-ay)) + (pz-az-t*(bz-az))*(pz-az-t*(bz-az))) AS d FROM pt)"""


@_query(f"{_PD} SELECT point_id, skel_id, round(min(d), 4) AS distance FROM pd GROUP BY 1, 2", *NE, "sk_point")
def point_distance_centerline(nodes, edges, points):
    return measures.distances(points, nodes, edges).withColumn("distance", F.round("distance", 4))


@_query(f"{_PD} SELECT point_id, skel_id, round(greatest(0, min(d - CASE WHEN l2 > 0 THEN ra + t*(rb-ra) ELSE greatest(ra, rb) END)), 4) AS distance FROM pd GROUP BY 1, 2", *NE, "sk_point")
def point_distance_surface(nodes, edges, points):
    return measures.distances(points, nodes, edges, radius="r_median").withColumn("distance", F.round("distance", 4))


@_query(f"""{_PD.replace(" FROM sk_edge e JOIN", " FROM (SELECT * FROM sk_edge WHERE v < 10) e JOIN")} SELECT point_id, skel_id, round(min(d), 4) AS distance FROM pd GROUP BY 1, 2""", *NE, "sk_point")
def point_distance_allowed(nodes, edges, points):
    """To a whitelist of edges only."""
    return measures.distances(points, nodes, edges, allowed_edges=edges.where("v < 10")).withColumn("distance", F.round("distance", 4))


@_query(f"{_PD} SELECT point_id, k AS rank, skel_id, round(d, 4) AS distance FROM (SELECT point_id, skel_id, d, row_number() OVER (PARTITION BY point_id ORDER BY d, skel_id) AS k FROM (SELECT point_id, skel_id, min(d) AS d FROM pd GROUP BY 1, 2)) WHERE k <= 3", *NE, "sk_point")
def nearest_skeletons(nodes, edges, points):
    return measures.nearest_skeletons(points, nodes, edges, 3).withColumn("distance", F.round("distance", 4))


_PAIRS = """, n0 AS (SELECT skel_id, node_id, x, y, z, r_median AS r FROM sk_node WHERE node_id <> 0),
c0 AS (SELECT a.skel_id AS a_id, b.skel_id AS b_id, a.node_id AS idx_a, b.node_id AS idx_b, a.r AS ra, b.r AS rb, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz,
  (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM n0 a JOIN n0 b ON a.skel_id < b.skel_id AND b.x BETWEEN a.x - 4 AND a.x + 4
  WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= (a.r+b.r)*(a.r+b.r)),
seed AS (SELECT *, sqrt(d2) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id, idx_a ORDER BY d2, idx_b) AS k FROM c0) WHERE k = 1)"""


@_query(f"{_PAIRS} SELECT a_id, b_id, idx_a, idx_b, round(d - ra - rb, 4) AS center_gap, round(ax + CASE WHEN d > 0 THEN (ra + d - rb) / (2*d) ELSE 0.5 END * (bx-ax), 4) AS x FROM seed", "sk_node")
def contact_seeds(nodes):
    return contacts.contact_seeds(nodes, "r_median").select("a_id", "b_id", "idx_a", "idx_b", _r("center_gap", "center_gap"), _r("x", "x"))


@_query(f"{_PAIRS} SELECT a_id, b_id, idx_a, round(2*pi()*ra*ra*(1 - greatest(-1, least(1, (dd*dd + ra*ra - rb*rb) / (2*dd*ra)))), 4) AS area_a FROM (SELECT *, greatest(d, 1e-12) AS dd FROM seed) s", "sk_node")
def contact_caps(nodes):
    return contacts.contact_caps(contacts.contact_seeds(nodes, "r_median")).select("a_id", "b_id", "idx_a", _r("area_a", "area_a"))


_AT = lambda t, name: ", ".join(f"a{c} + {t} * ({'by_' if c == 'y' else 'b' + c} - a{c}) AS {name}{c}" for c in "xyz")
_FAR = lambda n: "sqrt(" + " + ".join(f"(a.{n}{c}-b.{n}{c})*(a.{n}{c}-b.{n}{c})" for c in "xyz") + ")"
_SITES = f"""{_PAIRS}, s1 AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY idx_a) AS seed_id, greatest(d, 1e-12) AS dd, d < ra + rb + 0.06 - 1e-12 AS touch,
  {_AT("CASE WHEN d > 0 THEN (ra + d - rb) / (2*d) ELSE 0.5 END", "m")}, {_AT("CASE WHEN d > 0 THEN ra / d ELSE 0 END", "p")}, {_AT("CASE WHEN d > 0 THEN (d - rb) / d ELSE 0 END", "q")} FROM seed),
s2 AS (SELECT *, greatest(-1, least(1, (dd*dd + ra*ra - (rb+0.06)*(rb+0.06)) / (2*dd*ra))) AS ca, greatest(-1, least(1, (dd*dd + rb*rb - (ra+0.06)*(ra+0.06)) / (2*dd*rb))) AS cb FROM s1),
s3 AS (SELECT *, CASE WHEN touch THEN 2*pi()*ra*ra*(1-ca) ELSE 0 END AS area_a, CASE WHEN touch THEN 2*pi()*rb*rb*(1-cb) ELSE 0 END AS area_b,
  CASE WHEN touch THEN ra*sqrt(greatest(0, 1-ca*ca)) ELSE 0 END AS ha, CASE WHEN touch THEN rb*sqrt(greatest(0, 1-cb*cb)) ELSE 0 END AS hb FROM s2),
s4 AS (SELECT *, greatest(2*((ha+hb)/2 + 0.06), 0.35*greatest(ra, rb), 0.08) AS rm, greatest(2*(ha+0.06), 0.35*ra, 0.08) AS rp, greatest(2*(hb+0.06), 0.35*rb, 0.08) AS rq FROM s3),
link AS (SELECT a.a_id, a.b_id, a.seed_id AS u, b.seed_id AS v FROM s4 a JOIN s4 b ON a.a_id = b.a_id AND a.b_id = b.b_id AND a.seed_id <> b.seed_id
  WHERE {_FAR("m")} <= a.rm + b.rm OR {_FAR("p")} <= a.rp + b.rp OR {_FAR("q")} <= a.rq + b.rq),
reach AS (SELECT a_id, b_id, seed_id, seed_id AS r FROM s4 UNION SELECT l.a_id, l.b_id, l.v, reach.r FROM reach JOIN link l ON l.a_id = reach.a_id AND l.b_id = reach.b_id AND l.u = reach.seed_id),
comp AS (SELECT a_id, b_id, seed_id, min(r) AS site FROM reach GROUP BY 1, 2, 3),
s5 AS (SELECT s4.*, site FROM s4 JOIN comp USING (a_id, b_id, seed_id)),
fa AS (SELECT a_id, b_id, site, sum(m) AS area_a FROM (SELECT a_id, b_id, site, idx_a, max(area_a) AS m FROM s5 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
fb AS (SELECT a_id, b_id, site, sum(m) AS area_b FROM (SELECT a_id, b_id, site, idx_b, max(area_b) AS m FROM s5 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
sites AS (SELECT a_id, b_id, site, n_seeds, cx, area_a, area_b, (area_a + area_b) / 2 AS area_mean FROM (SELECT a_id, b_id, site, count(*) AS n_seeds, avg(mx) AS cx FROM s5 GROUP BY 1, 2, 3) JOIN fa USING (a_id, b_id, site) JOIN fb USING (a_id, b_id, site))"""


def _sites(nodes):
    return contacts.proxy_sites(contacts.contact_caps(contacts.contact_seeds(nodes, "r_median"), 0.06), tol=0.06)


@_query(f"{_SITES} SELECT a_id, b_id, site, n_seeds, round(cx, 4) AS cx, round(area_a, 4) AS area_a, round(area_b, 4) AS area_b, round(area_mean, 4) AS area_mean FROM sites", "sk_node", recursive=True)
def contact_sites_proxy(nodes):
    return _sites(nodes).select("a_id", "b_id", "site", "n_seeds", *(_r(c, c) for c in ("cx", "area_a", "area_b", "area_mean")))


@_query(f"{_SITES} SELECT a_id, b_id, site, n_seeds, round(area_mean, 4) AS area_mean FROM sites WHERE area_mean >= 5", "sk_node", recursive=True)
def contact_filter(nodes):
    return contacts.filter_sites(_sites(nodes), area_min=5.0).select("a_id", "b_id", "site", "n_seeds", _r("area_mean", "area_mean"))


_IDX = lambda c, i: f"unnest(range(CAST(ceil((least(a{c}, {'by_' if c == 'y' else 'b' + c}) - r - lo_{c}) / 6 - 0.5) AS BIGINT), CAST(floor((greatest(a{c}, {'by_' if c == 'y' else 'b' + c}) + r - lo_{c}) / 6 - 0.5) AS BIGINT) + 1)) AS {i}"


@_query(f"""{_SEG}, lo AS (SELECT skel_id, min(x - r_median) AS lo_x, min(y - r_median) AS lo_y, min(z - r_median) AS lo_z FROM sk_node GROUP BY 1),
s2 AS (SELECT *, greatest(ra, rb) AS r, (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az) AS l2 FROM seg JOIN lo USING (skel_id)),
vi AS (SELECT *, {_IDX('x', 'i')} FROM s2), vj AS (SELECT *, {_IDX('y', 'j')} FROM vi), vk AS (SELECT *, {_IDX('z', 'k')} FROM vj),
p AS (SELECT *, lo_x + (i+0.5)*6 AS x, lo_y + (j+0.5)*6 AS y, lo_z + (k+0.5)*6 AS z FROM vk), q AS (SELECT *, {_T} AS t FROM p)
SELECT skel_id, count(*) AS voxels, round(count(*) * 216.0::DOUBLE, 4) AS volume FROM (SELECT DISTINCT skel_id, i, j, k FROM q WHERE
sqrt((x-ax-t*(bx-ax))*(x-ax-t*(bx-ax)) + (y-ay-t*(by_-ay))*(y-ay-t*(by_-ay)) + (z-az-t*(bz-az))*(z-az-t*(bz-az))) - CASE WHEN l2 > 0 THEN ra + t*(rb-ra) ELSE greatest(ra, rb) END <= 0) GROUP BY 1""", *NE)
def voxel_volume(nodes, edges):
    return measures.volume(nodes, edges, "r_median", 6.0).select("skel_id", "voxels", _r("volume", "volume"))


_VOX = lambda lo, clip: f"""{_SEG}, lo AS ({lo}), s2 AS (SELECT *, greatest(ra, rb) AS r, (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az) AS l2 FROM seg JOIN lo USING (skel_id)),
vi AS (SELECT *, {_IDX('x', 'i')} FROM s2), vj AS (SELECT *, {_IDX('y', 'j')} FROM vi), vk AS (SELECT *, {_IDX('z', 'k')} FROM vj WHERE j >= 0),
p AS (SELECT *, lo_x + (i+0.5)*6 AS x, lo_y + (j+0.5)*6 AS y, lo_z + (k+0.5)*6 AS z FROM vk WHERE {clip}), q AS (SELECT *, {_T} AS t FROM p),
tube AS (SELECT DISTINCT skel_id, i, j, k FROM q WHERE sqrt((x-ax-t*(bx-ax))*(x-ax-t*(bx-ax)) + (y-ay-t*(by_-ay))*(y-ay-t*(by_-ay)) + (z-az-t*(bz-az))*(z-az-t*(bz-az))) - CASE WHEN l2 > 0 THEN ra + t*(rb-ra) ELSE greatest(ra, rb) END <= 0)"""  # noqa: E731
_COUNT = " SELECT n.skel_id, coalesce(c, 0) AS voxels, round(coalesce(c, 0) * 216.0::DOUBLE, 4) AS volume FROM (SELECT DISTINCT skel_id FROM sk_node) n LEFT JOIN (SELECT skel_id, count(*) AS c FROM {of} GROUP BY 1) USING (skel_id)"


@_query(_VOX("SELECT DISTINCT skel_id, 20.0::DOUBLE AS lo_x, 10.0::DOUBLE AS lo_y, 10.0::DOUBLE AS lo_z FROM sk_node", "i BETWEEN 0 AND 6 AND j BETWEEN 0 AND 14 AND k BETWEEN 0 AND 11") + _COUNT.format(of="tube"), *NE)
def voxel_volume_box(nodes, edges):
    return measures.volume(nodes, edges, "r_median", 6.0, BOX).select("skel_id", "voxels", _r("volume", "volume"))


_SOMA_LO = "SELECT skel_id, " + ", ".join(f"least(min({c} - r_median), 20) AS lo_{c}" for c in "xyz") + " FROM sk_node GROUP BY 1"
_BALL = """, ball AS (SELECT skel_id, i, j, k FROM lo, range(0, 60) a(i), range(0, 200) b(j), range(0, 60) c(k) WHERE lo_x + (i+0.5)*6 BETWEEN 20 AND 80 AND lo_y + (j+0.5)*6 BETWEEN 20 AND 80 AND lo_z + (k+0.5)*6 BETWEEN 20 AND 80
  AND (lo_x+(i+0.5)*6-50)*(lo_x+(i+0.5)*6-50) + (lo_y+(j+0.5)*6-50)*(lo_y+(j+0.5)*6-50) + (lo_z+(k+0.5)*6-50)*(lo_z+(k+0.5)*6-50) <= 900)"""


@_query(_VOX(_SOMA_LO, "true") + f"{_BALL}, whole AS (SELECT * FROM tube UNION SELECT * FROM ball)" + _COUNT.format(of="whole"), *NE)
def voxel_volume_soma(nodes, edges):
    somas = nodes.select("skel_id").distinct().select("skel_id", _ball().alias("s")).select("skel_id", "s.*")
    return measures.volume(nodes, edges, "r_median", 6.0, somas=somas).select("skel_id", "voxels", _r("volume", "volume"))


MF = ("mesh_face", "mesh_vert")
_FE = ", fe AS (SELECT mesh_id, least(a,b) AS u, greatest(a,b) AS v FROM mesh_face UNION ALL SELECT mesh_id, least(b,c), greatest(b,c) FROM mesh_face UNION ALL SELECT mesh_id, least(c,a), greatest(c,a) FROM mesh_face)"
_VL = "sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))"
_FEL = f"{_FE}, fel AS (SELECT fe.*, {_VL} AS len FROM fe JOIN mesh_vert p ON p.mesh_id = fe.mesh_id AND p.vert_id = u JOIN mesh_vert q ON q.mesh_id = fe.mesh_id AND q.vert_id = v)"


@_query(f"{_FEL} SELECT DISTINCT mesh_id, u, v, round(len, 4) AS len FROM fel", *MF)
def mesh_edges(faces, verts):
    return mesh.mesh_edges(faces, verts).withColumn("len", F.round("len", 4))


@_query(f"{_FE} SELECT v.mesh_id, n_verts, n_edges, n_faces, n_verts - n_edges + n_faces AS euler FROM (SELECT mesh_id, count(*) AS n_verts FROM mesh_vert GROUP BY 1) v JOIN (SELECT mesh_id, count(*) AS n_edges FROM (SELECT DISTINCT * FROM fe) GROUP BY 1) e USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS n_faces FROM mesh_face GROUP BY 1) f USING (mesh_id)", *MF)
def mesh_euler(faces, verts):
    return mesh.euler_number(verts, faces)


_COR = """, cor AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS wx, c.y-a.y AS wy, c.z-a.z AS wz, (a.x+b.x+c.x)/3 AS cx FROM mesh_face f
JOIN mesh_vert a ON a.mesh_id = f.mesh_id AND a.vert_id = f.a JOIN mesh_vert b ON b.mesh_id = f.mesh_id AND b.vert_id = f.b JOIN mesh_vert c ON c.mesh_id = f.mesh_id AND c.vert_id = f.c),
geo AS (SELECT *, uy*wz-uz*wy AS mx, uz*wx-ux*wz AS my, ux*wy-uy*wx AS mz FROM cor)"""


@_query(f"{_COR} SELECT mesh_id, face_id, round(sqrt(mx*mx+my*my+mz*mz)/2, 4) AS area, round(mz/nullif(sqrt(mx*mx+my*my+mz*mz), 0), 4) AS nz, round(cx, 4) AS cx FROM geo", *MF)
def face_geometry(faces, verts):
    return mesh.face_geometry(faces, verts).select("mesh_id", "face_id", _r("area", "area"), _r("nz", "nz"), _r("cx", "cx"))


@_query(f"{_COR} SELECT mesh_id, round(sum(sqrt(mx*mx+my*my+mz*mz)/2), 4) AS area FROM geo GROUP BY 1", *MF)
def mesh_area(faces, verts):
    return mesh.face_geometry(faces, verts).groupBy("mesh_id").agg(_r(F.sum("area"), "area"))


@_query(f"{_FEL} SELECT mesh_id, round(quantile_cont(len, 0.5), 4) AS median_len FROM fel GROUP BY 1", *MF)
def median_edge_length(faces, verts):
    return mesh.median_edge_length(faces, verts).withColumn("median_len", F.round("median_len", 4))


@_query(f"{_COR} SELECT mesh_id, face_id, CAST(i AS BIGINT) AS sample_id, round(CASE i WHEN 0 THEN (ax + (ax + ux) + (ax + wx)) / 3 WHEN 1 THEN ax WHEN 2 THEN ax + ux ELSE ax + wx END, 4) AS x, round(CASE i WHEN 0 THEN ay + (uy + wy) / 3 WHEN 1 THEN ay WHEN 2 THEN ay + uy ELSE ay + wy END, 4) AS y FROM geo, (VALUES (0), (1), (2), (3)) s(i)", *MF)
def face_samples(faces, verts):
    return mesh.face_samples(faces, verts, "4").select("mesh_id", "face_id", "sample_id", _r("x", "x"), _r("y", "y"))


@_query("SELECT v.mesh_id, CAST(floor(sqrt((v.x-o.x)*(v.x-o.x) + (v.y-o.y)*(v.y-o.y) + (v.z-o.z)*(v.z-o.z)) / 25) AS BIGINT) AS shell, count(*) AS n FROM mesh_vert v JOIN mesh_vert o ON o.mesh_id = v.mesh_id AND o.vert_id = 0 GROUP BY 1, 2", "mesh_vert")
def shell_hist(verts):
    return mesh.shell_histogram(verts, 25.0)


@_query("SELECT skel_id, CAST(floor(x / 20) AS BIGINT) AS i, CAST(floor(y / 50) AS BIGINT) AS j, count(*) AS n FROM sk_node GROUP BY 1, 2, 3", "sk_node")
def vertex_density_2d(nodes):
    return mesh.density_2d(nodes, 20.0, 50.0)


@_query(f"{_FE} SELECT DISTINCT mesh_id AS skel_id, least(u // 5, v // 5) AS u, greatest(u // 5, v // 5) AS v FROM fe WHERE u // 5 <> v // 5", *MF)
def skeleton_edges_from_mesh(faces, verts):
    members = verts.select(F.col("mesh_id").alias("skel_id"), F.expr("vert_id div 5").alias("node_id"), "vert_id")
    return mesh.skeleton_edges_from_mesh(mesh.mesh_edges(faces, verts), members)


@_query("""SELECT mesh_id, face_id, a, b, c FROM (SELECT f.mesh_id, f.face_id, a.k AS a, b.k AS b, c.k AS c FROM mesh_face f
JOIN (SELECT mesh_id, vert_id, row_number() OVER (PARTITION BY mesh_id ORDER BY vert_id) - 1 AS k FROM mesh_vert WHERE vert_id % 20 < 10) a ON a.mesh_id = f.mesh_id AND a.vert_id = f.a
JOIN (SELECT mesh_id, vert_id, row_number() OVER (PARTITION BY mesh_id ORDER BY vert_id) - 1 AS k FROM mesh_vert WHERE vert_id % 20 < 10) b ON b.mesh_id = f.mesh_id AND b.vert_id = f.b
JOIN (SELECT mesh_id, vert_id, row_number() OVER (PARTITION BY mesh_id ORDER BY vert_id) - 1 AS k FROM mesh_vert WHERE vert_id % 20 < 10) c ON c.mesh_id = f.mesh_id AND c.vert_id = f.c)""", *MF)
def submesh(faces, verts):
    return mesh.submesh(faces, verts.where("vert_id % 20 < 10").select("mesh_id", "vert_id"))


def _per_skeleton(nodes: DataFrame, edges: DataFrame, f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """A kernel applied to each skeleton: its nodes by id and its edges as row numbers."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node_id").reset_index(drop=True)
        at = pd.Series(n.index, index=n["node_id"])
        pairs = np.stack([at.reindex(e["u"]).to_numpy(), at.reindex(e["v"]).to_numpy()], 1).astype(int)
        out = f(n, pairs)
        out.insert(0, "skel_id", n["skel_id"].iloc[0] if len(n) else None)
        return out

    return nodes.groupBy("skel_id").cogroup(edges.groupBy("skel_id")).applyInPandas(run, schema)


def _edge_frame(e: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": e[:, 0].astype("int64"), "v": e[:, 1].astype("int64")})


_MST = """, pair AS (SELECT skel_id, u, v FROM sk_edge UNION SELECT skel_id, node_id - 2, node_id FROM sk_node WHERE node_id >= 2),
e AS (SELECT p.skel_id, u, v, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS len FROM pair p JOIN sk_node a ON a.skel_id = p.skel_id AND a.node_id = u JOIN sk_node b ON b.skel_id = p.skel_id AND b.node_id = v),
b2 AS (SELECT skel_id, u AS p, v AS q, u, v, len FROM e UNION ALL SELECT skel_id, v, u, u, v, len FROM e),
r AS (SELECT skel_id, u, v, len, u AS at FROM e UNION SELECT r.skel_id, r.u, r.v, r.len, b2.q FROM r JOIN b2 ON b2.skel_id = r.skel_id AND b2.p = r.at WHERE (b2.len, b2.u, b2.v) < (r.len, r.u, r.v))
SELECT skel_id, u, v FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.skel_id = e.skel_id AND r.u = e.u AND r.v = e.v AND r.at = e.v)"""


@_query(_MST, *NE, recursive=True)
def mst(nodes, edges):
    """Minimum spanning forest of the skeleton's edges with shortcuts between nodes two apart."""
    extra = nodes.where("node_id >= 2").select("skel_id", (F.col("node_id") - 2).alias("u"), F.col("node_id").alias("v"))
    e = edit.norm_edges(edges.select("skel_id", "u", "v").unionByName(extra))
    return forest.spanning_forest(measures.edge_lengths(nodes, e).withColumnRenamed("length", "len"))


@_query(None, *NE)
def bridge_gaps(nodes, edges):
    cut = edges.where("v % 11 <> 5")
    return _per_skeleton(nodes, cut, lambda n, p: _edge_frame(tree.bridge_gaps(n[["x", "y", "z"]].to_numpy(), p)), "skel_id long, u long, v long")


_ALIKE = lambda p, q: f"abs({p} - {q}) <= 0.5 * greatest(abs({p}), abs({q}))"
_GAP = lambda p, q: f"sqrt(({p}x-{q}x)*({p}x-{q}x) + ({p}y-{q}y)*({p}y-{q}y) + ({p}z-{q}z)*({p}z-{q}z))"
_DOWN = f"""{_DEG}, k AS (SELECT n.skel_id, n.node_id, n.parent_id, n.x, n.y, n.z, n.r_median AS r, degree, degree = 2 AND n.node_id <> 0 AS inner_ FROM sk_node n JOIN deg USING (skel_id, node_id)),
up AS (SELECT skel_id, node_id AS bottom, parent_id AS at, CAST(1 AS BIGINT) AS hops FROM k WHERE NOT inner_ AND parent_id IS NOT NULL
  UNION ALL SELECT u.skel_id, u.bottom, k.parent_id, u.hops + 1 FROM up u JOIN k ON k.skel_id = u.skel_id AND k.node_id = u.at WHERE k.inner_),
mem AS (SELECT u.skel_id, u.bottom, u.at AS node_id, least(t.at, u.bottom) AS a, greatest(t.at, u.bottom) AS far, CASE WHEN u.bottom < t.at THEN u.hops ELSE t.hops - u.hops END AS pos, k.x, k.y, k.z, k.r
  FROM up u JOIN k ON k.skel_id = u.skel_id AND k.node_id = u.at AND k.inner_ JOIN (SELECT up.* FROM up JOIN k ON k.skel_id = up.skel_id AND k.node_id = up.at AND NOT k.inner_) t ON t.skel_id = u.skel_id AND t.bottom = u.bottom),
cut AS (SELECT skel_id, bottom, pos, CAST(0 AS BIGINT) AS run, CAST(1 AS BIGINT) AS n, r AS total FROM mem WHERE pos = 1
  UNION ALL SELECT c.skel_id, c.bottom, m.pos, CASE WHEN {_ALIKE("m.r", "(c.total / c.n)")} THEN c.run ELSE c.run + 1 END, CASE WHEN {_ALIKE("m.r", "(c.total / c.n)")} THEN c.n + 1 ELSE 1 END, CASE WHEN {_ALIKE("m.r", "(c.total / c.n)")} THEN c.total + m.r ELSE m.r END
  FROM cut c JOIN mem m ON m.skel_id = c.skel_id AND m.bottom = c.bottom AND m.pos = c.pos + 1),
seq AS (SELECT m.*, run, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(z) OVER w AS lz FROM mem m JOIN cut USING (skel_id, bottom, pos) WINDOW w AS (PARTITION BY skel_id, bottom, run ORDER BY pos)),
st AS (SELECT *, coalesce(sqrt((x-lx)*(x-lx) + (y-ly)*(y-ly) + (z-lz)*(z-lz)), 0) AS step FROM seq),
runs AS (SELECT skel_id, bottom, a, far, run, list(r) AS radii, count(*) AS n, sum(step) AS len, {", ".join(f"sum(CASE WHEN step > 0 THEN step * ({c} + l{c}) / 2 ELSE 0 END) AS m{c}, sum({c}) AS s{c}, arg_min({c}, pos) AS h{c}, arg_max({c}, pos) AS t{c}" for c in "xyz")}, min(node_id) AS name FROM st GROUP BY 1, 2, 3, 4, 5),
j AS (SELECT u.*, list_aggregate(radii, 'median') AS own, max(run) OVER (PARTITION BY u.skel_id, u.bottom) AS last, b.node_id AS b, {", ".join(f"p.{c} AS p{c}, q.{c} AS q{c}" for c in ("x", "y", "z", "r", "degree"))} FROM runs u
  JOIN k p ON p.skel_id = u.skel_id AND p.node_id = a JOIN k q ON q.skel_id = u.skel_id AND q.node_id = far JOIN mem b ON b.skel_id = u.skel_id AND b.bottom = u.bottom AND b.pos = 1),
g AS (SELECT *, {_GAP("p", "h")} AS ga, {_GAP("q", "t")} AS gz, run = 0 AND a <> 0 AND (pdegree = 1 OR pdegree >= 3) AND {_ALIKE("pr", "own")} AS to_a, run = last AND far <> 0 AND (qdegree = 1 OR qdegree >= 3) AND {_ALIKE("qr", "own")} AS can_z FROM j),
f AS (SELECT *, can_z AND NOT to_a AS to_z, CASE WHEN to_a THEN a WHEN can_z THEN far ELSE name END AS target,
  {", ".join(f"CASE WHEN to_a THEN CASE WHEN len + ga > 0 THEN (m{c} + ga * (p{c} + h{c}) / 2) / (len + ga) ELSE (s{c} + p{c}) / (n + 1) END WHEN can_z THEN CASE WHEN len + gz > 0 THEN (m{c} + gz * (q{c} + t{c}) / 2) / (len + gz) ELSE (s{c} + q{c}) / (n + 1) END ELSE CASE WHEN len > 0 THEN m{c} / len ELSE s{c} / n END END AS o{c}" for c in "xyz")},
  CASE WHEN to_a THEN list_aggregate(list_append(radii, pr), 'median') WHEN can_z THEN list_aggregate(list_append(radii, qr), 'median') ELSE own END AS o_r FROM g),
placed AS (SELECT skel_id, target AS node_id, {", ".join(f"arg_max(o{c}, (a, b)) AS {c}" for c in "xyz")}, arg_max(o_r, (a, b)) AS r FROM f GROUP BY 1, 2),
made AS (SELECT * FROM placed UNION ALL SELECT skel_id, node_id, x, y, z, r FROM k WHERE NOT inner_ AND NOT EXISTS (SELECT 1 FROM placed WHERE placed.skel_id = k.skel_id AND placed.node_id = k.node_id))"""


@_query(f"{_DOWN} SELECT skel_id, row_number() OVER (PARTITION BY skel_id ORDER BY node_id) - 1 AS node_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(r, 4) AS r FROM made", *NE, recursive=True)
def downsample(nodes, edges):
    node, _, _ = resample.downsample(nodes, edges, "r_median", rtol=0.5, how="median")
    return node.select("skel_id", "node_id", *(_r(c, c, 3) for c in "xyz"), _r("r_median", "r"))


@_query(f"""{_DOWN}, ids AS (SELECT skel_id, node_id, row_number() OVER (PARTITION BY skel_id ORDER BY node_id) - 1 AS new_id FROM made),
t AS (SELECT skel_id, st.node_id, target FROM st JOIN f USING (skel_id, bottom, run) UNION ALL SELECT skel_id, node_id, node_id FROM k WHERE NOT inner_),
m AS (SELECT t.skel_id, t.node_id, new_id FROM t JOIN ids ON ids.skel_id = t.skel_id AND ids.node_id = t.target)
SELECT DISTINCT e.skel_id, least(p.new_id, q.new_id) AS u, greatest(p.new_id, q.new_id) AS v FROM sk_edge e JOIN m p ON p.skel_id = e.skel_id AND p.node_id = e.u JOIN m q ON q.skel_id = e.skel_id AND q.node_id = e.v WHERE p.new_id <> q.new_id""", *NE, recursive=True)
def downsample_edges(nodes, edges):
    return resample.downsample(nodes, edges, "r_median", rtol=0.5, how="median")[1]


@_query(None, *NE)
def fill_labels(nodes, edges):
    return _per_skeleton(nodes, edges, lambda n, p: pd.DataFrame({"node_id": n["node_id"], "ntype": tree.fill_labels(n["ntype"].to_numpy(), p)}), "skel_id long, node_id long, ntype int")


@_query(None, *MF)
def skeletonize(faces, verts):
    """All stages, cell bodies among them; held against meshes of known shape in tests/test_skeletonize.py."""
    return sk.skeletonize(verts, faces).node.select("skel_id", "node_id", *(_r(c, c) for c in ("x", "y", "z", *sk.RADII)), "ntype")


@_query(None, *MF)
def skeletonize_edges(faces, verts):
    return sk.skeletonize(verts, faces).edge


@_query(None, *MF)
def calibrate_radii(faces, verts):
    s = sk.skeletonize(verts, faces)
    return mesh.calibrate_radii(s.node, s.edge, verts, s.vert).withColumn("calibrated", F.round("calibrated", 4))


@_query(None, *MF)
def calibrate_radii_outer(faces, verts):
    s = sk.skeletonize(verts, faces)
    return shape.calibrate_radii(s.node, s.edge, verts, faces, s.vert).withColumn("calibrated", F.round("calibrated", 4))


_MESH_BIN = lambda c, n: f"CAST(least(floor(({c} - CASE WHEN hi_{c} > lo_{c} THEN lo_{c} ELSE lo_{c} - 0.5 END) / CASE WHEN hi_{c} > lo_{c} THEN hi_{c} - lo_{c} ELSE 1.0 END * {n}.0), {n - 1}) AS BIGINT)"


@_query(f""", m AS (SELECT mesh_id, min(x) AS lo_x, max(x) AS hi_x, min(z) AS lo_z, max(z) AS hi_z FROM mesh_vert GROUP BY 1)
SELECT mesh_id, {_MESH_BIN("x", 16)} AS i, {_MESH_BIN("z", 8)} AS j, count(*) AS n FROM mesh_vert JOIN m USING (mesh_id) GROUP BY 1, 2, 3""", "mesh_vert")
def projection_density(verts):
    return projection.density(projection.project(verts, "xz"), (16, 8))


@_query("SELECT mesh_id, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, max({c}) - min({c}) AS range_{c}" for c in "xyz") + " FROM mesh_vert GROUP BY 1", "mesh_vert")
def axis_extents(verts):
    return projection.axis_extents(verts, "mesh_id")


@_query(", k AS (SELECT skel_id, node_id FROM sk_node WHERE z * 2.0 BETWEEN 20 AND 120 AND y * 2.0 BETWEEN 30 AND 160)\nSELECT e.skel_id, u, v FROM sk_edge e JOIN k a ON a.skel_id = e.skel_id AND a.node_id = u JOIN k b ON b.skel_id = e.skel_id AND b.node_id = v", *NE)
def projection_window(nodes, edges):
    return projection.visible_edges(projection.crop(projection.project(nodes, "zy", scale=2.0), (20, 120), (30, 160)), edges).select("skel_id", "u", "v")


@_query("SELECT n.skel_id, node_id, round(n.x - 1.5 * r, 4) AS x_lo, round(n.x + 1.5 * r, 4) AS x_hi, round(n.y - 1.5 * r, 4) AS y_lo, round(n.y + 1.5 * r, 4) AS y_hi FROM sk_node n JOIN (SELECT skel_id, r_median AS r FROM sk_node WHERE node_id = 0) USING (skel_id)", "sk_node")
def node_windows(nodes):
    soma = nodes.where("node_id = 0").select("skel_id", F.col("r_median").alias("soma_radius"))
    return projection.node_windows(nodes, soma, multiplier=1.5).select("skel_id", "node_id", *(_r(c, c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")))


@_query(", c AS (SELECT mesh_id, unnest([a, b, c]) AS vert_id FROM mesh_face)\nSELECT c.mesh_id, " + ", ".join(f"min({x}) AS min_{x}, max({x}) AS max_{x}" for x in "xyz") + " FROM c JOIN mesh_vert v ON v.mesh_id = c.mesh_id AND v.vert_id = c.vert_id GROUP BY 1", *MF)
def face_boxes(faces, verts):
    return projection.face_boxes(faces, verts)


@_query(", c AS (SELECT mesh_id, unnest([a, b, c]) AS vert_id FROM mesh_face)\nSELECT c.mesh_id, " + ", ".join(f"min({x}) - 5 AS min_{x}, max({x}) + 5 AS max_{x}" for x in "xyz") + " FROM c JOIN mesh_vert v ON v.mesh_id = c.mesh_id AND v.vert_id = c.vert_id GROUP BY 1", *MF)
def all_face_boxes(faces, verts):
    return projection.face_boxes(faces, verts, margin=5.0)


@_query("SELECT skel_id, u - 1 AS u, v - 1 AS v FROM sk_edge WHERE u > 0", *NE)
def without_root(nodes, edges):
    return projection.without_root(nodes, edges)[1].select("skel_id", "u", "v")
