"""Queries on what projected views show of edges, cell bodies and vertices, and on cycles and roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, projection
from .registry import query, rounded as _r

NE = ("sk_node", "sk_edge")
_CORNERS = ", ".join(f"round({k}.{c} * 2.0 + {s} * n{c} / l * {k}.r_median * 2.0, 4) AS {a}{i}" for i, (k, s) in enumerate((("p", 1), ("p", -1), ("q", -1), ("q", 1))) for c, a in (("y", "h"), ("z", "v")))


@query(f""", d AS (SELECT e.skel_id, e.u, e.v, q.z - p.z AS ny, -(q.y - p.y) AS nz FROM sk_edge e JOIN sk_node p ON p.skel_id = e.skel_id AND p.node_id = u JOIN sk_node q ON q.skel_id = e.skel_id AND q.node_id = v),
n AS (SELECT *, sqrt(ny*ny + nz*nz) AS l FROM d)
SELECT n.skel_id, n.u, n.v, {_CORNERS} FROM n JOIN sk_node p ON p.skel_id = n.skel_id AND p.node_id = n.u JOIN sk_node q ON q.skel_id = n.skel_id AND q.node_id = n.v WHERE l > 0""", *NE)
def tapered_outlines(nodes, edges):
    """Corners of every edge's outline in the plane of y and z, at twice the size."""
    out = projection.tapered_outlines(nodes, edges, "r_median", "yz", scale=2.0)
    return out.select("skel_id", "u", "v", *(_r(c, c) for c in out.columns[3:]))


_TURN = "radians((skel_id % 7) * 20.0)"
#: The quadric of an ellipsoid with axes 3r, 2r and r whose first axis is turned from x to z about y.
_ELLIPSE = f""", s AS (SELECT skel_id, x, z, y, 3 * r_median AS e, 2 * r_median AS f, r_median AS g, cos({_TURN}) AS co, sin({_TURN}) AS si FROM sk_node WHERE node_id = 0),
q AS (SELECT *, co*co/(e*e) + si*si/(g*g) AS a, co*si/(e*e) - co*si/(g*g) AS b, si*si/(e*e) + co*co/(g*g) AS c FROM s),
m AS (SELECT *, (a + c) / 2 AS mid, sqrt((a-c)*(a-c)/4 + b*b) AS away FROM q)
SELECT skel_id, round(x, 4) AS h, round(z, 4) AS v, round(2 / sqrt(mid - away), 4) AS width, round(2 / sqrt(mid + away), 4) AS height, round(((degrees(atan2(2*b, a-c)) / 2 + 90) % 180 + 180) % 180, 4) AS angle FROM m"""


@query(_ELLIPSE, "sk_node")
def soma_ellipses(nodes):
    """Shadows on the plane of x and z of cell bodies at the roots, turned by their skeleton's number."""
    t = F.radians((F.col("skel_id") % 7) * 20.0)
    r = F.col("r_median")
    zero, one = F.lit(0.0), F.lit(1.0)
    rot = F.array(F.array(F.cos(t), zero, -F.sin(t)), F.array(zero, one, zero), F.array(F.sin(t), zero, F.cos(t)))
    somas = nodes.where("node_id = 0").select("skel_id", F.array("x", "y", "z").alias("center"), F.array(3 * r, 2 * r, r).alias("axes"), rot.alias("rot"))
    out = projection.soma_ellipses(somas, "xz")
    return out.select("skel_id", *(_r(c, c) for c in ("h", "v", "width", "height", "angle")))


@query("SELECT mesh_id, vert_id, CASE WHEN vert_id % 20 < 15 THEN vert_id // 5 ELSE -1 END AS label FROM mesh_vert", "mesh_vert")
def component_labels(verts):
    """The node of every vertex where nodes hold five vertices each and some hold none."""
    members = verts.where("vert_id % 20 < 15").select(F.col("mesh_id").alias("skel_id"), F.expr("vert_id div 5").alias("node_id"), "vert_id")
    return projection.component_labels(verts, members)


_LOOPS = """, e AS (SELECT DISTINCT skel_id, u, v FROM (SELECT skel_id, u, v FROM sk_edge UNION ALL SELECT skel_id, u, v + 3 FROM sk_edge WHERE v % 11 = 5 AND (skel_id, v + 3) IN (SELECT skel_id, node_id FROM sk_node))),
b2 AS (SELECT skel_id, u AS p, v AS q, u, v FROM e UNION ALL SELECT skel_id, v, u, u, v FROM e),
r AS (SELECT skel_id, u, v, u AS here FROM e UNION SELECT r.skel_id, r.u, r.v, b2.q FROM r JOIN b2 ON b2.skel_id = r.skel_id AND b2.p = r.here WHERE (b2.u, b2.v) < (r.u, r.v)),
spare AS (SELECT skel_id, u, v FROM r WHERE here = v),
tree AS (SELECT b2.skel_id, p, q FROM b2 LEFT JOIN spare s ON s.skel_id = b2.skel_id AND s.u = b2.u AND s.v = b2.v WHERE s.u IS NULL),
c AS (SELECT skel_id, min((u, v)) AS uv FROM spare GROUP BY 1),
w AS (SELECT skel_id, uv, uv[1] AS here, [uv[1]] AS path FROM c UNION ALL SELECT w.skel_id, uv, q, list_append(path, q) FROM w JOIN tree t ON t.skel_id = w.skel_id AND t.p = w.here WHERE NOT list_contains(path, q) AND w.here <> uv[2])"""


@query(f"{_LOOPS} SELECT skel_id, unnest(path) AS node_id, CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS pos FROM w WHERE here = uv[2]", *NE, recursive=True)
def cycles(nodes, edges):
    """A cycle of each skeleton once edges have been added."""
    more = edges.where("v % 11 = 5").select("skel_id", "u", (F.col("v") + 3).alias("v"))
    more = more.join(nodes.select("skel_id", F.col("node_id").alias("v")), ["skel_id", "v"]).select("skel_id", "u", "v")
    return forest.cycles(nodes, edges.select("skel_id", "u", "v").unionByName(more)).select("skel_id", "node_id", "pos")


@query("SELECT skel_id, node_id, parent_id FROM sk_node WHERE parent_id IS NOT NULL", *NE)
def rooted_parents(nodes, edges):
    """Parents from edges alone, by an Euler tour from node 0."""
    return forest.rooted(edges, nodes.where("node_id = 0")).select("skel_id", "node_id", "parent_id")
