"""What two-dimensional views of skeletons and meshes show, as relations: projection, windows, densities, extents.

Everything here is a projection, a range filter or an aggregate with partial combination; rows
with a null coordinate lie in no window and no bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "xyz"


def plane_axes(plane: str) -> tuple[str, str]:
    """The horizontal and the vertical coordinate of a plane such as ``xy`` or ``zx``."""
    if len(plane) != 2 or plane[0] == plane[1] or not set(plane) <= set(AXES):
        raise ValueError("a plane is two different letters of xyz")
    return plane[0], plane[1]


def project(rows: DataFrame, plane: str = "xy", *, scale: float = 1.0) -> DataFrame:
    """Adds ``px, py``, the scaled coordinates in the plane."""
    h, v = plane_axes(plane)
    return rows.withColumns({"px": F.col(h) * F.lit(float(scale)), "py": F.col(v) * F.lit(float(scale))})


def _within(c: Column, limits: tuple[float, float] | None) -> Column:
    return F.lit(True) if limits is None else c.between(float(limits[0]), float(limits[1]))


def crop(projected: DataFrame, xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None) -> DataFrame:
    """Rows in the window, its border included; a side that isn't given is open."""
    return projected.where(_within(F.col("px"), xlim) & _within(F.col("py"), ylim))


def visible_edges(cropped: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the cropped nodes."""
    columns, ends = edges.columns, cropped.select("skel_id", "node_id").distinct()
    for end in ("u", "v"):
        edges = edges.join(ends.withColumnRenamed("node_id", end), ["skel_id", end], "left_semi")
    return edges.select(columns)


def _bin(c: Column, lo: Column, hi: Column, bins: int) -> Column:
    # a single value lies in the middle of a range of width 1
    lo, width = F.when(hi > lo, lo).otherwise(lo - 0.5), F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.least(F.floor((c - lo) / width * F.lit(float(bins))), F.lit(bins - 1)).cast("long")


def density(projected: DataFrame, bins: int | tuple[int, int] = 800, *, by: str = "mesh_id") -> DataFrame:
    """``by, i, j, n``: counts in bins of equal width between the extremes of each ``by``; the last bin is closed.

    Empty bins have no row.  The extremes are one row for each ``by``, joined back rather than
    taken over a window, so that a large mesh is never sorted.
    """
    nx, ny = (bins, bins) if isinstance(bins, int) else bins
    if nx < 1 or ny < 1:
        raise ValueError("bins is a positive number or two of them")
    rows = projected.where("px is not null and py is not null").select(by, "px", "py")
    ends = rows.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max))))
    placed = rows.join(ends, by).select(by, _bin(F.col("px"), F.col("lo_px"), F.col("hi_px"), nx).alias("i"), _bin(F.col("py"), F.col("lo_py"), F.col("hi_py"), ny).alias("j"))
    return placed.groupBy(by, "i", "j").agg(F.count(F.lit(1)).alias("n"))


def axis_extents(rows: DataFrame, by: str) -> DataFrame:
    """``by`` and, for each axis, its limits and range, as the three standard views share them."""
    ends = rows.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))
    return ends.withColumns({f"range_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES})


def node_windows(nodes: DataFrame, soma: DataFrame, plane: str = "xy", *, multiplier: float = 1.0, scale: float = 1.0) -> DataFrame:
    """``skel_id, node_id, x_lo, x_hi, y_lo, y_hi``: the window around each node, as wide as its skeleton's cell body.

    ``soma`` has ``skel_id, soma_radius``, one row for each skeleton; skeletons without one have no windows.
    """
    at = project(nodes, plane, scale=scale).join(soma.select("skel_id", (F.col("soma_radius") * F.lit(float(multiplier)) * F.lit(float(scale))).alias("reach")), "skel_id")
    return at.select("skel_id", "node_id", *((F.col(p) + s * F.col("reach")).alias(f"{n}_{e}") for n, p in (("x", "px"), ("y", "py")) for e, s in (("lo", -1), ("hi", 1))))


def face_boxes(faces: DataFrame, verts: DataFrame, *, margin: float = 0.0, by: tuple[str, ...] = ("mesh_id",)) -> DataFrame:
    """The box around the corners of the faces of each ``by`` (columns of ``faces``), widened by ``margin`` on all sides."""
    corners = faces.select("mesh_id", *(c for c in by if c != "mesh_id"), F.explode(F.array("a", "b", "c")).alias("vert_id")).distinct()
    at = corners.join(verts.select("mesh_id", "vert_id", *AXES), ["mesh_id", "vert_id"])
    return at.groupBy(*by).agg(*(f.alias(n) for c in AXES for n, f in ((f"min_{c}", F.min(c) - margin), (f"max_{c}", F.max(c) + margin))))


def box_union(boxes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The box around all boxes of each ``by``."""
    return boxes.groupBy(*by).agg(*(f(n).alias(n) for c in AXES for n, f in ((f"min_{c}", F.min), (f"max_{c}", F.max))))


def without_root(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skeletons without node 0 and its edges; the ids of the others move down by one."""
    left = nodes.where("node_id > 0").withColumn("node_id", F.col("node_id") - 1)
    return left, edges.where("u > 0 and v > 0").withColumns({"u": F.col("u") - 1, "v": F.col("v") - 1})


def tapered_outlines(nodes: DataFrame, edges: DataFrame, radius: str, plane: str = "xy", *, scale: float = 1.0) -> DataFrame:
    """``skel_id, u, v, h0, v0 .. h3, v3``: the corners of each edge's outline in the plane, around the shape.

    The outline joins the two circles of the ends across the edge's direction in the plane; edges that
    are seen end on, or have no length, have none.
    """
    h, v = plane_axes(plane)
    ends = edges.select("skel_id", "u", "v")
    for end, k in (("u", "p"), ("v", "q")):
        ends = ends.join(nodes.select("skel_id", F.col("node_id").alias(end), *((F.col(c) * F.lit(float(scale))).alias(f"{k}{n}") for n, c in (("h", h), ("v", v), ("r", radius)))), ["skel_id", end])
    dh, dv = F.col("qh") - F.col("ph"), F.col("qv") - F.col("pv")
    # the direction turned by a right angle, as the cross product with the plane's normal turns it
    sign = F.lit(1.0 if plane in ("xy", "yz", "zx") else -1.0)
    ends = ends.withColumns({"nh": sign * dv, "nv": -sign * dh}).withColumn("l", F.sqrt(F.col("nh") * F.col("nh") + F.col("nv") * F.col("nv"))).where("l > 0")
    corners = [F.col(f"{k}{c}") + s * F.col(f"n{c}") / F.col("l") * F.col(f"{k}r") for k, s in (("p", 1), ("p", -1), ("q", -1), ("q", 1)) for c in "hv"]
    return ends.select("skel_id", "u", "v", *(x.alias(f"{c}{i // 2}") for i, (x, c) in enumerate(zip(corners, "hv" * 4, strict=True))))


def soma_ellipses(somas: DataFrame, plane: str = "xy", *, scale: float = 1.0) -> DataFrame:
    """``skel_id, h, v, width, height, angle``: the shadow of each cell body (skel_id, center, axes, rot) on the plane.

    The shadow of an ellipsoid is an ellipse: of its quadric matrix the dropped coordinate is
    eliminated.  ``width`` is the long axis, whole, and ``angle`` its direction in degrees, 0 to 180.
    """
    names = plane_axes(plane)
    i, j = (AXES.index(c) for c in names)
    k = 3 - i - j
    quadric = {(p, q): sum(((F.col("rot")[p][m] * F.col("rot")[q][m] / (F.col("axes")[m] * F.col("axes")[m])) for m in range(1, 3)), F.col("rot")[p][0] * F.col("rot")[q][0] / (F.col("axes")[0] * F.col("axes")[0])) for p, q in ((i, i), (i, j), (j, j), (i, k), (j, k), (k, k))}
    left = {(p, q): quadric[p, q] - quadric[p, k] * quadric[q, k] / quadric[k, k] for p, q in ((i, i), (i, j), (j, j))}
    rows = somas.select("skel_id", *(F.col("center")[n].alias(c) for n, c in ((i, "h"), (j, "v"))), *(left[x].alias(c) for x, c in (((i, i), "a"), ((i, j), "b"), ((j, j), "c"))))
    a, b, c = (F.col(n) for n in "abc")
    middle, away = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    # the long axis belongs to the smaller eigenvalue, a right angle from the other's direction
    angle = F.pmod(F.degrees(F.atan2(2 * b, a - c)) / 2 + 90, F.lit(180.0))
    return rows.select("skel_id", *((F.col(n) * F.lit(float(scale))).alias(n) for n in "hv"), (2 * F.lit(float(scale)) / F.sqrt(middle - away)).alias("width"), (2 * F.lit(float(scale)) / F.sqrt(middle + away)).alias("height"), F.when(away > 1e-15 * middle, angle).otherwise(F.lit(0.0)).alias("angle"))


def component_labels(verts: DataFrame, node_vert: DataFrame) -> DataFrame:
    """``mesh_id, vert_id, label``: the node that each mesh vertex belongs to (skel_id, node_id, vert_id), -1 without one; of several the greatest."""
    own = node_vert.groupBy(F.col("skel_id").alias("mesh_id"), "vert_id").agg(F.max("node_id").alias("label"))
    return verts.select("mesh_id", "vert_id").join(own, ["mesh_id", "vert_id"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))
