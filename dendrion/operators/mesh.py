"""Triangle meshes: ``vert(mesh_id, vert_id, x, y, z)`` and ``face(mesh_id, face_id, a, b, c)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .graph import prepared


#: Vertices up to which a mesh may lie in one partition.
WHOLE = 2_000_000


def by_mesh(f: Callable[[DataFrame, DataFrame], DataFrame], faces: DataFrame, verts: DataFrame, whole: int = WHOLE) -> DataFrame:
    """``f(faces, verts)`` with both sides dealt out by mesh once, so that what ``f`` joins and groups by mesh needs no more shuffles.

    Meshes of more than ``whole`` vertices, of which there are few, are left to the shuffles of ``f`` and so are spread by vertex.
    """
    prepared(verts.sparkSession)
    # a bounded list: there can't be more of them than vertices over whole
    large = [r[0] for r in verts.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("mesh_id").collect()]
    is_large = F.col("mesh_id").isin(large)
    dealt = (df.where(~is_large) if large else df for df in (faces, verts))
    out = f(*map(_dealt, dealt))
    return out.unionByName(f(faces.where(is_large), verts.where(is_large))) if large else out


def _dealt(df: DataFrame) -> DataFrame:
    """By mesh, to a fixed number of tasks: what follows may be many rows for each of these, so they are not gathered in few tasks for being small."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "mesh_id")


def corners(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Each face with its corners' coordinates ax.. cz."""
    return by_mesh(_corners, faces, verts)


def _corners(faces: DataFrame, verts: DataFrame) -> DataFrame:
    out = faces
    for k in "abc":
        out = out.join(verts.select("mesh_id", F.col("vert_id").alias(k), *(F.col(x).alias(k + x) for x in "xyz")), ["mesh_id", k])
    return out


def face_edges(faces: DataFrame) -> DataFrame:
    """``mesh_id, u, v``: three per face, sorted ends, repeats kept."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    return faces.select("mesh_id", F.inline(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))))


def mesh_edges(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """``mesh_id, u, v, len`` of the distinct edges: the weighted surface graph."""
    return by_mesh(_counted_edges, faces, verts).drop("n")


def _counted_edges(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """The distinct edges with ``n``, the faces at each."""
    e = face_edges(faces).groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    a = verts.select("mesh_id", F.col("vert_id").alias("u"), *(F.col(x).alias("a" + x) for x in "xyz"))
    b = verts.select("mesh_id", F.col("vert_id").alias("v"), *(F.col(x).alias("b" + x) for x in "xyz"))
    return e.join(a, ["mesh_id", "u"]).join(b, ["mesh_id", "v"]).select("mesh_id", "u", "v", g.distance(g.vector("a"), g.vector("b")).alias("len"), "n")


def face_geometry(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """``mesh_id, face_id, area, nx.., cx..``: area, unit normal (null for a face without area) and centroid."""
    f = corners(faces, verts)
    n = g.cross(g.minus(g.vector("b"), g.vector("a")), g.minus(g.vector("c"), g.vector("a")))
    f = f.withColumns({f"m{k}": v for k, v in zip("xyz", n, strict=True)})
    double = g.norm(g.vector("m"))
    unit = {f"n{k}": F.when(double > 0, F.col(f"m{k}") / double) for k in "xyz"}
    return f.select("mesh_id", "face_id", (double / 2).alias("area"), *(v.alias(k) for k, v in unit.items()), *(((F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 3).alias("c" + k) for k in "xyz"))


def euler_number(verts: DataFrame, faces: DataFrame) -> DataFrame:
    v = verts.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_verts"))
    e = face_edges(faces).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_edges"))
    f = faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"))
    return v.join(e, "mesh_id").join(f, "mesh_id").withColumn("euler", F.col("n_verts") - F.col("n_edges") + F.col("n_faces"))


def median_edge_length(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Median over the edges of all faces, repeats counted; no sample is needed."""
    return by_mesh(lambda f, v: _counted_edges(f, v).groupBy("mesh_id").agg(F.percentile("len", 0.5, F.col("n")).alias("median_len")), faces, verts)


#: Barycentric sample points of a face by scheme (fixed values): the centroid; with the corners; with the edges' middles too.
SAMPLES = {
    "1c": [(1 / 3, 1 / 3, 1 / 3)],
    "4": [(1 / 3, 1 / 3, 1 / 3), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)],
    "7": [(1 / 3, 1 / 3, 1 / 3), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5)],
}


def face_samples(faces: DataFrame, verts: DataFrame, scheme: str = "4") -> DataFrame:
    """``mesh_id, face_id, sample_id, x, y, z``."""
    f = corners(faces, verts)
    points = [F.struct(F.lit(i).cast("long").alias("sample_id"), *((F.lit(p) * F.col("a" + k) + F.lit(q) * F.col("b" + k) + F.lit(r) * F.col("c" + k)).alias(k) for k in "xyz")) for i, (p, q, r) in enumerate(SAMPLES[scheme])]
    return f.select("mesh_id", "face_id", F.inline(F.array(*points)))


def submesh(faces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Faces all of whose vertices are listed in ``wanted(mesh_id, vert_id)``, renumbered densely."""
    from pyspark.sql import Window

    ids = wanted.distinct().withColumn("new_id", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("vert_id")) - 1).cast("long"))
    out = faces
    for k in "abc":
        out = out.join(ids.select("mesh_id", F.col("vert_id").alias(k), F.col("new_id").alias("new_" + k)), ["mesh_id", k])
    return out.select("mesh_id", "face_id", *(F.col("new_" + k).alias(k) for k in "abc"))


def shell_histogram(verts: DataFrame, step: float) -> DataFrame:
    """``mesh_id, shell, n``: vertices by Euclidean distance from vertex 0, in right-open shells."""
    o = verts.where("vert_id = 0").select("mesh_id", *(F.col(k).alias("o" + k) for k in "xyz"))
    d = verts.join(o, "mesh_id").select("mesh_id", F.floor(g.distance(g.vector(), g.vector("o")) / step).cast("long").alias("shell"))
    return d.groupBy("mesh_id", "shell").agg(F.count(F.lit(1)).alias("n"))


def density_2d(points: DataFrame, width: float, height: float, plane: str = "xy", key: str = "skel_id") -> DataFrame:
    """A 2-D histogram of a projection: ``key, i, j, n``."""
    if len(plane) != 2 or set(plane) - set("xyz") or plane[0] == plane[1]:
        raise ValueError("a plane is two different axes")
    i, j = (F.floor(F.col(c) / s).cast("long") for c, s in zip(plane, (width, height), strict=True))
    return points.select(key, i.alias("i"), j.alias("j")).groupBy(key, "i", "j").agg(F.count(F.lit(1)).alias("n"))


def skeleton_edges_from_mesh(mesh_edge: DataFrame, node_vert: DataFrame) -> DataFrame:
    """Mesh edges seen from the nodes their ends belong to."""
    # dealt out like the edges of ``mesh_edges``
    node_vert = _dealt(node_vert.select(F.col("skel_id").alias("mesh_id"), "vert_id", "node_id"))
    a = node_vert.select("mesh_id", F.col("vert_id").alias("u"), F.col("node_id").alias("p"))
    b = node_vert.select("mesh_id", F.col("vert_id").alias("v"), F.col("node_id").alias("q"))
    e = mesh_edge.join(a, ["mesh_id", "u"]).join(b, ["mesh_id", "v"]).where("p <> q")
    return e.select(F.col("mesh_id").alias("skel_id"), F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()


def calibrate_radii(nodes: DataFrame, edges: DataFrame, verts: DataFrame, node_vert: DataFrame, *, how: str = "percentile", percentile: float = 0.75) -> DataFrame:
    """``skel_id, node_id, calibrated``: a node's vertices measured against the centre line of its own edges."""
    from .measures import with_ends

    e = with_ends(nodes, edges)
    e = e.withColumn("node_id", F.explode(F.array("u", "v")))
    v = node_vert.join(verts.select(F.col("mesh_id").alias("skel_id"), "vert_id", *(F.col(k).alias("p" + k) for k in "xyz")), ["skel_id", "vert_id"])
    d = v.join(e, ["skel_id", "node_id"]).groupBy("skel_id", "node_id", "vert_id").agg(F.min(g.point_segment_distance(g.vector("p"), g.vector("a"), g.vector("b"))).alias("d"))
    fold = F.percentile("d", percentile) if how == "percentile" else F.avg("d") if how == "mean" else F.percentile("d", 0.5)
    return d.groupBy("skel_id", "node_id").agg(fold.alias("calibrated"))
