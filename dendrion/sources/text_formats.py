"""SWC and OBJ text files, read and written through Spark's text source, so they can lie in any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import parents_from_edges


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line``: trimmed lines in file order; a file is read whole, as one row of its lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines")).select("file", "pos", F.trim("col").alias("line")).where("line <> ''")


def read_swc(spark: SparkSession, path: str, *, scale: float = 1.0, keep_types: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``node``, ``edge`` and ``soma`` of all SWC files at a path; ``file`` is the skeleton's name.

    The first row of a file is node 0 and its cell body is a ball; comment lines and rows of fewer than
    seven fields are left out.
    Types are filtered before edges form; an edge needs both of its ends.
    """
    part = F.split("line", r"\s+")
    rows = _lines(spark, path).where(~F.col("line").startswith("#")).select("file", "pos", part.alias("p")).where(F.size("p") >= 7)
    rows = rows.select("file", "pos", F.col("p")[0].cast("double").cast("long").alias("id"), F.col("p")[1].cast("double").cast("int").alias("ntype"), *((F.col("p")[i].cast("double") * scale).alias(n) for i, n in ((2, "x"), (3, "y"), (4, "z"), (5, "radius"))), F.col("p")[6].cast("double").cast("long").alias("parent"))
    if keep_types is not None:
        rows = rows.where(F.col("ntype").isin(keep_types))
    rows = rows.withColumn("node_id", (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).cast("long"))
    up = rows.select("file", F.col("id").alias("parent"), F.col("node_id").alias("parent_node"))
    joined = rows.join(up, ["file", "parent"], "left")
    node = joined.select(F.col("file").alias("skel_id"), "node_id", "x", "y", "z", F.col("radius").alias("r_median"), "ntype", F.col("parent_node").alias("parent_id"))
    edge = joined.where("parent_node is not null and parent_node <> node_id").select(F.col("file").alias("skel_id"), F.least("node_id", "parent_node").alias("u"), F.greatest("node_id", "parent_node").alias("v")).distinct()
    soma = node.where("node_id = 0").select("skel_id", F.array("x", "y", "z").alias("center"), F.array("r_median", "r_median", "r_median").alias("axes"))
    return node, edge, soma


def swc_meta(spark: SparkSession, path: str) -> DataFrame:
    """``skel_id, meta``: the comments of each file, ``key: value`` ones and the members of ``meta {JSON}`` lines, later ones over earlier ones; values as text, in JSON where they are no strings."""
    lines = _lines(spark, path).where(F.col("line").startswith("#"))
    blob = lines.select("file", "pos", F.regexp_extract("line", r"^#\s*(?:meta\s*)?(\{.*\})\s*$", 1).alias("json"))
    members = blob.select("file", "pos", F.explode(F.from_json("json", "map<string,string>")).alias("k", "v"))
    kv = lines.where(~F.col("line").rlike(r"^#\s*(meta\s*)?\{")).where(F.col("line").rlike(r"^#\s*[\w-]+\s*:"))
    kv = kv.select("file", "pos", F.regexp_extract("line", r"^#\s*([\w-]+)\s*:\s*(.*)$", 1).alias("k"), F.regexp_extract("line", r"^#\s*([\w-]+)\s*:\s*(.*)$", 2).alias("v"))
    last = kv.unionByName(members).groupBy("file", "k").agg(F.max_by("v", "pos").alias("v"))
    return last.groupBy(F.col("file").alias("skel_id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))


def write_swc(nodes: DataFrame, edges: DataFrame, path: str, *, radius: str = "r_median", scale: float = 1.0, axis_order: str = "xyz", include_header: bool = True, meta: DataFrame | None = None) -> None:
    """One folder of text per skeleton: ids from 1, parents from a breadth-first tree, -1 for the root and all it can't reach.

    ``meta`` (skel_id, meta: a map) goes into a JSON comment; the root's type is -1 unless it is 1.
    """
    if sorted(axis_order) != ["x", "y", "z"]:
        raise ValueError("axis_order is a permutation of xyz")
    up = parents_from_edges(nodes, edges).select("skel_id", "node_id", F.col("parent_id").alias("bfs_parent"))
    rows = nodes.join(up, ["skel_id", "node_id"], "left")
    fields = [(F.col("node_id") + 1).cast("string"), F.when((F.col("node_id") == 0) & ~F.col("ntype").isin(1, -1), F.lit(-1)).otherwise(F.col("ntype")).cast("string"), *((F.col(c) * scale).cast("string") for c in axis_order), (F.col(radius) * scale).cast("string"), F.coalesce(F.col("bfs_parent") + 1, F.lit(-1)).cast("string")]
    lines = rows.select("skel_id", "node_id", F.concat_ws(" ", *fields).alias("value"))
    heads = nodes.select("skel_id").distinct()
    if include_header:
        lines = lines.unionByName(heads.select("skel_id", F.lit(-1).cast("long").alias("node_id"), F.lit("# id type x y z radius parent").alias("value")))
    if meta is not None:
        lines = lines.unionByName(meta.join(heads, "skel_id", "left_semi").select("skel_id", F.lit(-2).cast("long").alias("node_id"), F.concat(F.lit("# meta "), F.to_json("meta")).alias("value")))
    lines.repartition("skel_id").sortWithinPartitions("skel_id", "node_id").select("skel_id", "value").write.partitionBy("skel_id").text(path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vert`` and ``face`` of all OBJ files at a path; polygons are split as fans, negative indices count from the end."""
    rows = _lines(spark, path).withColumn("p", F.split("line", r"\s+"))
    v = rows.where(F.col("p")[0] == "v").withColumn("vert_id", (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).cast("long"))
    vert = v.select(F.col("file").alias("mesh_id"), "vert_id", *(F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")))
    n = vert.groupBy(F.col("mesh_id").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    f = rows.where(F.col("p")[0] == "f").join(n, "file")
    index = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda t: F.split(t, "/")[0].cast("long"))
    ids = F.transform(index, lambda i: F.when(i < 0, F.col("n") + i).otherwise(i - 1))
    f = f.withColumn("ids", ids)
    fan = F.transform(F.sequence(F.lit(1), F.size("ids") - 2), lambda k: F.struct(F.get(F.col("ids"), F.lit(0)).alias("a"), F.get(F.col("ids"), k).alias("b"), F.get(F.col("ids"), k + 1).alias("c")))
    f = f.where(F.size("ids") >= 3).select("file", "pos", F.posexplode(fan).alias("k", "t"))
    face = f.select(F.col("file").alias("mesh_id"), (F.row_number().over(Window.partitionBy("file").orderBy("pos", "k")) - 1).cast("long").alias("face_id"), "t.a", "t.b", "t.c")
    return vert, face
