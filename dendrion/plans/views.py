"""Skeletons, meshes and points derived from the driver's tables, by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.graph import LARGE_BYTES, ON_RELEASE, drop_shuffles, scratch_path, stored

VIEWS = {
    "sk_node": """
WITH q AS (
  SELECT user_id AS skel_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS node_id,
         event_id, event_type, value, props
  FROM events)
SELECT skel_id, node_id,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS x,
       value AS y,
       CAST(event_id % 97 AS DOUBLE) AS z,
       CAST(0.5 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS r_median,
       (CAST(0.5 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) * CAST(0.25 AS DOUBLE)) * (CAST(1.003 AS DOUBLE) + CAST(event_id % 11 AS DOUBLE) / CAST(100 AS DOUBLE)) AS r_mean,
       (CAST(0.5 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) * CAST(0.25 AS DOUBLE)) * (CAST(1 AS DOUBLE) + CAST(event_id % 11 AS DOUBLE) / CAST(200 AS DOUBLE)) AS r_trim,
       CASE WHEN node_id = 0 THEN -1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 3
            WHEN event_type = 'purchase' THEN 4 ELSE 0 END AS ntype,
       CASE WHEN node_id = 0 THEN NULL
            WHEN node_id % 5 = 0 THEN CAST(floor(CAST(node_id AS DOUBLE) / 2) AS BIGINT)
            ELSE node_id - 1 END AS parent_id
FROM q
""",
    "sk_edge": """
SELECT c.skel_id, p.node_id AS u, c.node_id AS v,
       sqrt((c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) + (c.z-p.z)*(c.z-p.z)) AS len
FROM sk_node c JOIN sk_node p ON p.skel_id = c.skel_id AND p.node_id = c.parent_id
""",
    "sk_point": """
SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) * 2 AS x, p_retailprice / 10 AS y, CAST(p_partkey % 97 AS DOUBLE) AS z
FROM part WHERE p_partkey % 20 = 0
""",
    "mesh_vert": """
WITH q AS (
  SELECT l_suppkey AS mesh_id,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS vert_id,
         l_discount, l_tax, l_quantity
  FROM lineitem)
SELECT mesh_id, vert_id,
       CAST(vert_id % 20 AS DOUBLE) * 10 + l_discount * 20 AS x,
       floor(CAST(vert_id AS DOUBLE) / 20) * 10 + l_tax * 20 AS y,
       l_quantity AS z
FROM q
""",
    "mesh_face": """
WITH g AS (
  SELECT a.mesh_id, a.vert_id FROM mesh_vert a
  JOIN mesh_vert b ON a.mesh_id = b.mesh_id AND b.vert_id = a.vert_id + 21
  WHERE a.vert_id % 20 < 19)
SELECT mesh_id, 2*vert_id AS face_id, vert_id AS a, vert_id+1 AS b, vert_id+20 AS c FROM g
UNION ALL
SELECT mesh_id, 2*vert_id+1, vert_id+1, vert_id+21, vert_id+20 FROM g
""",
}

#: For each view, what it reads.
_NEEDS = {"sk_node": ["events"], "sk_edge": ["sk_node"], "sk_point": ["part"], "mesh_vert": ["lineitem"], "mesh_face": ["mesh_vert"]}


_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}
ON_RELEASE.append(_WRITTEN.clear)


def _is_large(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether what the view is made of is large: then another shuffle would only scatter its skeletons and meshes."""
    while name in VIEWS:
        name = _NEEDS[name][0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() > LARGE_BYTES


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table, or the driver's own of that name.

    A derived table is written once per application, to the folder the cluster shares, and read from
    there: queries that use it more than once, and those that follow, don't number its rows again.
    """
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        sql = VIEWS[name]
        for n in _NEEDS[name]:
            sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
        made = spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _NEEDS[name]})
        path = scratch_path(spark, "view")
        # as many files as tasks, so that a small table still keeps all cores busy; a large one has them from the shuffle behind it
        if not _is_large(spark, sf_dir, name):
            made = made.repartition(spark.sparkContext.defaultParallelism)
        made.write.parquet(path)
        drop_shuffles(spark, path)
        _WRITTEN[key] = path, made.schema
    path, schema = _WRITTEN[key]
    return stored(spark, path, schema)


def ctes(*names: str) -> str:
    """The views as common table expressions, each after those it reads."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            if m in VIEWS:
                add(m)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
