"""Meshes are dealt out to tasks once, and large ones give the same."""

from pyspark.sql import functions as F

from dendrion.operators import mesh


def strip(spark, n, mesh_id=7):
    verts = spark.range(n).select(F.expr(f"id div 1000000 + {mesh_id}").alias("mesh_id"), F.col("id").alias("vert_id"), F.expr("id div 2 * 1.5").cast("double").alias("x"), F.expr("id % 2").cast("double").alias("y"), (F.col("id") % 3).cast("double").alias("z"))
    faces = spark.range(n - 2).select(F.expr(f"id div 1000000 + {mesh_id}").alias("mesh_id"), F.col("id").alias("face_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return faces, verts


def test_corners_and_edges_shuffle_each_table_once(spark):
    faces, verts = strip(spark, 12)
    for out in (mesh.corners(faces, verts), mesh.mesh_edges(faces, verts), mesh.median_edge_length(faces, verts)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            # the vertices' shuffle stands in the plan for each use and is reused
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(mesh_id") == plan.count("Exchange ") and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange ")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_meshes_give_the_same(spark):
    faces, verts = strip(spark, 12)
    other = strip(spark, 5, 8)
    faces, verts = faces.unionByName(other[0]), verts.unionByName(other[1])
    for f in (mesh._corners, mesh._counted_edges):
        assert sorted(mesh.by_mesh(f, faces, verts, 8).collect()) == sorted(f(faces, verts).collect()) == sorted(mesh.by_mesh(f, faces, verts).collect())


def test_places_are_dealt_out_before_they_stand_for_cells(spark):
    from dendrion.operators import surface

    faces, verts = strip(spark, 12)
    places = verts.select("mesh_id", "vert_id", "x", "y", "z", F.lit(2.0).alias("radius"))
    geometry = mesh.face_geometry(faces, verts)
    out = surface.faces_within(places, geometry, 2.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    near = places.crossJoin(geometry.withColumnRenamed("mesh_id", "m")).where("sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) <= radius")
    assert sorted((r.vert_id, r.face_id) for r in out.collect()) == sorted((r.vert_id, r.face_id) for r in near.collect()) != []
