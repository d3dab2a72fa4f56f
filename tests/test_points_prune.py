"""Point queries in blocks, and root branches that are too short."""

from pyspark.sql import functions as F

from dendrion.operators import edit, measures

NODE = "skel_id long, node_id long, x double, y double, z double, r double"


def test_blocks_of_points_give_the_same(spark):
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 1.0), (0, 1, 9.0, 0.0, 0.0, 1.0), (1, 0, 0.0, 5.0, 0.0, 1.0), (1, 1, 0.0, 9.0, 0.0, 1.0)], NODE)
    edges = spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "skel_id long, u long, v long")
    points = spark.range(25).select(F.col("id").alias("point_id"), *((F.col("id") * k).cast("double").alias(c) for c, k in zip("xyz", (0.5, 0.25, 0.1), strict=True)))
    for f in (measures.distances, measures.distances_by_nearest_nodes):
        whole = sorted(f(points, nodes, edges, radius="r").collect())
        assert len(whole) == 50 and whole == sorted(f(points, nodes, edges, radius="r", block_points=4).collect())
    assert measures.distances(points.where("point_id < 0"), nodes, edges).count() == 0


def test_short_root_branches_merge(spark):
    # branches of node 0: 1-2 stays near, 3-4 reaches out, 5 is near but apart from the root
    at = [0, 2, 4, 3, 40, 1]
    nodes = spark.createDataFrame([(0, i, float(x), 0.0, 0.0, 1.0) for i, x in enumerate(at)], NODE)
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 3), (0, 3, 4)], "skel_id long, u long, v long")
    somas = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0)], "skel_id long, cx double, cy double, cz double, radius double")
    n, e = edit.prune_neurites(nodes, edges, somas, extent=5.0)
    assert sorted(r["x"] for r in n.collect()) == [0, 1, 3, 40]
    assert sorted((r["u"], r["v"]) for r in e.collect()) == [(0, 1), (1, 2)]
    assert edit.prune_neurites(nodes, edges, somas, extent=0.5)[0].count() == 6
