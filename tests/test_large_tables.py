"""What large tables ask of the driver."""

from pyspark.sql import functions as F

from dendrion.operators import contacts, edit, graph


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast(spark):
    rows = graph.settled(spark.range(600_000).select(F.col("id").alias("skel_id"), F.xxhash64("id").alias("node_id")))
    small = graph.settled(spark.range(20).select(F.col("id").alias("skel_id")))
    assert "BroadcastHashJoin" not in planned(rows.join(rows.select("skel_id", F.col("node_id").alias("other")), "skel_id"))
    assert "BroadcastHashJoin" in planned(rows.join(small, "skel_id"))


def test_close_pairs_sends_no_side_to_the_driver(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0), (2, 0, 1.5, 0.0, 0.0, 1.0), (3, 0, 9.0, 0.0, 0.0, 1.0)], "skel_id long, node_id long, x double, y double, z double, r double")
    met = contacts.overlapping_nodes(rows, "r")
    assert "Broadcast" not in planned(met)
    assert [(p.a_skel_id, p.b_skel_id) for p in met.collect()] == [(1, 2)]


def test_listed_nodes_are_not_broadcast(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "skel_id long, node_id long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "skel_id long, u long, v long")
    kept, left = edit.keep_listed(nodes, edges, nodes.where("node_id = 3"), drop=True)
    assert "BroadcastHashJoin LeftOuter" not in planned(kept.drop("x")) and "LeftOuter, BuildRight" not in planned(kept)
    assert kept.count() == 3 and sorted((e.u, e.v) for e in left.collect()) == [(0, 1), (1, 2)]
