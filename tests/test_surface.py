"""Nearest items, surfaces, geodesic distances, clusters and forests against plain NumPy and Python."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrion.functions import geometry as g
from dendrion.kernels import tree
from dendrion.operators import contacts, forest, geodesic, graph, measures, mesh, nearest, surface
from dendrion.plans import catalog, views


def grid_mesh(n, rng, height=3.0, z=0.0):
    """An n x n height field as (verts, faces)."""
    verts = [(i * n + j, float(i), float(j), z + float(rng.random() * height)) for i in range(n) for j in range(n)]
    faces = [f for i in range(n - 1) for j in range(n - 1) for a in [i * n + j] for f in ((a, a + n, a + 1), (a + 1, a + n, a + n + 1))]
    return verts, faces


def frames(spark, meshes):
    v = [(m, *row) for m, (verts, _) in meshes.items() for row in verts]
    f = [(m, k, *row) for m, (_, faces) in meshes.items() for k, row in enumerate(faces)]
    return spark.createDataFrame(v, "mesh_id long, vert_id long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, face_id long, a long, b long, c long")


def on_triangle(p, a, b, c):
    """The nearest place by a fine search over the sides and the plane."""
    best = []
    for u, v in ((a, b), (b, c), (c, a)):
        d = v - u
        t = 0.0 if not d.any() else min(1.0, max(0.0, (p - u) @ d / (d @ d)))
        best.append(u + t * d)
    n = np.cross(b - a, c - a)
    if n.any():
        q = p - n * ((p - a) @ n) / (n @ n)
        inside = all(np.cross(v - u, q - u) @ n >= -1e-12 for u, v in ((a, b), (b, c), (c, a)))
        if inside:
            best.append(q)
    return min(best, key=lambda q: np.linalg.norm(p - q))


def test_projection_against_all_faces(spark):
    rng = np.random.default_rng(1)
    meshes = {0: grid_mesh(9, rng), 1: grid_mesh(3, rng), 2: ([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], [(0, 1, 2), (0, 0, 0)])}
    verts, faces = frames(spark, meshes)
    points = [(m, k, *map(float, rng.normal(4, 6, 3)), 7.0) for m in (0, 1, 2, 9) for k in range(25)]
    df = spark.createDataFrame(points, "mesh_id long, point_id long, x double, y double, z double, nx double")
    got = {(r["mesh_id"], r["point_id"]): r for r in surface.project(df, surface.face_index(faces, verts)).collect()}
    assert {m for m, _ in got} == {0, 1, 2} and len(got) == 75
    for m, k, *p, extra in points:
        if m == 9:
            continue
        at = {i: np.array(xyz) for i, *xyz in meshes[m][0]}
        q = [on_triangle(np.array(p), *(at[i] for i in f)) for f in meshes[m][1]]
        d = [np.linalg.norm(np.array(p) - x) for x in q]
        r = got[m, k]
        assert abs(r["distance"] - min(d)) < 1e-9 and d[r["face_id"]] <= min(d) + 1e-8 and r["nx"] == extra
        assert np.allclose([r["qx"], r["qy"], r["qz"]], q[r["face_id"]], atol=1e-7)
    some = surface.project(df, surface.face_index(faces, verts), within=3.0).collect()
    assert {(r["mesh_id"], r["point_id"]) for r in some} == {key for key, r in got.items() if r["distance"] <= 3.0}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_owners_with_hot_spaces(spark, monkeypatch, k):
    monkeypatch.setattr(nearest, "LEAF", 4)
    monkeypatch.setattr(nearest, "HOT_PARTS", 10**6)
    rng = np.random.default_rng(k)
    nodes = [(s, i, *map(float, rng.normal(s % 5, 2, 3)), float(rng.random())) for s in range(12) for i in range(8)] + [(50, 0, 9.0, 9.0, 9.0, 20.0)]
    edges = [(s, i, i + 1) for s in range(12) for i in range(7)]
    n = spark.createDataFrame(nodes, "skel_id long, node_id long, x double, y double, z double, r double")
    e = spark.createDataFrame(edges, "skel_id long, u long, v long")
    # more points than make a space hot, most of them at one place
    p = spark.range(1500).select(F.col("id").alias("point_id"), *(F.when(F.col("id") % 3 == 0, F.rand(i) * 8).otherwise(F.lit(1.0)).alias(c) for i, c in enumerate("xyz")))
    p = graph.settled(p)
    for radius in (None, "r"):
        got = {(r["point_id"], r["rank"]): (r["skel_id"], r["distance"]) for r in measures.nearest_skeletons(p, n, e, k, radius).collect()}
        want = {}
        for r in measures.distances(p, n, e, radius=radius).collect():
            want.setdefault(r["point_id"], []).append((round(r["distance"], 9), r["skel_id"]))
        assert len(got) == 1500 * k
        for i, row in want.items():
            for rank, (d, s) in enumerate(sorted(row)[:k], 1):
                assert got[i, rank][0] == s and abs(got[i, rank][1] - d) < 1e-8
    assert "NestedLoop" not in measures.nearest_skeletons(p, n, e, k)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_mixed_reach(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 7, i, *map(float, rng.random(3) * 30), float(rng.choice([0.0, 0.1, 0.5, 1.0, 3.0, 12.0]))) for i in range(300)]
    n = spark.createDataFrame(rows, "skel_id long, node_id long, x double, y double, z double, r double")
    got = {(r["a_skel_id"], r["a_node_id"], r["b_skel_id"], r["b_node_id"]) for r in contacts.overlapping_nodes(n, "r", 0.3).collect()}
    want = {(a[0], a[1], b[0], b[1]) for a, b in itertools.permutations(rows, 2) if a[0] < b[0] and np.linalg.norm(np.subtract(a[2:5], b[2:5])) <= a[5] + b[5] + 0.3}
    assert got == want and len(want) > 300
    assert contacts.overlapping_nodes(n.limit(0), "r").count() == 0


@pytest.mark.parametrize("size", [7, 30, 4096])
def test_geodesic_distances_over_blocks(spark, size):
    rng = np.random.default_rng(size)
    meshes = {0: grid_mesh(8, rng), 3: grid_mesh(5, rng)}
    meshes[0][0].append((64, 50.0, 50.0, 50.0))
    verts, faces = frames(spark, meshes)
    edges = mesh.mesh_edges(faces, verts)
    got = {(r["mesh_id"], r["vert_id"]): r["d"] for r in geodesic.distances(verts, edges, spark.createDataFrame([(0, 5), (3, 0), (3, 24)], "mesh_id long, vert_id long"), size=size).collect()}
    near = {}
    for r in edges.collect():
        near.setdefault((r["mesh_id"], r["u"]), []).append((r["v"], r["len"]))
        near.setdefault((r["mesh_id"], r["v"]), []).append((r["u"], r["len"]))
    want = {}
    for m, sources in ((0, [5]), (3, [0, 24])):
        heap = [(0.0, s) for s in sources]
        while heap:
            d, v = heapq.heappop(heap)
            if (m, v) not in want:
                want[m, v] = d
                for w, length in near.get((m, v), []):
                    heapq.heappush(heap, (d + length, w))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and (0, 64) not in got
    held = [r["n"] for r in geodesic.blocks(verts, size).groupBy("mesh_id", "block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(held) <= size and sum(held) == verts.count()


def test_clusters_by_steps(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, *map(float, rng.random(3) * 9)) for s in range(2) for i in range(150)] + [(0, 500 + i, 100.0, 0.0, 0.0) for i in range(40)]
    got = {(r["skel_id"], r["node_id"]): r["component"] for r in surface.clusters(spark.createDataFrame(rows, "skel_id long, node_id long, x double, y double, z double"), 1.1).collect()}
    name = {(s, i): i for s, i, *_ in rows}
    for _ in range(40):
        for a, b in itertools.combinations(rows, 2):
            if a[0] == b[0] and np.linalg.norm(np.subtract(a[2:], b[2:])) <= 1.1:
                name[a[:2]] = name[b[:2]] = min(name[a[:2]], name[b[:2]])
    assert got == name and len(set(name.values())) > 3


def test_forest_against_kruskal(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for s in range(5):
        xyz = np.round(rng.random((30, 3)), 1)
        pairs = np.unique(np.sort(rng.integers(0, 30, (70, 2)), axis=1), axis=0)
        rows += [(s, int(u), int(v), float(np.linalg.norm(xyz[u] - xyz[v]))) for u, v in pairs]
        want |= {(s, int(u), int(v)) for u, v in tree.spanning_forest(xyz, pairs[pairs[:, 0] != pairs[:, 1]])}
    df = spark.createDataFrame(rows, "skel_id long, u long, v long, len double")
    got = {tuple(r) for r in forest.spanning_forest(df).collect()}
    # equal lengths may swap edges between two right forests
    cost = {(s, u, v): d for s, u, v, d in rows}
    assert len(got) == len(want) and abs(sum(map(cost.get, got)) - sum(map(cost.get, want))) < 1e-9
    assert forest.spanning_forest(df.limit(0)).count() == 0


def test_touching_planes_are_one_site_each(spark):
    rng = np.random.default_rng(0)
    low, high = grid_mesh(6, rng, 0.0), grid_mesh(6, rng, 0.0, z=0.5)
    verts, faces = frames(spark, {0: low, 1: high})
    turned = faces.select("mesh_id", "face_id", "a", F.col("c").alias("b"), F.col("b").alias("c"))
    seeds = spark.createDataFrame([(0, 1, 1, 1.0, 1.0, 0.2), (0, 1, 2, 1.5, 1.0, 0.3), (0, 1, 3, 4.4, 4.4, 0.2), (0, 1, 4, 2.5, 2.5, 40.0)], "a_mesh_id long, b_mesh_id long, seed_id long, x double, y double, z double")
    s = surface.map_sites(seeds, (faces, verts), (turned, verts), tol=0.6, radius=0.8, scheme="7")
    sites = {r["site"]: r for r in s.site.collect()}
    assert {r["seed_id"]: r["site"] for r in s.seed.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert all(abs(r["area_a"] - r["n_faces_a"] / 2) < 1e-9 and r["area_a"] == r["area_b"] for r in sites.values())
    assert sites[1]["n_seeds"] == 2 and (sites[1]["min_z"], sites[1]["max_z"]) == (0.0, 0.5)
    assert abs(s.pair.agg(F.sum("weight")).first()[0] - s.site.agg(F.sum(F.col("area_a") + F.col("area_b"))).first()[0]) < 1e-9
    # surfaces that look the same way don't touch, nor do those beyond the tolerance
    assert surface.map_sites(seeds, (faces, verts), (faces, verts), tol=0.6, radius=0.8).site.count() == 0
    assert surface.map_sites(seeds, (faces, verts), (turned, verts), tol=0.4, radius=0.8).site.count() == 0
    one = surface.map_sites(seeds, (faces, verts), (turned, verts), tol=0.6, radius=0.8, sides="a").site.first()
    assert one["n_faces_b"] == 0 and one["area_mean"] == one["area_a"]
    stats = surface.with_statistics(s, (faces, verts), (turned, verts)).collect()
    assert all(r["dispersion_a"] < 1e-9 and abs(r["opposition"] + 1) < 1e-9 for r in stats)


def test_release_and_query_again(spark):
    sf = "/root/testdata/sf0.001"
    first = catalog.QUERIES["path_length"](spark, sf).count()
    graph.release(spark)
    assert not views._WRITTEN and catalog.QUERIES["path_length"](spark, sf).count() == first
    assert g.unit_factor("um", "nm") == pytest.approx(1000)


def test_roots_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    n = 3000
    order = np.random.default_rng(2).permutation(n)
    rows = [(0, int(a), int(b)) for a, b in itertools.pairwise(order)] + [(1, 5, 6), (1, 6, 7), (2, 1, 2)]
    rounds = []
    plain = forest.settled
    monkeypatch.setattr(forest, "settled", lambda df: rounds.append(1) or plain(df))
    roots = spark.createDataFrame([(0, int(order[0])), (1, 6)], "skel_id long, node_id long")
    got = {(r["skel_id"], r["node_id"]): r["parent_id"] for r in forest.rooted(spark.createDataFrame(rows, "skel_id long, u long, v long"), roots).collect()}
    assert got == {(0, int(b)): int(a) for a, b in itertools.pairwise(order)} | {(1, 5): 6, (1, 7): 6} and len(rounds) < 20


def test_cycles(spark):
    ring = [(0, i, i + 1) for i in range(9)] + [(0, 2, 6), (0, 3, 8)]
    more = [(1, 0, 1), (1, 1, 2), (1, 5, 6), (1, 6, 7), (1, 5, 7), (2, 0, 1)]
    node = spark.createDataFrame([(s, i) for s, m in ((0, 10), (1, 9), (2, 3)) for i in range(m)], "skel_id long, node_id long")
    got = {}
    for r in forest.cycles(node, spark.createDataFrame(ring + more, "skel_id long, u long, v long")).orderBy("pos").collect():
        got.setdefault((r["skel_id"], r["component"]), []).append(r["node_id"])
    assert got == {(0, 0): [5, 4, 3, 2, 6], (1, 5): [6, 5, 7]}
