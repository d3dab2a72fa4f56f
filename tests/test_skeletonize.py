"""Skeletons of meshes with known shape, and the soma rules on hand-made nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrion.kernels import tree
from dendrion.operators import edit, measures, resample, skeletonize as sk


def tube(points, radii, around=16):
    """A tube of rings along a straight line in x: vertices and triangles."""
    angle = 2 * np.pi * np.arange(around) / around
    verts = np.concatenate([np.stack([np.full(around, x), r * np.cos(angle), r * np.sin(angle)], 1) for x, r in zip(points, radii)])
    faces = []
    for i in range(len(points) - 1):
        for k in range(around):
            a, b = i * around + k, i * around + (k + 1) % around
            faces += [(a, b, a + around), (b, b + around, a + around)]
    return verts, np.array(faces)


def meshes(spark, parts):
    v, f = [], []
    for mesh, (verts, faces) in parts.items():
        v += [(mesh, i, *map(float, p)) for i, p in enumerate(verts)]
        f += [(mesh, i, *map(int, t)) for i, t in enumerate(faces)]
    return spark.createDataFrame(v, "mesh_id long, vert_id long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, face_id long, a long, b long, c long")


@pytest.fixture(scope="module")
def built(spark):
    x = np.arange(0, 60, 1.0)
    thin = tube(x, np.full(60, 2.0))
    # a fat ball in the middle of a thin process
    fat = tube(x, np.maximum(1.0, np.sqrt(np.maximum(0, 12.0**2 - (x - 30) ** 2))))
    gap = tube(np.concatenate([x[:20], x[25:45]]), np.full(40, 2.0))
    # no triangle spans the gap
    gap = (gap[0], gap[1][(gap[1] // 16 < 20).all(1) | (gap[1] // 16 >= 20).all(1)])
    return meshes(spark, {1: thin, 2: fat, 3: gap}), {1: thin, 2: fat, 3: gap}


def test_skeletons_of_tubes(built):
    (verts, faces), _ = built
    s = sk.skeletonize(verts, faces, sk.Options(guess_axis="x", soma_percentile=70.0, prune=False))
    nodes = {}
    for r in s.node.collect():
        nodes.setdefault(r["skel_id"], {})[r["node_id"]] = r
    edges = {}
    for r in s.edge.collect():
        edges.setdefault(r["skel_id"], []).append((r["u"], r["v"]))
    for i, n in nodes.items():
        # a tree over all nodes, numbered without gaps
        assert sorted(n) == list(range(len(n))) and len(edges.get(i, [])) == len(n) - 1
        assert len(set(tree.labels_of(len(n), np.array(edges[i])).tolist())) == 1 and all(u < v for u, v in edges[i])
    soma = {r["skel_id"]: r for r in s.soma.collect()}
    assert soma[2]["has_soma"] and nodes[2][0]["ntype"] == 1
    assert abs(soma[2]["center"][0] - 30) < 4 and 8 < soma[2]["axes"][0] < 24 and abs(soma[2]["center"][1]) < 0.5
    # nothing is left inside the cell body but node 0
    assert all(abs(r["x"] - soma[2]["center"][0]) > 5 for k, r in nodes[2].items() if k)
    tips = [r["x"] for r in nodes[1].values()]
    assert min(tips) < 4 and max(tips) > 55
    for k, r in nodes[1].items():
        # bins at the ends are arcs around the seed, not rings
        if 3 < r["x"] < 57 and (k or not soma[1]["has_soma"]):
            assert abs(r["y"]) < 1 and abs(r["z"]) < 1 and 1.0 < r["r_median"] < 3.5
    v = s.vert.groupBy("skel_id").agg(F.count_distinct("vert_id").alias("n"))
    assert all(r["n"] > 0 for r in v.collect())


def test_without_postprocessing_gaps_stay(built):
    (verts, faces), _ = built
    s = sk.skeletonize(verts.where("mesh_id = 3"), faces.where("mesh_id = 3"), sk.Options(guess_axis="x", postprocess=False))
    n, e = s.node.count(), [(r["u"], r["v"]) for r in s.edge.collect()]
    assert len(set(tree.labels_of(n, np.array(e)).tolist())) == 2 and s.node.where("node_id = 0").first()["ntype"] == -1
    bridged = sk.skeletonize(verts.where("mesh_id = 3"), faces.where("mesh_id = 3"), sk.Options(guess_axis="x", detect_soma=False))
    e = [(r["u"], r["v"]) for r in bridged.edge.collect()]
    assert len(set(tree.labels_of(bridged.node.count(), np.array(e)).tolist())) == 1
    assert sk.skeletonize(verts.where("false"), faces.where("false")).node.count() == 0


def test_long_clusters_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(1)
    rod = np.stack([np.linspace(0, 90, 91), rng.normal(0, 1, 91), rng.normal(0, 1, 91)], 1)
    ball = rng.normal(0, 1, (60, 3))
    rows = [(1, 0, 0, c, i + 1000 * c) for c, p in enumerate((rod, ball)) for i in range(len(p))]
    parts = spark.createDataFrame(rows, "mesh_id long, number long, shell long, cluster long, vert_id long")
    verts = spark.createDataFrame([(1, i + 1000 * c, *map(float, p)) for c, ps in enumerate((rod, ball)) for i, p in enumerate(ps)], "mesh_id long, vert_id long, x double, y double, z double")
    got = sk.split_elongated(parts, verts, sk.Options(split=True, split_min=15)).groupBy("cluster", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("vert_id").alias("a"), F.max("vert_id").alias("z")).orderBy("cluster", "slice").collect()
    rods = sorted((r["a"], r["z"], r["n"]) for r in got if r["cluster"] == 0)
    # as many slices as 15 vertices allow, in a row
    assert len(rods) == 91 // 15 and all(15 <= n <= 17 for _, _, n in rods) and rods[0][0] == 0 and rods[-1][1] == 90
    assert [(r["slice"], r["n"]) for r in got if r["cluster"] == 1] == [(0, 60)]


def test_detect_soma_swaps_root_and_anchor(spark):
    rows = [(1, i, float(3 * i), 0.0, 0.0, r, r, r, -1 if i == 0 else 2) for i, r in enumerate([1.0, 1.0, 5.0, 6.0, 5.5, 1.0, 1.0])] + [(2, i, float(i), 0.0, 0.0, 1.0, 1.0, 1.0, -1 if i == 0 else 0) for i in range(2)]
    node = spark.createDataFrame(rows, "skel_id long, node_id long, x double, y double, z double, r_median double, r_mean double, r_trim double, ntype int")
    out, mapping, soma, _ = sk.detect_soma(node, percentile=60, factor=4, min_nodes=3)
    got = {(r["skel_id"], r["node_id"]): r for r in out.collect()}
    assert got[1, 0]["x"] == 9.0 and got[1, 0]["r_mean"] == 6.0 and got[1, 0]["ntype"] == 1 and got[1, 3]["x"] == 0.0 and got[1, 3]["ntype"] == 0
    assert {(r["node_id"], r["new_id"]) for r in mapping.where("skel_id = 1 and node_id <> new_id").collect()} == {(0, 3), (3, 0)}
    body = {r["skel_id"]: r for r in soma.collect()}
    assert body[1]["has_soma"] and body[1]["axes"] == [6.0] * 3 and not body[2]["has_soma"] and body[2]["center"] == [0.0, 0.0, 0.0]
    with pytest.raises(KeyError):
        sk.detect_soma(node, radius="r_calibrated")


def test_single_node_branches_fold_into_hubs(spark):
    # a chain with a leaf at node 1, and one that becomes a leaf's parent later
    edges = [(0, 1), (1, 2), (1, 3), (3, 4), (3, 5), (0, 6)]
    node = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 1.0, 1.0, 1.0, 0) for i in range(7)], "skel_id long, node_id long, x double, y double, z double, r_median double, r_mean double, r_trim double, ntype int")
    edge = spark.createDataFrame([(1, u, v) for u, v in edges], "skel_id long, u long, v long")
    vert = spark.createDataFrame([(1, i, 10 + i) for i in range(7)], "skel_id long, node_id long, vert_id long")
    soma = spark.createDataFrame([(1, True, [0.0] * 3, [1.0] * 3, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])], "skel_id long, has_soma boolean, center array<double>, axes array<double>, rot array<array<double>>")
    s = sk.drop_single_branches(sk.Skeletons(node, edge, vert, soma), None)
    assert sorted(r["x"] for r in s.node.collect()) == [0.0, 1.0, 3.0, 6.0] and {(r["u"], r["v"]) for r in s.edge.collect()} == {(0, 1), (1, 2), (0, 3)}
    assert [{r["vert_id"] for r in s.vert.where(f"node_id = {i}").collect()} for i in (1, 2)] == [{11, 12}, {13, 14, 15}]


def test_volume_with_cell_body_and_boxes(spark):
    node = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0), (1, 1, 10.0, 0.0, 0.0, 1.0), (2, 0, 50.0, 0.0, 0.0, 1.0)], "skel_id long, node_id long, x double, y double, z double, r double")
    edge = spark.createDataFrame([(1, 0, 1)], "skel_id long, u long, v long")
    soma = spark.createDataFrame([(1, [0.0] * 3, [3.0] * 3, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])], "skel_id long, center array<double>, axes array<double>, rot array<array<double>>")
    at = lambda **k: {r["skel_id"]: r["volume"] for r in measures.volume(node, edge, "r", 0.1, **k).collect()}
    ball, rod = 4 / 3 * np.pi * 27, np.pi * 10 + 4 / 3 * np.pi
    assert at()[1] == pytest.approx(rod, rel=0.02) and at()[2] == 0.0
    whole, outside = at(somas=soma)[1], at(somas=soma, include_soma=False)[1]
    assert whole == pytest.approx(ball + outside, rel=0.02) and outside == pytest.approx(np.pi * (10 - np.sqrt(8)) + 2 / 3 * np.pi, rel=0.05)
    assert at(box=[2, 4, -5, 5, -5, 5])[1] == pytest.approx(2 * np.pi, rel=0.02)
    assert at(box=[100, 101, 0, 1, 0, 1]) == {1: 0.0, 2: 0.0}


def test_whitelists_units_and_structured_matches(spark):
    node = spark.createDataFrame([(s, i, float(10 * i), float(5 * s), 0.0, 1.0) for s in (1, 2, 3) for i in range(3)] + [(4, 0, 0.0, 40.0, 0.0, 2.0)], "skel_id long, node_id long, x double, y double, z double, r double")
    edge = spark.createDataFrame([(s, i, i + 1) for s in (1, 2, 3) for i in range(2)], "skel_id long, u long, v long")
    p = measures.checked_points([15.0, 0.0, 0.0], spark)
    d = lambda **k: {r["skel_id"]: round(r["distance"], 6) for r in measures.distances(p, node, edge, **k).collect()}
    far = float(np.hypot(15, 40))
    assert d() == {1: 5.0, 2: 10.0, 3: 15.0, 4: round(far, 6)} and d(radius="r")[4] == round(far - 2, 6)
    ids = lambda rows, s: spark.createDataFrame(rows, s)
    assert d(allowed_edges=ids([(1, 1, 0), (9, 0, 1)], "skel_id long, u long, v long")) == {1: round(float(np.hypot(5, 5)), 6)}
    assert d(allowed_nodes=ids([(1, 2), (2, 0)], "skel_id long, node_id long")) == {1: 5.0, 2: round(float(np.hypot(5, 10)), 6)}
    mm = measures.distances(measures.checked_points([[0.015, 0.0, 0.0]], spark), node, edge, unit="um", point_unit="mm").where("skel_id = 1").first()["distance"]
    assert mm == pytest.approx(0.005)
    got = measures.structured_matches(p, node, edge, 2, return_all=True).first()
    assert [(m["rank"], m["skel_id"], m["distance"]) for m in got["matches"]] == [(1, 1, 5.0), (2, 2, 10.0)] and set(got["all_distances"]) == {1, 2, 3, 4}
    assert measures.nearest_skeletons(p, node, edge, 99).count() == 4
    with pytest.raises(ValueError):
        measures.checked_points([1.0, 2.0], spark)
    with pytest.raises(ValueError):
        measures.nearest_skeletons(p, node, edge, 0)


def test_listed_hubs_are_judged_in_turn(spark):
    # two neighbouring hubs: 1 has one unlisted neighbour (0) and listed 2; 2 has three unlisted ones
    edges = [(0, 1), (1, 2), (2, 3), (2, 4), (2, 5), (1, 6)]
    node = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 0) for i in range(7)], "skel_id long, node_id long, x double, y double, z double, ntype int")
    edge = spark.createDataFrame([(1, u, v) for u, v in edges], "skel_id long, u long, v long")
    listed = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "skel_id long, node_id long")
    left = lambda *ids: sorted(int(r["x"]) for r in edit.prune(node, edge, "nodes", listed=listed(*ids))[0].collect())
    assert left(1, 2, 6) == [0, 2, 3, 4, 5] and left(2) == [0, 1, 2, 3, 4, 5, 6] and left(1, 2, 3, 4, 6) == [0, 5]
    assert left(0, 3) == [0, 1, 2, 4, 5, 6]


def test_bridging_without_lengths_ends():
    xyz = np.array([[0.0, 0, 0], [0, 0, 0], [5, 0, 0]])
    assert tree.bridge_gaps(xyz, np.array([[0, 1]])).tolist() in ([[0, 1], [0, 2]], [[0, 1], [1, 2]])


def test_bridging_against_all_pairs():
    # with a wide ceiling, islands join in the order of a minimum spanning tree over components
    rng = np.random.default_rng(3)
    for _ in range(20):
        xyz = rng.random((14, 3)) * 10
        edges = np.array([(0, 1), (2, 3), (4, 5), (5, 6), (8, 9)])
        got = tree.bridge_gaps(xyz, edges, factor=1e6)
        have = {tuple(e) for e in got.tolist()}
        label = tree.labels_of(14, edges)
        done, want = {label[0]}, {tuple(e) for e in edges.tolist()}
        while len(done) < len(set(label.tolist())):
            pairs = [(float(np.linalg.norm(xyz[i] - xyz[j])), min(i, j), max(i, j), label[j]) for i in range(14) for j in range(14) if label[i] in done and label[j] not in done]
            _, a, b, new = min(pairs)
            want.add((a, b))
            done.add(new)
        assert have == want


def chain(spark, radii, parents=None):
    rows = [(1, i, float(i), 0.0, 0.0, float(r), (parents or {}).get(i, i - 1 if i else None)) for i, r in enumerate(radii)]
    node = spark.createDataFrame(rows, "skel_id long, node_id long, x double, y double, z double, r double, parent_id long")
    edge = spark.createDataFrame([(1, min(i, p), max(i, p)) for _, i, *_, p in rows if p is not None], "skel_id long, u long, v long")
    return node, edge


def test_downsample_rules(spark):
    node, edge = chain(spark, [5.0, 1, 1, 1, 3, 3, 3, 3])

    def run(**options):
        n, e, to = resample.downsample(node, edge, "r", **options)
        return {r["node_id"]: (r["x"], r["r"]) for r in n.collect()}, {(r["u"], r["v"]) for r in e.collect()}, [r["new_id"] for r in to.orderBy("node_id").collect()]

    # the far leaf takes the run beside it, node 0 none
    assert run() == ({0: (0.0, 5.0), 1: (2.0, 1.0), 2: (5.5, 3.0)}, {(0, 1), (1, 2)}, [0, 1, 1, 1, 2, 2, 2, 2])
    assert run(merge_ends=False)[2] == [0, 1, 1, 1, 2, 2, 2, 3] and run(max_shift=0.5)[2] == [0, 1, 1, 1, 2, 2, 2, 3]
    assert run(rtol=0.9, how="mean") == ({0: (0.0, 5.0), 1: (4.0, 15 / 7)}, {(0, 1)}, [0] + [1] * 7)
    assert resample.run_numbers([1.0, 1.04, 1.09, 1.2], 0.05, 0.0) == [0, 0, 1, 2]
    for how, worth in (("median", 1.0), ("mean", 4 / 3), ("area", 2**0.5)):
        n, e = chain(spark, [9.0, 1.0, 1.0, 2.0, 9.0])
        assert abs(resample.downsample(n, e, "r", rtol=0.8, how=how, merge_ends=False)[0].where("node_id = 1").first()["r"] - worth) < 1e-9


def test_downsample_slides_branching_nodes(spark):
    # 0 - 1 - 2 - 3, where 3 branches to 4 - 5 - 6 and to 7 - 8
    node, edge = chain(spark, [1.0] * 9, {7: 3})
    n, e, to = resample.downsample(node, edge, "r")
    assert [r["new_id"] for r in to.orderBy("node_id").collect()] == [0, 1, 1, 1, 1, 1, 2, 1, 3]
    # of the runs at node 3 the one at its own neighbour 7 comes last
    at = {r["node_id"]: r["x"] for r in n.collect()}
    assert at == {0: 0.0, 1: 5.0, 2: 6.0, 3: 8.0} and {(r["u"], r["v"]) for r in e.collect()} == {(0, 1), (1, 2), (1, 3)}
    kept = resample.downsample(node, edge, "r", slide_branches=False, merge_ends=False)[2]
    assert [r["new_id"] for r in kept.orderBy("node_id").collect()] == [0, 1, 1, 2, 3, 3, 4, 5, 6]


def test_fill_labels_against_a_plain_sweep():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 20
        edges = np.array([(int(rng.integers(0, i)), i) for i in range(1, n)])
        labels = rng.choice([0, 0, 0, 2, 3, -1, 1], n)
        want = labels.copy()
        moved = True
        while moved:
            moved = False
            for i in range(n):
                around = sorted(int(want[a + b - i]) for a, b in edges.tolist() if i in (a, b) and want[a + b - i] not in (0, 1, -1))
                if want[i] == 0 and around:
                    want[i], moved = max(set(around), key=lambda v: (around.count(v), -v)), True
        assert tree.fill_labels(labels, edges).tolist() == want.tolist()
