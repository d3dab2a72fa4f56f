"""Closed-form cases for measures, distances and volumes."""

import math

import pytest
from pyspark.sql import functions as F

from dendrion.functions import geometry as g
from dendrion.operators import measures

NODE = "skel_id long, node_id long, x double, y double, z double, r double"
EDGE = "skel_id long, u long, v long"


def skeleton(spark, points, edges, r=1.0):
    radii = r if isinstance(r, list) else [r] * len(points)
    return spark.createDataFrame([(0, i, *map(float, p), float(q)) for i, (p, q) in enumerate(zip(points, radii, strict=True))], NODE), spark.createDataFrame([(0, *e) for e in edges], EDGE)


def length(spark, points, edges, box=None):
    return measures.path_length(*skeleton(spark, points, edges), box).first()


def test_length_and_clipping(spark):
    line = [(0, 0, 0), (10, 0, 0)], [(0, 1)]
    assert length(spark, *line)["length"] == 10
    assert length(spark, *line, [2, 8, -1, 1, -1, 1])["length"] == pytest.approx(6)
    assert length(spark, *line, [20, 30, -1, 1, -1, 1])["length"] == 0
    bent = [(0, 0, 0), (3, 4, 0), (3, 4, 12), (-1, 4, 12)], [(0, 1), (1, 2), (2, 3)]
    got = length(spark, *bent, [2, 3.5, 3, 5, 0, 10])
    assert got["length"] == pytest.approx(11.25) and got["n_edges"] == 2
    assert length(spark, [(0, 0, 0), (1, 0, 0)], [(0, 1)], [0, 1, 0, 1, 0, 1])["length"] == pytest.approx(1)


def test_bad_boxes_and_units():
    for box in ([0, 0, 0, 1, 1], [1, 0, 0, 1, 0, 1]):
        with pytest.raises(ValueError):
            g.parse_box(box)
    assert g.parse_box(((0, 1, 2), (3, 4, 5))) == ((0, 1, 2), (3, 4, 5))
    assert g.unit_factor("nm", "um") == pytest.approx(1e-3)
    with pytest.raises(ValueError):
        g.unit_factor("nm", "parsec")


def test_nearest_skeletons(spark):
    rows = [(s, i, x0 + 10.0 * i, 0.0, 0.0, 1.0) for s, x0 in ((0, 0.0), (1, 100.0), (2, -80.0)) for i in (0, 1)]
    nodes = spark.createDataFrame(rows, NODE)
    edges = spark.createDataFrame([(s, 0, 1) for s in range(3)], EDGE)
    point = spark.createDataFrame([(7, 102.5, 0.0, 0.0)], "point_id long, x double, y double, z double")
    got = measures.nearest_skeletons(point, nodes, edges, 10).orderBy("rank").collect()
    assert [r["skel_id"] for r in got] == [1, 0, 2]
    assert measures.distances(point, nodes, edges, radius="r").where("skel_id = 1").first()["distance"] == 0


@pytest.mark.parametrize(("r0", "r1", "tol"), [(1.0, 1.0, 0.03), (1.5, 0.5, 0.03)])
def test_capsule_volume(spark, r0, r1, tol):
    n, e = skeleton(spark, [(0, 0, 0), (10, 0, 0)], [(0, 1)], [r0, r1])
    want = math.pi * 10 * (r0 * r0 + r0 * r1 + r1 * r1) / 3 + 2 * math.pi * (r0**3 + r1**3) / 3
    assert measures.volume(n, e, "r", 0.15).first()["volume"] == pytest.approx(want, rel=tol)


def test_ellipsoid_distance(spark):
    import numpy as np

    axes = (3.0, 2.0, 1.0)
    rng = np.random.default_rng(0)
    points = rng.normal(size=(20, 3)) * 4
    u, v = np.meshgrid(np.linspace(0, math.pi, 400), np.linspace(0, 2 * math.pi, 400))
    surface = np.stack([3 * np.sin(u) * np.cos(v), 2 * np.sin(u) * np.sin(v), np.cos(u)], -1).reshape(-1, 3)
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
    arr = lambda v: F.array(*(F.lit(x) for x in v))
    rot = F.array(*(arr([float(i == j) for j in range(3)]) for i in range(3)))
    got = [r[0] for r in df.select(g.ellipsoid_surface_distance(g.vector(), arr((0.0, 0.0, 0.0)), arr(axes), rot)).collect()]
    for p, d in zip(points, got, strict=True):
        if (p[0] / 3) ** 2 + (p[1] / 2) ** 2 + p[2] ** 2 > 1:
            assert d == pytest.approx(np.linalg.norm(surface - p, axis=1).min(), abs=0.02)
        else:
            assert d <= 0
