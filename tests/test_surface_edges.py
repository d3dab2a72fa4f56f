"""Places on the very edge of a surface, and far from one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrion.functions import geometry as g
from dendrion.operators import measures


@pytest.mark.parametrize(
    ("a", "b", "ra", "rb", "lo", "voxel", "inside"),
    [((72.0, 36.62, 38.0), (40.0, 13.74, 25.0), 0.75, 1.75, (-0.5, -2.01, -1.5), (6, 2, 4), True), ((14.0, 23.13, 42.0), (8.0, 54.72, 19.0), 1.25, 0.75, (-0.5, -1.78, -1.75), (1, 9, 3), False)],
)
def test_voxels_on_the_surface_are_rounded_as_in_the_sql(spark, a, b, ra, rb, lo, voxel, inside):
    nodes = spark.createDataFrame([(1, 0, *a, ra), (1, 1, *b, rb), (1, 2, *lo, 0.0)], "skel_id long, node_id long, x double, y double, z double, r double")
    edges = spark.createDataFrame([(1, 0, 1)], "skel_id long, u long, v long")
    got = {(r.i, r.j, r.k) for r in measures.occupied_voxels(nodes, edges, "r", 6.0).collect()}
    assert (voxel in got) == inside


def far_away(axes, y):
    """The distance by bisection."""
    a, y = np.array(axes, np.longdouble), np.array(y, np.longdouble)
    lo, hi = np.longdouble(0), np.sqrt((a * y * a * y).sum()) + 1
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ((a * y / (mid + a * a)) ** 2).sum() > 1 else (lo, mid)
    return float(np.linalg.norm((y - a * a * y / (lo + a * a)).astype(float)))


def test_few_steps_reach_the_surface(spark):
    cases = [((30.0, 30.0, 30.0), (3e6, 4e6, 1.0)), ((5.0, 2.0, 1.0), (900.0, 7.0, -3.0)), ((1000.0, 1.0, 1.0), (999.0, 3.0, 0.5)), ((1e4, 10.0, 0.01), (1.0, 2.0, 0.02))]
    rows = spark.createDataFrame([(i, *y, list(a)) for i, (a, y) in enumerate(cases)], "i long, x double, y double, z double, axes array<double>")
    one = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    for steps in (64, 40):
        got = dict(rows.select("i", g.ellipsoid_surface_distance(g.vector(), zero, F.col("axes"), one, steps)).collect())
        assert [got[i] for i in range(len(cases))] == pytest.approx([far_away(*c) for c in cases], rel=1e-9)
    ball = rows.where("i = 0").select(g.ellipsoid_surface_distance(g.vector(), zero, F.col("axes"), one, 1)).first()[0]
    assert ball == pytest.approx(5e6 - 30, rel=1e-12)
