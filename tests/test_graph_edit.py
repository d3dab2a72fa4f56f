"""Small hand-built graphs for walks, edits and kernels."""

import numpy as np
import pytest

from dendrion.kernels import tree
from dendrion.operators import edit, graph

# 0-1-2-3 with a side branch 2-4-5
PARENT = {0: None, 1: 0, 2: 1, 3: 2, 4: 2, 5: 4}


@pytest.fixture
def y_tree(spark):
    nodes = spark.createDataFrame([(0, i, float(i), 0.0, 0.0, p, t) for (i, p), t in zip(PARENT.items(), (-1, 3, 0, 0, 2, 2), strict=True)], "skel_id long, node_id long, x double, y double, z double, parent_id long, ntype int")
    edges = spark.createDataFrame([(0, p, i) for i, p in PARENT.items() if p is not None], "skel_id long, u long, v long")
    return nodes, edges


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_walks(y_tree):
    nodes, edges = y_tree
    assert ids(graph.leaf_depths(nodes, edges), "node_id", "depth") == [(3, 3), (5, 4)]
    assert ids(graph.twigs(nodes, edges), "leaf", "base", "length") == [(3, 2, 1), (5, 2, 2)]
    assert ids(graph.branches(nodes, edges), "top", "bottom", "length") == [(0, 2, 3), (2, 3, 2), (2, 5, 3)]
    assert ids(graph.subtree(nodes, 4), "node_id") == [(4,), (5,)]
    assert dict((r["node_id"], r["parent_id"]) for r in graph.parents_from_edges(nodes, edges).collect()) == PARENT
    with pytest.raises(ValueError):
        graph.nodes_of_degree(nodes, edges, -1)


def test_clip_and_components(y_tree):
    nodes, edges = y_tree
    n, e = edit.clip(nodes, edges, edges.where("u = 2 and v = 4"))
    assert ids(graph.components(n, e), "node_id", "component") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4)]
    n, e = edit.clip(nodes, edges, edges.where("u = 2 and v = 4"), drop_orphans=True)
    assert ids(n, "node_id") == [(0,), (1,), (2,), (3,)]


def test_edits(y_tree, spark):
    nodes, edges = y_tree
    n, e = edit.prune(nodes, edges, "twigs", num_nodes=1)
    assert n.count() == 5 and e.count() == 4
    labelled = edit.set_ntype(nodes, 4, root=4)
    assert dict(ids(labelled, "node_id", "ntype"))[5] == 4
    n, e = edit.reroot(nodes, edges, spark.createDataFrame([(0, 3)], "skel_id long, node_id long"))
    assert ids(e, "u", "v") == [(0, 2), (1, 2), (1, 3), (2, 4), (4, 5)]
    for bad in ({"kind": "twigs"}, {"kind": "leaves", "num_nodes": 1}):
        with pytest.raises(ValueError):
            edit.prune(nodes, edges, **bad)
    with pytest.raises(ValueError):
        edit.graft(edges, spark.createDataFrame([(0, 1, 1)], "skel_id long, u long, v long"))


def test_remap(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 3)], "skel_id long, u long, v long")
    mapping = spark.createDataFrame([(0, 0, 0), (0, 2, 1), (0, 3, 2)], "skel_id long, node_id long, new_id long")
    assert ids(edit.remap_edges(edges, mapping), "u", "v") == [(1, 2)]


def test_kernels():
    xyz = np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [2, 1, 0.0]])
    ring = np.array([[0, 1], [1, 2], [2, 3], [0, 3]])
    assert tree.spanning_forest(xyz, ring).tolist() == [[0, 1], [1, 2], [2, 3]]
    bridged = tree.bridge_gaps(xyz, np.array([[0, 1], [2, 3]]))
    assert len(set(tree.labels_of(4, bridged))) == 1 and [1, 2] in bridged.tolist()
    assert tree.fill_labels(np.array([-1, 2, 0, 0]), np.array([[0, 1], [1, 2], [2, 3]])).tolist() == [-1, 2, 2, 2]
    assert tree.merge_nested(np.zeros((3, 3)), np.array([3.0, 2.0, 1.0])).tolist() == [0, 1, 1]


def test_text_formats(spark, tmp_path):
    from dendrion.sources.text_formats import read_obj, read_swc, swc_meta, write_swc

    (tmp_path / "a.swc").write_text("# unit: nm\n1 1 0 0 0 2 -1\n5 3 1 0 0 1 1\n7 3 2 0 0 1 5\n")
    node, edge, soma = read_swc(spark, str(tmp_path / "a.swc"))
    assert ids(edge, "u", "v") == [(0, 1), (1, 2)] and soma.first()["axes"] == [2.0, 2.0, 2.0]
    assert swc_meta(spark, str(tmp_path / "a.swc")).first()["meta"] == {"unit": "nm"}
    flat = node.withColumn("skel_id", node["node_id"] * 0)
    write_swc(flat, edge.withColumn("skel_id", edge["u"] * 0), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "skel_id=0").glob("part-*"))
    assert [line.split()[-1] for line in text.splitlines()] == ["parent", "-1", "1", "2"] and text.startswith("# ")
    (tmp_path / "q.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1/1 2 3 4\n")
    verts, faces = read_obj(spark, str(tmp_path / "q.obj"))
    assert verts.count() == 4 and ids(faces, "a", "b", "c") == [(0, 1, 2), (0, 2, 3)]
