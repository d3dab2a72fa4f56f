import numpy as np
import pytest

from dendrion.operators import projection
from dendrion.sources import store

CELL = "skel_id long, node_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 10.0, 0.0, 5.0), (1, 2, 10.0, 8.0, None), (2, 0, 3.0, 3.0, 3.0)], CELL)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "skel_id long, u long, v long")


def test_windows(nodes, edges):
    flat = projection.project(nodes, "xy", scale=2.0)
    assert {(r["px"], r["py"]) for r in flat.where("node_id = 2").collect()} == {(20.0, 16.0)}
    seen = projection.crop(flat, (0, 20), (0, 0))
    assert seen.count() == 2 and [tuple(r) for r in projection.visible_edges(seen, edges).collect()] == [(1, 0, 1)]
    assert projection.crop(flat).count() == 4
    for bad in ("xx", "x", "xw"):
        with pytest.raises(ValueError, match="plane"):
            projection.project(nodes, bad)


def test_density_counts_every_row_once(spark, nodes):
    rng = np.random.default_rng(4)
    rows = [(1, float(a), float(b)) for a, b in rng.normal(size=(500, 2))]
    got = projection.density(projection.project(spark.createDataFrame(rows, "mesh_id long, x double, y double")), (7, 4)).collect()
    want = np.histogram2d([r[1] for r in rows], [r[2] for r in rows], bins=(7, 4))[0]
    assert {(r["i"], r["j"]): r["n"] for r in got} == {(i, j): int(n) for (i, j), n in np.ndenumerate(want) if n}
    single = projection.density(projection.project(nodes, "xz"), 10, by="skel_id").where("skel_id = 2").collect()
    assert [tuple(r) for r in single] == [(2, 5, 5, 1)]
    assert projection.density(projection.project(nodes.where("false"), "xz"), 10, by="skel_id").count() == 0


def test_boxes_and_roots(spark, nodes, edges):
    verts = spark.createDataFrame([(1, i, float(i), float(-i), 1.0) for i in range(4)], "mesh_id long, vert_id long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 1, 2, 3)], "mesh_id long, face_id long, a long, b long, c long")
    boxes = projection.face_boxes(faces, verts, margin=0.5, by=("mesh_id", "face_id"))
    assert {r["face_id"]: (r["min_x"], r["max_x"], r["min_y"], r["max_y"]) for r in boxes.collect()} == {0: (-0.5, 2.5, -2.5, 0.5), 1: (0.5, 3.5, -3.5, -0.5)}
    whole = projection.box_union(boxes).first()
    assert (whole["min_x"], whole["max_x"], whole["min_z"], whole["max_z"]) == (-0.5, 3.5, 0.5, 1.5)
    left, kept = projection.without_root(nodes, edges)
    assert sorted((r["skel_id"], r["node_id"]) for r in left.collect()) == [(1, 0), (1, 1)] and [tuple(r) for r in kept.collect()] == [(1, 0, 1)]


def test_store_round_trip(spark, nodes, edges, tmp_path):
    path = str(tmp_path / "store")
    store.write_store({"node": nodes, "edge": edges}, path)
    got = store.read_store(spark, path)
    assert set(got) == {"node", "edge"}
    assert sorted(map(str, got["node"].collect())) == sorted(map(str, nodes.collect())) and got["edge"].count() == 2


def test_npz(spark, tmp_path):
    common = {"nodes": np.array([[0, 0, 0], [1, 2, 3], [4, 5, 6]], np.float32), "edges": np.array([[1, 0], [1, 2], [2, 1]]), "soma_centre": np.zeros(3), "soma_axes": np.ones(3), "soma_R": np.eye(3)}
    np.savez(tmp_path / "a.npz", **common, r_median=np.array([1.0, 2.0, 3.0]), ntype=np.array([-1, 3, 2], np.int8), node2verts_idx=np.array([7, 8, 9]), node2verts_off=np.array([0, 1, 1, 3]), soma_verts=np.array([7]), extra=np.array({"k": 1}, dtype=object))
    np.savez_compressed(tmp_path / "b.npz", **common)
    got = store.read_npz(spark, str(tmp_path))
    node = {(r["skel_id"][-5:], r["node_id"]): r for r in got["node"].collect()}
    assert len(node) == 6 and node["a.npz", 1]["radii"] == {"median": 2.0} and node["a.npz", 2]["ntype"] == 2
    assert [node["b.npz", i]["ntype"] for i in range(3)] == [-1, 0, 0] and node["b.npz", 2]["z"] == 6.0 and node["b.npz", 0]["radii"] == {}
    assert sorted((r["skel_id"][-5:], r["u"], r["v"]) for r in got["edge"].collect()) == [(f, u, u + 1) for f in ("a.npz", "b.npz") for u in (0, 1)]
    assert sorted((r["node_id"], r["vert_id"]) for r in got["node_vert"].collect()) == [(0, 7), (2, 8), (2, 9)]
    soma = {r["skel_id"][-5:]: r for r in got["soma"].collect()}
    assert soma["a.npz"]["verts"] == [7] and soma["b.npz"]["verts"] is None and soma["b.npz"]["rot"][1] == [0.0, 1.0, 0.0]


def test_all_face_boxes_hold_every_corner(spark):
    import __spark_entry__

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["all_face_boxes"]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()["all_face_boxes"](spark, sf).collect())
    assert got and [r[0] for r in got] == [r[0] for r in want]
    assert all(a == pytest.approx(b) for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True))


def test_contact_archives_and_stores(spark, tmp_path):
    from pyspark.sql import functions as F

    from dendrion.sources import store

    faces = [np.array([3, 5]), np.array([], np.int64), np.array([8])]
    ptr = lambda x: np.concatenate([[0], np.cumsum([len(v) for v in x])])
    points = [np.array([[1.0, 2, 3]]), np.zeros((0, 3)), np.array([[4.0, 5, 6], [7, 8, 9]])]
    common = dict(faces_A_data=np.concatenate(faces), faces_A_ptr=ptr(faces), faces_B_data=np.zeros(0, np.int64), faces_B_ptr=np.zeros(4, np.int64), pairs_flag=np.array(1, np.uint8), pairs_AB_data=np.concatenate(points), pairs_AB_ptr=ptr(points), area_A=np.array([1.0, 2, 3]), area_B=np.zeros(3), area_mean=np.array([0.5, 1, 1.5]), seeds_A=np.zeros((3, 3)), seeds_B=np.ones((3, 3)), bbox=np.zeros((3, 2, 3)))
    np.savez(tmp_path / "new.npz", **common, meta_json=np.array(store.encode_meta({"b": np.float64(2), "a": [1]})), stats_A_keys=np.array(["aspect"]), stats_A__aspect=np.array([1.5, np.nan, 2.5]), _schema=np.array(store.CONTACT_SCHEMA))
    np.savez(tmp_path / "old.npz", **{k: v for k, v in common.items() if k != "pairs_flag"}, meta_json=np.array('{"stats_B": {"n_faces": [1, 2, 3]}}'))
    got = store.read_contact_npz(spark, str(tmp_path))
    sites = {(r["pair_id"][-7:], r["site"]): r for r in got["contact_site"].collect()}
    assert len(sites) == 6 and sites["new.npz", 2]["stats_a"] == {"aspect": 2.5} and sites["new.npz", 1]["stats_a"] == {"aspect": None} and sites["new.npz", 0]["stats_b"] is None
    assert sites["old.npz", 1]["stats_b"] == {"n_faces": 2.0} and sites["old.npz", 0]["bbox_a"] is None and sites["old.npz", 0]["bbox"] == [0.0] * 6
    assert [(r["site"], r["face_id"]) for r in got["contact_face"].where("pair_id like '%new.npz'").orderBy("site", "pos").collect()] == [(0, 3), (0, 5), (2, 8)]
    assert got["contact_pair"].count() == 3 and {r["schema"] for r in got["meta"].collect()} == {store.CONTACT_SCHEMA, None}
    meta = got["meta"].where("schema is not null").select(store.decode_meta(F.col("meta")).alias("m")).selectExpr("try_variant_get(m, '$.b', 'double') as b").first()
    assert meta["b"] == 2.0 and spark.range(1).select(store.decode_meta(F.lit("no json")).alias("m")).selectExpr("variant_get(m, '$._raw', 'string') as r").first()["r"] == "no json"
    store.write_contact_sites({k: v for k, v in got.items() if k != "meta"}, str(tmp_path / "store"), meta={"unit": "nm"})
    back = store.read_contact_sites(spark, str(tmp_path / "store"))
    assert back["contact_site"].count() == 6 and back["meta"].first()["schema"] == store.CONTACT_SCHEMA
    seeds = spark.createDataFrame([(r, i, i % 3) for r in ("p", "q") for i in range(6)], "pair_id string, seed_id long, site long")
    mine = spark.createDataFrame([(r, i, float(i)) for r in ("p", "q") for i in range(3)], "pair_id string, site long, area_mean double")
    left, seeds, _ = store.subset_sites(mine, F.col("area_mean") >= 1, seeds)
    assert sorted((r["pair_id"], r["site"], r["area_mean"]) for r in left.collect()) == [("p", 0, 1.0), ("p", 1, 2.0), ("q", 0, 1.0), ("q", 1, 2.0)]
    assert sorted(r["site"] for r in seeds.where("pair_id = 'p'").collect()) == [-1, -1, 0, 0, 1, 1]


def test_ragged_lists_and_swc_metadata(spark, tmp_path):
    from dendrion.sources import store
    from dendrion.sources.text_formats import read_swc, swc_meta, write_swc

    rows = [("k", i, pos, v) for i, vs in enumerate([[5, 6], [7], [8, 9, 10]]) for pos, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, i long, pos long, v long")
    data, spans = store.pack_ragged(df, "key", "pos", ("v",), "i")
    assert [r["v"] for r in data.orderBy("at").collect()] == [5, 6, 7, 8, 9, 10] and [(r["start"], r["end"]) for r in spans.orderBy("i").collect()] == [(0, 2), (2, 3), (3, 6)]
    assert sorted(tuple(r) for r in store.unpack_ragged(data, spans, "key", ("v",), "i").select("key", "i", "pos", "v").collect()) == sorted(rows)
    (tmp_path / "b.swc").write_text('# id: 7\n# meta {"unit": "nm", "n": 3}\n# plain words\n1 1 0 0 0 2 -1\n2.0 3.0 1 0 0 1 1.0\nbad line\n')
    meta = swc_meta(spark, str(tmp_path / "b.swc"))
    assert meta.first()["meta"] == {"id": "7", "unit": "nm", "n": "3"}
    node, edge, _ = read_swc(spark, str(tmp_path / "b.swc"))
    assert node.count() == 2 and edge.count() == 1
    flat = lambda df, c: df.withColumn("skel_id", df[c] * 0)
    one = meta.selectExpr("0L as skel_id", "meta")
    write_swc(flat(node, "node_id"), flat(edge, "u"), str(tmp_path / "out"), meta=one)
    assert swc_meta(spark, str(tmp_path / "out")).first()["meta"]["unit"] == "nm"
