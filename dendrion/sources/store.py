"""A store of relations as Parquet tables, and import of skeletons from NPZ archives.

A store is a folder with one table per relation (node, edge, node_vert, soma; contact_site,
contact_face, contact_pair) and a table ``about`` with the version of the layout.  Archives are
read through Spark's binary source, so they can lie in any store, one archive at a time in a worker.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
_NODE = "skel_id string, node_id long, x double, y double, z double, ntype int, radii map<string,double>"
_EDGE = "skel_id string, u long, v long"
_NODE_VERT = "skel_id string, node_id long, vert_id long"
_SOMA = "skel_id string, center array<double>, axes array<double>, rot array<array<double>>, verts array<long>"


def write_store(relations: dict[str, DataFrame], path: str, *, compression: str = "zstd") -> None:
    """Writes each relation as a table of its own; ``about`` comes last and marks a whole store."""
    if "about" in relations:
        raise ValueError("about is the store's own table")
    for name, df in relations.items():
        df.write.option("compression", compression).parquet(f"{path}/{name}")
    spark = next(iter(relations.values())).sparkSession
    spark.createDataFrame([(VERSION, n) for n in relations], "version int, relation string").coalesce(1).write.parquet(f"{path}/about")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of a store by name; tables whose parts differ in columns have all of them, null where missing."""
    about = spark.read.schema("version int, relation string").parquet(f"{path}/about").collect()
    if any(r["version"] > VERSION for r in about):
        raise ValueError(f"{path} was written by a later version")
    return {r["relation"]: spark.read.option("mergeSchema", "true").parquet(f"{path}/{r['relation']}") for r in about}


def _owned(idx: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def _plain(z, name: str, default=None):
    """A member of an archive; pickled members are never loaded."""
    return z[name] if name in z.files else default


def _nodes(z, name: str) -> pd.DataFrame:
    xyz = np.asarray(z["nodes"], float)
    root = np.where(np.arange(len(xyz)) == 0, -1, 0)
    table = pd.DataFrame({"skel_id": name, "node_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "ntype": np.asarray(_plain(z, "ntype", root), np.int32)})
    # one array for each radius estimate, its name after the prefix
    estimates = pd.DataFrame({member.removeprefix("r_"): np.asarray(z[member], float) for member in z.files if member.startswith("r_")}, index=table.index)
    table["radii"] = estimates.to_dict("records") if len(estimates.columns) else [{}] * len(table)
    return table


def _edges(z, name: str) -> pd.DataFrame:
    e = np.sort(z["edges"].astype(np.int64).reshape(-1, 2), axis=1)
    return pd.DataFrame({"skel_id": name, "u": e[:, 0], "v": e[:, 1]}).drop_duplicates()


def _node_verts(z, name: str) -> pd.DataFrame:
    idx, off = (_plain(z, f"node2verts_{n}", np.zeros(0)).astype(np.int64) for n in ("idx", "off"))
    return pd.DataFrame({"skel_id": name, "node_id": _owned(idx, off) if len(off) else idx, "vert_id": idx})


def _somas(z, name: str) -> pd.DataFrame:
    lists = {k: [z[n].astype(np.float64).tolist()] for k, n in (("center", "soma_centre"), ("axes", "soma_axes"), ("rot", "soma_R"))}
    verts = _plain(z, "soma_verts")
    return pd.DataFrame({"skel_id": [name], **lists, "verts": [None if verts is None else verts.astype(np.int64).tolist()]})


def _archive(part):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    rows = part(z, name)
                    if len(rows):
                        yield rows

    return run


def read_npz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``node``, ``edge``, ``node_vert`` and ``soma`` of all NPZ archives at a path; the file is the skeleton's name.

    Missing types are unknown but for the root's; missing memberships and cell body vertices are
    none.  Pickled members (metadata, caches) are left out, for loading them would run foreign code.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    parts = {"node": (_nodes, _NODE), "edge": (_edges, _EDGE), "node_vert": (_node_verts, _NODE_VERT), "soma": (_somas, _SOMA)}
    return {k: files.mapInPandas(_archive(f), schema) for k, (f, schema) in parts.items()}


#: The tag of archives of contact sites (fixed value).
CONTACT_SCHEMA = "ContactSitesResult@2"
_SITE = "pair_id string, site long, area_a double, area_b double, area_mean double, seed_a array<double>, seed_b array<double>, bbox_a array<double>, bbox_b array<double>, bbox array<double>, stats_a map<string,double>, stats_b map<string,double>, stats_pair map<string,double>"
_FACE = "pair_id string, side string, site long, pos long, face_id long"
_POINT = "pair_id string, site long, pos long, x double, y double, z double"
_META = "pair_id string, schema string, meta string"


def pack_ragged(rows: DataFrame, by: str, pos: str, values: tuple[str, ...], order: str) -> tuple[DataFrame, DataFrame]:
    """``by, at, values..`` in one run for each ``by`` and ``by, order, start, end``: where each list of the run begins and ends."""
    sizes = rows.groupBy(by, order).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = sizes.withColumn("end", F.sum("n").over(w)).select(by, order, (F.col("end") - F.col("n")).alias("start"), "end")
    data = rows.join(spans, [by, order]).select(by, (F.col("start") + F.col(pos)).alias("at"), *values)
    return data, spans


def unpack_ragged(data: DataFrame, spans: DataFrame, by: str, values: tuple[str, ...], order: str) -> DataFrame:
    """``by, order, pos, values..``: the lists of a run that ``pack_ragged`` made."""
    at = data.join(spans, by).where("at >= start and at < end")
    return at.select(by, order, (F.col("at") - F.col("start")).alias("pos"), *values)


def encode_meta(meta: dict) -> str:
    """JSON with sorted keys; numbers and arrays of NumPy as plain ones, anything else as text."""
    return json.dumps(meta, sort_keys=True, default=lambda o: o.item() if isinstance(o, np.generic) else o.tolist() if isinstance(o, np.ndarray) else str(o))


def decode_meta(meta: Column) -> Column:
    """A variant of JSON text; what is no JSON stands under ``_raw``."""
    return F.coalesce(F.try_parse_json(meta), F.parse_json(F.to_json(F.struct(meta.alias("_raw")))))


def _lists(z, data: str, ptr: str) -> list[np.ndarray]:
    return np.split(z[data], z[ptr][1:-1]) if len(z[ptr]) > 1 else []


def _statistics(z, group: str, n: int) -> list[dict | None]:
    """Each site's statistics of a group, from members of their own, else from the metadata."""
    if f"{group}_keys" in z.files:
        arrays = {str(k): z[f"{group}__{k}"] for k in z[f"{group}_keys"] if f"{group}__{k}" in z.files}
    else:
        arrays = _meta(z).get(group) or {}
    return [{k: None if np.isnan(v[i]) else float(v[i]) for k, v in arrays.items()} or None for i in range(n)]


def _meta(z) -> dict:
    try:
        found = json.loads(str(z["meta_json"].item())) if "meta_json" in z.files else {}
    except ValueError:
        found = {"_raw": str(z["meta_json"].item())}
    return found if isinstance(found, dict) else {"_raw": found}


def _sites(z, name: str) -> pd.DataFrame:
    n = len(z["area_mean"])
    rows = lambda m: [r.ravel().tolist() for r in z[m]] if m in z.files and len(z[m]) == n else [None] * n
    areas = {f"area_{k}": z[m].astype(float) for k, m in (("a", "area_A"), ("b", "area_B"), ("mean", "area_mean"))}
    lists = {c: rows(m) for c, m in (("seed_a", "seeds_A"), ("seed_b", "seeds_B"), ("bbox_a", "bbox_A"), ("bbox_b", "bbox_B"), ("bbox", "bbox"))}
    return pd.DataFrame({"pair_id": name, "site": np.arange(n), **areas, **lists, **{c: _statistics(z, m, n) for c, m in (("stats_a", "stats_A"), ("stats_b", "stats_B"), ("stats_pair", "stats_pair"))}})


def _site_faces(z, name: str) -> pd.DataFrame:
    parts = [pd.DataFrame({"pair_id": name, "side": side, "site": i, "pos": np.arange(len(f)), "face_id": f.astype(np.int64)}) for side, m in (("a", "faces_A"), ("b", "faces_B")) for i, f in enumerate(_lists(z, f"{m}_data", f"{m}_ptr"))]
    return pd.concat(parts) if parts else pd.DataFrame({"pair_id": [], "side": [], "site": [], "pos": [], "face_id": []})


def _site_points(z, name: str) -> pd.DataFrame:
    lists = _lists(z, "pairs_AB_data", "pairs_AB_ptr") if "pairs_flag" in z.files and int(z["pairs_flag"]) == 1 else []
    parts = [pd.DataFrame({"pair_id": name, "site": i, "pos": np.arange(len(p)), **{c: p[:, k] for k, c in enumerate("xyz")}}) for i, p in enumerate(lists)]
    return pd.concat(parts) if parts else pd.DataFrame({"pair_id": [], "site": [], "pos": [], "x": [], "y": [], "z": []})


def read_contact_npz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``contact_site``, ``contact_face``, ``contact_pair`` and ``meta`` of all archives of contact sites at a path.

    The file is the pair's name.  Boxes and statistics that an archive lacks are null; statistics may
    also stand in the metadata.  Faces and points are rows, numbered within their site.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    about = lambda z, name: pd.DataFrame({"pair_id": [name], "schema": [str(z["_schema"].item()) if "_schema" in z.files else None], "meta": [encode_meta(_meta(z))]})
    parts = {"contact_site": (_sites, _SITE), "contact_face": (_site_faces, _FACE), "contact_pair": (_site_points, _POINT), "meta": (about, _META)}
    return {k: files.mapInPandas(_archive(f), schema) for k, (f, schema) in parts.items()}


def write_contact_sites(relations: dict[str, DataFrame], path: str, *, meta: dict | None = None) -> None:
    """Contact sites (``contact_site``, ``contact_face``, ``contact_pair``) as a store whose ``meta`` names the schema."""
    spark = next(iter(relations.values())).sparkSession
    about = spark.createDataFrame([(None, CONTACT_SCHEMA, encode_meta(meta or {}))], _META)
    write_store({**relations, **({} if "meta" in relations else {"meta": about})}, path)


def read_contact_sites(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of a store of contact sites; columns that older parts lack are null."""
    relations = read_store(spark, path)
    tags = {r["schema"] for r in relations["meta"].select("schema").collect()} if "meta" in relations else set()
    if tags - {CONTACT_SCHEMA, None}:
        raise ValueError(f"{path} holds {sorted(tags - {None})}, not {CONTACT_SCHEMA}")
    return relations


def subset_sites(sites: DataFrame, keep: Column, seeds: DataFrame, faces: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sites for which ``keep`` holds, numbered densely per pair, with their seeds (site -1 where it went) and faces."""
    left = sites.where(keep)
    ids = left.select("pair_id", "site", (F.row_number().over(Window.partitionBy("pair_id").orderBy("site")) - 1).cast("long").alias("new_site"))
    renamed = lambda df, how: df.join(ids, ["pair_id", "site"], how).drop("site").withColumn("site", F.coalesce("new_site", F.lit(-1).cast("long"))).drop("new_site")
    return renamed(left, "inner"), renamed(seeds, "left"), None if faces is None else renamed(faces, "inner")
