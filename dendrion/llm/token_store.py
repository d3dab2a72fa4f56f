"""Token ids in a compressed store with short-document access.

Each document's ids, as little-endian unsigned 32-bit integers, are one zstandard frame of its own.
All frames share a dictionary trained on serialized id arrays, because short documents alone hold
too little to compress.  Frames are packed in ascending document order, or in one that is given:

    store/packs        one row per pack: range, pack, first_id, last_id, dictionary (its SHA-256),
                       offsets (array, frames + 1 entries, bytes within the payload),
                       doc_ids, counts (tokens of each document), payload (the frames)
    store/starts       one row per range: tokens and documents before it
    store/dictionary   one row: sha256, dictionary

A reader of one document needs the packs whose id range holds it (Parquet statistics prune the
rest; in another order than the ids' there are more of them), one slice of the payload and the dictionary.  Packs are written by Spark's committer, so a
lost executor leaves no partial pack behind.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, named, new_scratch, partitions
from .tokenizer import tokenizer

#: Documents and serialized bytes the dictionary is trained on at most: those with the smallest hashes.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY_BYTES = 400, 2 << 20, 64 << 10
#: Compressed bytes after which a pack is closed.
PACK_BYTES = 1 << 20
LEVEL = 1
#: Bytes of text that a range of the store holds at most, about; the session's shuffle partitions are the least number of ranges.
RANGE_BYTES = 128 << 20
_PACK = pa.schema([("range", pa.int32()), ("pack", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary", pa.string()), ("offsets", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
_PACK_SQL = "range int, pack int, first_id long, last_id long, dictionary string, offsets array<long>, doc_ids array<long>, counts array<long>, payload binary"


def _train(sample: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """A dictionary from the sampled texts; empty where they are too few for one, and then frames have none."""
    tok, end = tokenizer(tokenizer_path, "ids"), np.array([end_id], "<u4").tobytes()
    samples, total = [], 0
    for (text,) in sample.collect():
        samples.append(tok.ids(text or "") + end)
        total += len(samples[-1])
    if len(samples) < 8 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@functools.lru_cache(maxsize=4)
def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True), zstandard.ZstdDecompressor(dict_data=d)


def _pack(tokenizer_path: str, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, name = tokenizer(tokenizer_path, "ids"), np.array([end_id], "<u4").tobytes(), hashlib.sha256(dictionary).hexdigest()
        compress, part, pack = _codec(dictionary)[0].compress, TaskContext.get().partitionId(), 0
        frames, ids, counts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            known = [i for i in ids if i is not None]
            row = [part, pack, min(known, default=None), max(known, default=None), name, ends.tolist(), ids, counts, b"".join(frames)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _PACK, strict=True)], schema=_PACK)

        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = tok.ids(text or "") + end
                frames.append(compress(raw))
                ids.append(i)
                counts.append(len(raw) // 4)
                held += len(frames[-1])
                if held >= PACK_BYTES or len(frames) >= 4096:
                    yield close()
                    frames, ids, counts, held, pack = [], [], [], 0, pack + 1
        if frames:
            yield close()

    return run


def write_store(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, ...] = ()) -> None:
    """Encode every document, append ``end_id``, and write the store in ascending order of the columns ``order``, then of the id, nulls first.

    Null texts are empty: the end id alone.  Rows that are equal in all of these stand in the order of a hash of
    their text; equal rows are interchangeable.  Other columns are ignored.
    """
    spark = docs.sparkSession
    by = [f"by_{i}" for i in range(len(order))]
    rows = named(docs, id=id_col, text=text_col, **dict(zip(by, order, strict=True))).select(F.col("id").cast("long").alias("id"), "text", *by)
    mixed = F.xxhash64("id", "text")
    budget = TRAIN_BYTES // TRAIN_DOCS
    # whole short texts: what is short gains most from the dictionary.  A threshold on the hash passes
    # a few times as many as are needed, however many tasks look for them
    short = rows.where(F.octet_length("text") <= budget).select("text", mixed.alias("h"))
    n, held = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, 8 * TRAIN_DOCS / max(1, n))
    sample = short.where(F.col("h") <= F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64)))).orderBy("h", "text").limit(TRAIN_DOCS).select("text")
    dictionary = _train(sample, tokenizer_path, end_id)
    # literals: rows given as a list would start Python workers of another kind, which stay beside those of the corpus
    spark.range(0, 1, 1, 1).select(F.lit(hashlib.sha256(dictionary).hexdigest()).alias("sha256"), F.lit(bytearray(dictionary)).alias("dictionary")).write.parquet(f"{path}/dictionary")
    keys = [*(F.col(c).asc_nulls_first() for c in (*by, "id")), F.col("h").asc()]
    ranged = rows.withColumn("h", mixed).repartitionByRange(max(partitions(spark), -(-held // RANGE_BYTES)), *keys).sortWithinPartitions(*keys).select("id", "text")
    mapped(ranged, _pack(tokenizer_path, end_id, dictionary), _PACK_SQL).write.parquet(f"{path}/packs")
    packs = spark.read.schema(_PACK_SQL).parquet(f"{path}/packs")
    # one row per range, so the window is as small as the number of partitions
    sums = packs.groupBy("range").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), F.sum(F.size("doc_ids").cast("long")).alias("docs"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("range", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("docs").over(w), F.lit(0)).alias("docs_before")).write.parquet(f"{path}/starts")


def _load_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary of {path} is damaged")
    return dictionary


def _unpack(dictionary: bytes, with_ids: bool):
    name = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _codec(dictionary)[1].decompress
        for b in batches:
            for p in b.to_pylist():
                if p["dictionary"] != name:
                    raise ValueError(f"pack {p['range']}/{p['pack']} was written with dictionary {p['dictionary']}")
                raw = [decompress(p["payload"][a:z]) for a, z in zip(p["offsets"], p["offsets"][1:], strict=False)]
                places = np.arange(len(raw)) + p["rows_before"]
                starts = p["tokens_before"] + np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])[:-1]])
                out = [pa.array(p["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                out.append(pa.array(places, pa.int64()))
                names = ["id", "start", "n_tokens", "ids_crc32", "place"]
                yield pa.record_batch([*out, pa.array(raw, pa.binary())] if with_ids else out, names=[*names, "ids"] if with_ids else names)

    return run


def read_store(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids_crc32, place`` and, unless left out, ``ids`` (binary) of every document, decoded from its frames; places count the documents in the store's order from 0."""
    dictionary = _load_dictionary(spark, path)
    packs = spark.read.schema(_PACK_SQL).parquet(f"{path}/packs")
    starts = spark.read.schema("range int, tokens_before long, docs_before long").parquet(f"{path}/starts")
    before = Window.partitionBy("range").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    # payloads stay out of the window: only a row of numbers per pack is sorted
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = packs.select("range", "pack", tokens.alias("t"), F.size("doc_ids").cast("long").alias("d")).withColumns({"t_in": so_far("t"), "d_in": so_far("d")}).join(starts, "range")
    offsets = offsets.select("range", "pack", (F.col("t_in") + F.col("tokens_before")).alias("tokens_before"), (F.col("d_in") + F.col("docs_before")).alias("rows_before"))
    placed = packs.join(offsets, ["range", "pack"])
    return mapped(placed, _unpack(dictionary, with_ids), "id long, start long, n_tokens long, ids_crc32 long, place long" + ", ids binary" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row that had this id), from one slice of its pack."""
    dictionary = _load_dictionary(spark, path)
    packs = spark.read.schema(_PACK_SQL).parquet(f"{path}/packs").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.explode(F.filter(F.transform("doc_ids", lambda d, i: F.when(d == doc_id, i)), lambda i: i.isNotNull())).alias("i")
    frame = F.expr("substring(payload, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))")
    rows = packs.select("range", "pack", "payload", "offsets", at).select("range", "pack", "i", frame.alias("frame")).orderBy("range", "pack", "i").collect()
    return [np.frombuffer(_codec(dictionary)[1].decompress(bytes(r["frame"])), "<u4") for r in rows]


def round_trip(docs: DataFrame, *, with_ids: bool = False, **options) -> DataFrame:
    """Write the store to the shared scratch folder and read it back; what is returned is decoded from the files."""
    path = new_scratch(docs.sparkSession, "token-store")
    write_store(docs, path, **options)
    return read_store(docs.sparkSession, path, with_ids=with_ids)
