"""Token counts through a digest cache.

The cache is a table ``(content, tokenizer, n_tokens)`` keyed by the digest of the content and of
the tokenizer file.  A run joins its documents' digests to the cache, encodes each distinct missing
content once, appends those counts to the cache, and then reads all counts from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, new_scratch, written
from .tokenizer import tokenizer, version

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: A content is hot with more than this share of all rows; see exact_dedup.
HOT_PARTS = 1000


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; an absent one is created empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(path, "count").count
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([count(x) for x in b.column(1).to_pylist()], pa.int64())], names=["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, tokenizer_path: str, limit: int = 1024, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None) -> DataFrame:
    """One row per document: ``id, n_bytes, n_tokens, over_limit``.

    Null texts count as empty: no bytes, no tokens.  ``normalise`` is the content to be counted;
    by default the text as it is, because this vocabulary tells any two texts apart.  Repeated rows
    and texts cost one encoding; null ids and extra columns don't matter; an empty table gives an
    empty result.  Without ``cache_path`` the cache lives and ends with the session.
    """
    spark = docs.sparkSession
    tok = version(tokenizer_path)
    cache_path = cache_path or new_scratch(spark, "token-cache")
    rows = named(docs, id=id_col, text=text_col)
    text = F.coalesce(F.col("text") if normalise is None else normalise, F.lit(""))
    rows = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text")).withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
    cached = open_cache(spark, cache_path).where(F.col("tokenizer") == tok).select("content")
    misses = rows.select("content", "text").distinct()
    if not cached.isEmpty():
        misses = misses.join(cached, "content", "left_anti")
    encoded = misses.mapInArrow(_encode(tokenizer_path), "content string, n_tokens long")
    encoded.select("content", F.lit(tok).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = open_cache(spark, cache_path).where(F.col("tokenizer") == tok).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # a content that a large part of all rows repeats: fewer than HOT_PARTS of them by counting, so they are broadcast and their rows stay put
    keyed = written(rows.select("id", "n_bytes", "content"), "token-rows")
    n = keyed.count()
    hot = keyed.groupBy("content").count().where(F.col("count") > max(100, n // HOT_PARTS)).select("content")
    hot_counts = written(counts.join(hot, "content", "left_semi").select("content", F.col("n_tokens").alias("hot_tokens")), "token-hot")
    marked = keyed.join(F.broadcast(hot_counts), "content", "left")
    done = marked.where("hot_tokens is not null").select("id", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
    rest = marked.where("hot_tokens is null").select("id", "n_bytes", "content").join(counts, "content").select("id", "n_bytes", "n_tokens")
    return done.unionByName(rest).withColumn("over_limit", F.col("n_tokens") > limit)
