"""Exact deduplication by skew-safe combining, on DataFrame functions alone.

Three combining stages, each of which compares the full content, because the content itself is
part of the grouping key beside its digest:

1. *local* - Spark's partial aggregation folds the copies within each input partition;
2. *salted* - what is left of a group is merged in ``salts`` pieces, dealt by a hash of the id, so
   that no task receives a whole hot group;
3. *global* - at most ``salts`` winners of each content meet in one task.

Every row then learns its group's winner by its digest.  That is exact: the combining compared
whole contents, so a digest that stands for two of them shows there, and rows with such a digest
are joined by their content.  Groups that hold more than 1/``HOT_PARTS`` of all rows are fewer than
``HOT_PARTS`` by counting, so their winners are broadcast and their rows are never shuffled; the
other groups are small and join by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, named, written

#: A group is hot with more than this share of all rows; there can't be more hot groups than parts.
HOT_PARTS = 1000


def combine(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, salts: int = 16, digest: Column | None = None) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Of equal normalised texts the row with the largest id stays.  Null texts count as empty and so
    form one group with the empty ones.  Null ids rank below all others; a group of null ids alone
    keeps ``keep_id`` null and all its rows.  Repeated rows with the same id and text are one
    winner: each of them is marked kept, as the id can't tell them apart.  An empty table gives an
    empty result; other columns of ``docs`` are ignored.  ``digest`` of the column ``content`` is its
    SHA-256 unless another is given.
    """
    rows = named(docs, id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = fold_ascii(text) if normalise is None else normalise
    rows = rows.select("id", content.alias("content")).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256) if digest is None else digest)
    salted = rows.groupBy("digest", "content", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # contents are compared; what goes on is their digest, and how many contents have it
    winners = winners.select("digest", "keep_id", "group_size")
    winners = written(winners, "exact-winners")
    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    shared = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    clash = not shared.isEmpty()
    plain = winners.join(shared, "digest", "left_anti") if clash else winners
    hot = F.col("group_size") > max(100, total // HOT_PARTS)
    keyed = rows.select("id", "digest")
    hot_winners = plain.where(hot).select("digest", F.lit(True).alias("is_hot"), "keep_id", "group_size")
    marked = keyed.join(F.broadcast(hot_winners), "digest", "left")
    done = marked.where("is_hot").select("id", "digest", "keep_id", "group_size")
    rest = marked.where("is_hot is null").select("id", "digest").join(plain.where(~hot).select("digest", "keep_id", "group_size"), "digest").select("id", "digest", "keep_id", "group_size")
    out = done.unionByName(rest)
    if clash:
        those = rows.join(shared, "digest", "left_semi")
        by_content = those.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(those.join(by_content, ["digest", "content"]).select("id", "digest", "keep_id", "group_size"))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
