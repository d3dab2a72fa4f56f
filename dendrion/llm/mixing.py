"""Mixing sources to target weights along a time-varying curriculum, on DataFrame functions alone.

*How much.*  Sources share a budget of words by weight; no source gives more than ``max_repeat``
times what it has, and what one can't give is shared again among the others (water filling).

*Which and when.*  Within a source, documents stand in a fixed pseudo-random order, laid end to
end on a line of words.  The source's demand over training time t in [0, 1] is the integral of its
weight schedule, scaled to its target.  A document at words [c, c + size) is taken wherever the
demand crosses it: once per pass over the source, cut at the target.  Inverting the cumulative
demand at the middle of each taken stretch gives its training position, and the result is
range-sorted by position.

The running sums are exact and distributed: rows are dealt into buckets of bounded size by a hash
of their order, buckets are summed, and only the bucket sums meet in a window per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, partitions, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows that one bucket of the running sums holds on average.
BUCKET_ROWS = 4096
#: Rows that a range of the training sequence holds at most, about.
RANGE_ROWS = 2_000_000
#: The columns whose ascending order is the training order.
ORDER = ("position", "order_key", "pass_no")


def word_count(text: Column) -> Column:
    """The number of maximal runs of characters other than U+0020 and U+0009-U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column) -> Column:
    """The fixed pseudo-random order of documents: the first 60 bits of an MD5 digest of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """``source, source_size, rank, target`` from ``source, source_size``.

    Ranks follow the code points of the source, null last.  With caps c = max_repeat * size and
    weights w, the final targets are min(c, level * w) for the one level that spends the budget;
    sources fill up in the order of c / w, so two running sums over that order give the level in
    closed form and no loop is needed.  Sources may be many (one per host): the sums are distributed.
    """
    spent = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(budget)
    ranked = running(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"rank": "one"}).drop("one")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("fill", F.col("cap") / F.col("w"))
    filled = running(ranked, [F.col("fill"), F.col("rank")], {"cap_before": "cap", "w_before": "w"})
    w_all = filled.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    level_here = (F.lit(spent) - F.col("cap_before")) / (F.lit(w_all) - F.col("w_before"))
    # the first source in filling order whose cap is above its share at the level fixes the level
    fixed = filled.withColumn("level", level_here).where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("fill", "rank", "level")).alias("at")).first()["at"]
    target = F.col("cap") if fixed is None else F.least(F.col("cap"), F.lit(fixed["level"]) * F.col("w"))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds running sums of the rows before this one, ``{new: column}``, over all rows in one order, which must tell any two apart.

    Rows are dealt out in ranges of the order; only one row of totals for each range meets the others.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "mix-ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    # one row for each range
    totals = totals.select("_part", *(before(f"_s{i}", Window.orderBy("_part")).alias(f"_b{i}") for i in range(len(sums))))
    inside = Window.partitionBy("_part").orderBy(*keys)
    out = dealt.join(F.broadcast(totals), "_part").withColumns({new: F.col(f"_b{i}") + before(c, inside) for i, (new, c) in enumerate(sums.items())})
    return out.drop("_part", *keys, *(f"_b{i}" for i in range(len(sums))))


def _position(demand: Column, target: Column, start: Column, end: Column) -> Column:
    """The t in [0, 1] at which a demand with a weight going linearly from start to end reaches ``demand``.

    D(t) = target * (2 start t + (end - start) t^2) / (start + end), solved for t in the form that
    stays exact for equal weights.
    """
    y = F.when(target > 0, F.least(F.lit(1.0), demand / target)).otherwise(F.lit(0.0)) * (start + end)
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + (end - start) * y))
    return F.when(start + root > 0, y / (start + root)).otherwise(F.lit(0.0))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_repeat: float = 2.0, schedule: tuple[tuple[float, float], ...] = ((1.0, 1.0), (1.0, 3.0), (3.0, 1.0)), keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, taken, word_start, order_key`` and others for
    ``schedule_mix``; the columns in ``keep`` come as ``keep_<name>``.

    ``schedule`` gives each source's weight at the start and at the end of training, by rank,
    repeating; it moves documents in time and leaves the targets alone.  A null source is a source
    of its own, null and empty texts have size 0 and are never taken, null ids are ordered by the
    hash of the text alone.  Repeated rows are documents of their own; their order among each other
    is immaterial.  An empty table gives an empty result.

    The document at which a source's target is reached is cut there or, with ``whole``, taken whole
    or left, whichever is nearer to the target.
    """
    rows = named(docs, id=id_col, text=text_col, source=source_col, **{f"keep_{c}": c for c in keep})
    rows = rows.select("id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("id"), F.col("text")).alias("order_key"), *(f"keep_{c}" for c in keep))
    # the sums need no kept columns; with some (whole texts perhaps), counting words again is cheaper than writing them twice
    slim = written(rows.select("id", "source", "size", "order_key"), "mix-sizes")
    rows = rows if keep else slim
    n = slim.count()
    buckets = max(16, n // BUCKET_ROWS + 1)
    # buckets of equal width in the order of the key: sums over lower buckets come before this row
    bucket = F.floor(F.col("order_key").cast("double") / F.lit(2.0**60) * buckets).cast("long")
    bucket = F.least(bucket, F.lit(buckets - 1).cast("long"))
    # null-safe equality would hash other columns than the window below and so move whole texts once more
    source_key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    rows = rows.withColumns({"bucket": bucket, "source_key": source_key})
    sums = written(slim.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = water_fill(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights=weights, budget=budget, max_repeat=max_repeat)
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "bucket", before.alias("bucket_start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(F.coalesce(F.concat(F.lit("s"), starts["source"]), F.lit("")).alias("source_key"), "bucket", "bucket_start", "source_size", "target", "rank")
    joined = rows.join(starts, ["source_key", "bucket"])
    inside = Window.partitionBy("source_key", "bucket").orderBy("order_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("word_start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.greatest(F.lit(0), F.least(F.col("size"), words - passes * F.col("source_size") - F.col("word_start")))
    if whole:
        left = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    placed = placed.withColumn("whole_passes", passes).withColumn("part_words", left).withColumn("taken", passes * F.col("size") + left)
    pick = (F.pmod(F.col("rank"), F.lit(len(schedule))) + 1).cast("int")
    start, end = (F.element_at(F.array(*(F.lit(float(s[i])) for s in schedule)), pick) for i in (0, 1))
    return placed.select("id", "source", "size", "source_size", "target", "taken", "word_start", "whole_passes", "part_words", "order_key", start.alias("w_start"), end.alias("w_end"), *(f"keep_{c}" for c in keep))


def schedule_mix(plan: DataFrame) -> DataFrame:
    """The training sequence: one row per taken stretch, with ``pass_no, words, position``, range-sorted by position.

    A document that is taken twice has two rows, one for each pass; ``words`` is below ``size`` for
    the one document of a source at which its target is reached.
    """
    stretches = F.transform(F.sequence(F.lit(0), F.col("whole_passes").cast("int")), lambda p: F.struct(p.alias("pass_no"), F.when(p < F.col("whole_passes"), F.col("size")).otherwise(F.col("part_words")).alias("words")))
    rows = plan.withColumn("stretch", F.explode(F.filter(stretches, lambda s: s["words"] > 0))).select("*", "stretch.pass_no", "stretch.words").drop("stretch")
    middle = F.col("pass_no") * F.col("source_size") + F.col("word_start") + F.col("words") / 2.0
    rows = rows.withColumn("position", _position(middle, F.col("target"), F.col("w_start"), F.col("w_end")))
    return rows.repartitionByRange(max(partitions(plan.sparkSession), -(-plan.count() // RANGE_ROWS)), *ORDER).sortWithinPartitions(*ORDER)


def scheduled(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The plan and the training sequence, both written out: every position is computed and the rows are dealt by it, whatever a reader selects."""
    plan = written(plan_mix(docs, **options), "mix-plan")
    return plan, written(schedule_mix(plan), "mix-sequence")


def per_document(plan: DataFrame, sequence: DataFrame) -> DataFrame:
    """The plan's rows with what the sequence holds of each: ``taken`` (its words), ``n_stretches, first_position, last_position``.

    A document with words has a place of its own on its source's line, which tells even equal rows
    apart; those never taken have no stretch and null positions.
    """
    source_key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    sums = sequence.groupBy(source_key.alias("seq_source"), F.col("word_start").alias("seq_start")).agg(F.sum("words").alias("seq_words"), F.count(F.lit(1)).alias("n_stretches"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    rows = plan.drop("taken").withColumn("seq_key", source_key)
    joined = rows.join(sums, (F.col("size") > 0) & (F.col("seq_key") == F.col("seq_source")) & (F.col("word_start") == F.col("seq_start")), "left")
    return joined.withColumn("taken", F.coalesce(F.col("seq_words"), F.lit(0)).cast("long")).withColumn("n_stretches", F.coalesce(F.col("n_stretches"), F.lit(0)).cast("long")).drop("seq_key", "seq_source", "seq_start", "seq_words")


def mixed_documents(docs: DataFrame, columns: list[str], with_order: bool = False, **options) -> DataFrame:
    """The mix as documents with the given columns, in training order, which the columns of ``ORDER`` carry on if asked for; a document cut at the target keeps its first words, joined by single spaces; with ``whole`` all texts stay as they are."""
    taken = schedule_mix(plan_mix(docs, keep=tuple(columns), **options))
    if options.get("whole"):
        return taken.select(*(F.col(f"`keep_{c}`").alias(c) for c in columns), *(ORDER if with_order else ()))
    words = F.split(F.trim(F.regexp_replace(F.col("keep_text"), r"[\x20\x09-\x0D]+", " ")), " ")
    is_cut = F.col("words") < F.col("size")
    text = F.when(is_cut, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("keep_text"))
    changed = {"text": text, "n_chars": F.when(is_cut, F.char_length(text).cast("long")).otherwise(F.col("keep_n_chars")) if "n_chars" in columns else None}
    return taken.select(*((F.col(f"`keep_{c}`") if changed.get(c) is None else changed[c]).alias(c) for c in columns), *(ORDER if with_order else ()))
