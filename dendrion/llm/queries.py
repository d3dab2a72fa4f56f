"""The corpus operators bound to the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, exact_dedup, language_id, mixing, near_dedup, repeats, runs, secret_scan, sharding, token_counts, token_store, url_filter
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.transform("matches", lambda m: m["item_id"])
    return found.select(F.col("id").alias("doc_id"), (F.size("matches") > 0).alias("contaminated"), items.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("min_distance"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=400, with_kept=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    out = token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path=path, end_id=2)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, similarity=0.85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.in_fold(F.col("doc_id"))
    out = language_id.predict(docs, language_id.learn(docs.where(~held_out)))
    return out.select(F.col("id").alias("doc_id"), language_id.in_fold(F.col("id")).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.combine(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=path, limit=1024).withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the training sequence holds of each document, read back from the sequence, with its first and last training position."""
    out = mixing.per_document(*mixing.scheduled(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", *(F.round(c, 9).alias(c) for c in ("first_position", "last_position")))


def op10_training_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per taken stretch with its training position, range-sorted by it."""
    out = mixing.schedule_mix(mixing.plan_mix(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "source", F.col("pass_no").cast("long").alias("pass_no"), "words", "size", F.round("position", 9).alias("position"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the repositories, their sources the owners."""
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    having = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "bare")
    return out.select(
        F.col("id").alias("doc_id"),
        *(having("kind", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
        *(having("verdict", v).alias(f"n_{v}") for v in ("live", "copied")),
    )


def made_periodic(id_: Column, text: Column) -> Column:
    """The texts of the contract: with h = crc32 of the decimal id, one text in ten repeats a stretch of its words up to its end."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # p words are repeated at most eleven times
    block = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(block, F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & (F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) != ""), repeated).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    out = runs.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(table(spark, sf_dir, "documents"), a_path=a_path, b_path=b_path).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontamination, op2_repeats, op3_token_store, op4_near_dedup, op5_sharding, op6_url_filter, op7_language_id, op8_exact_dedup, op9_token_counts, op10_mixing, op10_training_sequence, op11_secret_scan, op12_periodic_runs, op13_token_alignment, pipeline)
    return {f.__name__: f for f in ops}


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.c + nb.c - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP6 = f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rh, rp, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in url_filter.RULES)}),
fits AS (SELECT page_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN fits ON fits.page_id = h.page_id AND k = 1
"""

_OP8 = f"""
WITH t AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""

_OP10 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS spend FROM r),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
l AS (SELECT arg_min((spend - cap_before) / w_from, cap / w) AS level FROM f WHERE (spend - cap_before) / w_from * w <= cap),
t AS (SELECT f.source, rank, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM f, l),
p AS (SELECT row_number() OVER () AS row_id, doc_id, d.source, rank, size, source_size, target, CAST(round(target) AS BIGINT) AS words,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS word_start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM p),
u AS (SELECT *, CAST(passes * size + greatest(0, least(size, words - passes * source_size - word_start)) AS BIGINT) AS taken FROM q),
e AS (SELECT *, unnest(range(0, CAST(passes AS BIGINT) + 1)) AS pass_no FROM u),
x AS (SELECT *, CASE WHEN pass_no < passes THEN size ELSE taken - passes * size END AS words_here, [1, 1, 3][rank % 3 + 1] AS ws, [1, 3, 1][rank % 3 + 1] AS we FROM e),
y AS (SELECT *, least(1.0::DOUBLE, (pass_no * source_size + word_start + words_here / 2.0::DOUBLE) / target) * (ws + we) AS yy FROM x WHERE words_here > 0),
seq AS (SELECT *, round(yy / (ws + sqrt(greatest(0.0::DOUBLE, ws * ws + (we - ws) * yy))), 9) AS position FROM y)
"""
_OP10_DOCUMENTS = f"""{_OP10}, firsts AS (SELECT row_id, min(position) AS first_position, max(position) AS last_position FROM seq GROUP BY row_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken, first_position, last_position FROM u LEFT JOIN firsts USING (row_id)
"""
_OP10_SEQUENCE = f"""{_OP10}
SELECT doc_id, source, CAST(pass_no AS BIGINT) AS pass_no, CAST(words_here AS BIGINT) AS words, CAST(size AS BIGINT) AS size, position FROM seq
"""


def _any_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


_OP11_PATTERNS = {
    "assign": f"""({"|".join(map(_any_case, secret_scan.NAMES))})["'']?\\x20*[:=]\\x20*["'']?([{secret_scan.VALUE}]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "bare": f"[{secret_scan.BARE}]{{20,}}",
}
_OP11 = f"""
WITH k(kind, k, least) AS (VALUES {", ".join(f"('{k}', {i}, {secret_scan.LEAST[k]})" for i, k in enumerate(secret_scan.KINDS))}),
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
pieces AS ({" UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS kind, unnest(string_split_regex(text, '{p}')[:-2]) AS piece, unnest(regexp_extract_all(text, '{p}')) AS hit, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d" for k, p in _OP11_PATTERNS.items())}),
placed AS (SELECT *, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS z,
  CASE WHEN kind = 'assign' THEN regexp_extract(hit, '{_OP11_PATTERNS["assign"]}', 2) ELSE hit END AS value FROM pieces),
long AS (SELECT doc_id, source, kind, k, z - length(hit) AS a, z, value,
  len(list_distinct(string_split(value, ''))) >= {secret_scan.DISTINCT_SIGNS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS random
  FROM placed JOIN k USING (kind) WHERE length(value) >= least),
c AS (SELECT * FROM long l WHERE kind <> 'bare' OR random AND NOT EXISTS (SELECT 1 FROM long b WHERE b.doc_id = l.doc_id AND b.kind <> 'bare' AND b.a < l.z AND b.z > l.a)),
f AS (SELECT value, count(DISTINCT coalesce(source, '-')) AS owners, count(DISTINCT doc_id) AS repositories FROM c GROUP BY value),
v AS (SELECT c.*, CASE WHEN owners > 2 OR repositories > 20 THEN 'copied' WHEN random THEN 'live' ELSE 'weak' END AS verdict FROM c JOIN f USING (value)),
s AS (SELECT * FROM v WHERE kind <> 'bare' OR verdict = 'live'),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))},
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (kind <> 'bare') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_live", "n_copied"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": _OP4, "op6_url_filter": _OP6, "op8_exact_dedup": _OP8, "op10_mixing": _OP10_DOCUMENTS, "op10_training_sequence": _OP10_SEQUENCE, "op11_secret_scan": _OP11}
