"""Hot groups, clashes of hashes, long texts and brute force for the corpus operators and the stages of the pipeline."""

import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dendrion.llm import bytehash, decontamination, exact_dedup, language_id, mixing, near_dedup, sharding, url_filter
from dendrion.llm.tokenizer import tokenizer


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_that_share_polynomial_hashes_are_told_apart(spark):
    one, two = thue_morse(10)
    hashes, n = bytehash.word_hashes([one.encode(), two.encode(), (one + " " + one[:9] + " " + one[:8]).encode()])
    assert list(n) == [1, 1, 3] and len(set(hashes.tolist())) == 4
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert all(r["kept"] for r in near_dedup.near_groups(docs, words=3, similarity=0.85).collect())


def test_word_hashes_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcXYZé"), int(rng.integers(1, 30)))) for _ in range(300)]
    alone = [int(bytehash.word_hashes([w.encode()])[0][0]) for w in words]
    together, n = bytehash.word_hashes([" ".join(words[:100]).encode(), "\n\t".join(words[100:]).encode(), b""])
    assert together.tolist() == alone and list(n) == [100, 200, 0]
    assert len({w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words}) == len(set(alone))


def test_a_worker_keeps_what_one_operator_remembers():
    text = " ".join(f"word{i}" for i in range(30_000)).encode()
    tracemalloc.start()
    try:
        held = [tracemalloc.get_traced_memory()[0]]
        for key in (b"first run", b"second run"):
            want = bytehash.word_hashes([text], key)[0].sum()
            held.append(tracemalloc.get_traced_memory()[0])
        assert bytehash.word_hashes([text], b"second run")[0].sum() == want
        one = held[1] - held[0]
        assert one > 1_000_000 and held[2] - held[0] < 1.2 * one
        # the tokenizer's own parts, which it loads here, lie outside of what is traced but for a few
        tok = tokenizer(public_tokenizers.path("word_bpe_49k.json"), "ids")
        assert tracemalloc.get_traced_memory()[0] - held[0] < 0.7 * one
        assert tokenizer(public_tokenizers.path("word_bpe_49k.json"), "ids") is tok
    finally:
        tracemalloc.stop()


def test_near_dedup_of_many_rows_without_id(spark):
    a, b = ("the cat sat on the mat and looked at {} birds in the old garden behind our house near the river".format(x) for x in ("seven", "eight"))
    nulls = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"case when id % 2 = 0 then '{a}' else '{b} once more' end as text")
    docs = nulls.unionByName(spark.createDataFrame([(5, a), (5, a), (6, "something else that is quite different from all the others here")], "doc_id long, text string"))
    got = near_dedup.near_groups(docs, words=3, similarity=0.6)
    assert got.count() == 20_003
    assert {(r["id"], r["component_id"]) for r in got.select("id", "component_id").distinct().collect()} == {(None, 5), (5, 5), (6, 6)}
    assert near_dedup.deduplicated(docs, words=3, similarity=0.6).count() == 2


def test_signature_distance_and_recall(spark):
    sigs = np.array([[1, 2, 3, 4], [1, 2, 9, 4], [5, 6, 7, 8]], np.uint16)
    assert near_dedup.sharing_keys(sigs).tolist() == [[True, True, False], [True, True, False], [False, False, True]]
    # pairs of every similarity around the limit, held against all pairs
    rng = np.random.default_rng(6)
    rows = []
    for g in range(60):
        base = [f"w{g}x{k}" for k in range(120)]
        for _ in range(4):
            w = list(base)
            for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
                w[k] = f"e{len(rows)}k{k}"
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    comp = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(i - i % 4, i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == comp and len(set(comp)) < len(rows)


def test_exact_dedup_compares_contents_where_digests_clash(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "AB", "cd", "cd", None, "xyz", "uvw", "uvw"])], "doc_id long, text string")
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.combine(docs, digest=F.char_length("content").cast("string")).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_url_lists_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE_KEYS", 40)
    rules = [(f"h{i}.org", "/a/" if i % 2 else "/", ("block", "allow")[i % 3 == 0]) for i in range(300)] + [(None, "/", "block"), ("x.org", None, "allow")]
    urls = [f"https://www.h{i}.org/{'a' if i % 4 else 'b'}/{i}" for i in range(600)] + ["https://h1.org/a/" + "z" * 200_000, None]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert len(got) == len(urls)
    for i in range(600):
        fits = i < 300 and (i % 2 == 0 or i % 4 != 0)
        assert got[i] == ((f"h{i}.org" + ("/a/" if i % 2 else "/"), ("block", "allow")[i % 3 == 0]) if fits else (None, "allow")), i
    assert got[600] == ("h1.org/a/", "block") and got[601] == (None, "allow")


def test_mixing_of_many_sources_and_changed_schedules(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "concat('host', id % 900) as source")
    plan = mixing.plan_mix(docs).select("source", "source_size", "target").distinct().collect()
    size = {r["source"]: r["source_size"] for r in plan}
    order = sorted(size)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # water filling by bisection on the level
    lo, hi, spend = 0.0, 1e6, 1.5 * sum(size.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * size[s], mid * w[s]) for s in order) < spend else (lo, mid)
    for r in plan:
        assert r["target"] == pytest.approx(min(2 * size[r["source"]], lo * w[r["source"]]), rel=1e-6, abs=1e-6)
    early = lambda s: mixing.schedule_mix(mixing.plan_mix(docs, schedule=s)).agg(F.sum(F.when(F.col("position") < 0.5, F.col("words")))).first()[0]
    assert early(((1.0, 9.0),)) < early(((1.0, 1.0),)) < early(((9.0, 1.0),))


def test_shards_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sharding.shard(docs, shards=4)
    sums = [r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    largest = got.groupBy("text_crc32").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    assert len(sums) == 4 and max(sums) - min(sums) <= 2 * largest + 0.01 * sum(sums)


def test_decontamination_against_all_substrings(spark):
    # every item against every stretch of every document, by dynamic programming
    rng = np.random.default_rng(7)
    vocabulary = ["river", "stone", "light", "amber", "cloud", "forest", "seven", "quiet"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [prose(int(rng.integers(5, 12))) for _ in range(12)]

    def edited(t):
        t = list(t)
        for _ in range(int(rng.integers(0, 7))):
            at = int(rng.integers(len(t)))
            t[at : at + 1] = [[], ["q"], [t[at], "q"]][int(rng.integers(3))]
        return "".join(t)

    texts = [prose(4) + " " + edited(items[i % 12]) + " " + prose(3) for i in range(60)] + ["", " ! "]

    def least(p, t):
        row = np.arange(len(p) + 1)
        best = len(p)
        for ch in t:
            new = np.zeros_like(row)
            for i, a in enumerate(p, 1):
                new[i] = min(row[i - 1] + (a != ch), row[i] + 1, new[i - 1] + 1)
            row, best = new, min(best, int(new[-1]))
        return best

    want = {}
    for d, t in enumerate(texts):
        found = [(i, least(p, decontamination.normalised(t))) for i, p in enumerate(items)]
        want[d] = [(i, k) for i, k in found if k <= int(len(items[i]) * decontamination.ERROR_RATE)]
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{n} long, text string") for x, n in ((texts, "doc_id"), (items, "item_id")))
    got = {r["id"]: [(m["item_id"], m["distance"]) for m in r["matches"]] for r in decontamination.find_items(docs, bench).collect()}
    assert got == want and sum(map(len, want.values())) > 20


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with every awkward row, and a benchmark, as the driver's tables."""
    at = tmp_path_factory.mktemp("tables")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    some = real.where("doc_id < 60 and text is not null")
    long = real.where("text is not null").orderBy("doc_id").limit(40).agg(F.array_join(F.collect_list("text"), " ")).first()[0]
    long = (long + "\n") * (5_000_000 // len(long) + 1)
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "a", 0), (10**6 + 2, "123 456 !!", None, "a", 10), (None, long[:900], None, None, 900), (10**6 + 3, long, "en", "a", len(long)), (10**6 + 4, long[:2000], None, "b", 2000), (10**6 + 4, long[:2000], None, "b", 2000)]
    rows = some.unionByName(spark.createDataFrame(odd, some.schema))
    rows.withColumns({"size": F.lit(1), "kept": F.lit("x"), "position": F.lit(0.5), "key": F.lit(None).cast("string")}).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_every_stage_of_the_pipeline(spark, tables):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], set()).add(r["text"])
    assert [name for name, _ in p.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    kept, before = docs, docs.count()
    for name, stage in p.STAGES[:4]:
        kept = stage(spark, kept, tables)
        assert set(p.COLUMNS) <= set(kept.columns), name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        rows = kept.collect()
        assert rows and all(r["text"] in text[r["doc_id"]] for r in rows), name
        if name == "language ID":
            # documents without a letter go, the very long one stays whole
            assert not {10**6, 10**6 + 1, 10**6 + 2} & {r["doc_id"] for r in rows} and max(len(r["text"]) for r in rows) > 5_000_000
        if name == "MinHash near-dedup":
            assert sum(r["doc_id"] == 10**6 + 4 for r in rows) <= 1
        if name != "mixing sources to target weights":
            assert len(rows) <= before
            before = len(rows)
    stored = p.STAGES[4][1](spark, kept, tables).collect()
    assert len(stored) == len(rows) and sorted(r["place"] for r in stored) == list(range(len(rows)))
    whole = p.run(spark, tables)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in whole.collect()) == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in stored)


def test_stages_of_an_empty_table(spark, tables):
    import corpus_pipeline as p

    none = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        none = stage(spark, none, tables)
        assert none.count() == 0


def test_words_made_to_share_an_unkeyed_hash_are_not_linked(spark):
    one, two = "v/c;puh\x1f~#o\\md", "zhkdglfb1-_]:z[`"
    assert len(set(bytehash.word_hashes([one.encode(), two.encode()])[0].tolist())) == 2
    assert bytehash.word_hashes([b"a"], b"x" * 16)[0] != bytehash.word_hashes([b"a"], b"y" * 16)[0]
    got = near_dedup.near_groups(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"), words=3, similarity=0.85).collect()
    assert all(r["kept"] for r in got)


@pytest.mark.parametrize("per_cent", [80, 85])
def test_pairs_at_the_limit_share_a_key(per_cent):
    # simulated: a value is equal with the chance of the similarity; the chance to miss is 1e-6 by choice
    rng = np.random.default_rng(per_cent)
    chunks, pairs = near_dedup.chunks_for(per_cent / 100), 200_000
    equal = rng.random((pairs, chunks, near_dedup.CHUNK)) < per_cent / 100
    missed = (~((~equal).sum(axis=2) <= 1).any(axis=1)).sum()
    assert missed <= 3


def test_urls_with_very_many_labels(spark):
    urls = ["http://" + "a." * 60_000 + "net/x", "http://" + "." * 5_000 + "org/fr/", "http://net/", "http://a.example.net/en/b", "http://x.org/fr"]
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, action string")
    got = {r["id"]: r["rule"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {0: "net/", 1: "org/fr/", 2: "net/", 3: "example.net/en/", 4: None}


def test_letters_that_fold_to_several_at_a_cut(monkeypatch):
    text = "ab\u0130cd \u0130\u0130 efg" * 5
    whole = language_id.Coder().counts(text).tolist()
    for piece in (3, 4, 7, 11):
        monkeypatch.setattr(language_id, "_PIECE", piece)
        assert language_id.Coder().counts(text).tolist() == whole
