"""Each operator against brute force, an exact round trip or held-out labels, and on awkward tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dendrion.llm import decontamination, exact_dedup, language_id, mixing, near_dedup, queries, repeats, sharding, token_counts, token_store, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"
LINE = "the quick brown fox jumps over the lazy dog and runs far away from here today "
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "Beta", "gamma.", "über", "\u03a3igma", "x1", "--"]
    text = lambda n: " ".join(rng.choice(words, n))
    base = text(90)
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t", None), (3, base, "a"), (4, base, "b"), (5, base.upper(), "b"), (6, base + " tail", None), (7, LINE * 60, "c"), (8, LINE * 60, "c"), (None, LINE * 3, "c"), (None, "lonely words here", None), (9, "word", "a"), (9, "word", "a"), (9, "other", "a"), (10, text(3000), "b"), (11, "\u00a0 \u2003x", "a"), (12, "12 34 %%", "a"), (13, base.replace("alpha", "omega", 1), "a")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(0, "x", "a")]).where("false")


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def test_exact_dedup(odd, none):
    got = exact_dedup.combine(odd).collect()
    assert len(got) == odd.count()
    rows = {r["id"]: r for r in got if r["id"] not in (None, 9)}
    assert rows[0]["keep_id"] == rows[1]["keep_id"] == 1 and rows[1]["group_size"] == 2 and not rows[0]["kept"]
    assert rows[3]["keep_id"] == 4 or rows[3]["keep_id"] == 5
    assert rows[7]["keep_id"] == 8 and rows[2]["group_size"] == 1
    assert sum(r["group_size"] == 2 for r in got if r["id"] == 9) == 2
    assert rows[12]["digest"] == hashlib.sha256(b"12 34 %%").hexdigest()
    assert exact_dedup.combine(none).count() == 0


def test_mixing(odd, none):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == odd.count()
    size = {}
    for r in plan:
        s = size.setdefault(r["source"], [0, 0, r["target"]])
        s[0], s[1] = s[0] + r["size"], s[1] + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for total, taken, target in size.values():
        assert target <= 2 * total + 1e-6 and abs(taken - target) <= 1
    assert sum(s[2] for s in size.values()) == pytest.approx(min(1.5 * sum(s[0] for s in size.values()), 2 * sum(s[0] for s in size.values())))
    seq = mixing.schedule_mix(mixing.plan_mix(odd)).collect()
    assert sum(r["words"] for r in seq) == sum(r["taken"] for r in plan) and all(0 <= r["position"] <= 1 for r in seq)
    mixed = mixing.mixed_documents(odd, ["doc_id", "text", "source", "n_chars"]).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed) == sum(r["taken"] for r in plan)
    assert mixing.plan_mix(none).count() == 0 and mixing.mixed_documents(none, ["doc_id", "text"]).count() == 0


def test_mixing_runs_its_schedule(spark, odd, monkeypatch, tmp_path):
    # op10 is read from the sequence: a query that stops at the plan never gets here
    ran, whole = [], mixing.schedule_mix
    monkeypatch.setattr(mixing, "schedule_mix", lambda plan: ran.append(1) or whole(plan))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (str(r["doc_id"]), r["size"], r["source_size"], r["taken"])
    got = queries.queries()["op10_mixing"](spark, str(tmp_path)).collect()
    assert ran and sorted(map(key, got)) == sorted(key(r) for r in mixing.plan_mix(odd).withColumnRenamed("id", "doc_id").collect())
    seq = queries.queries()["op10_training_sequence"](spark, str(tmp_path)).collect()
    assert sum(r["words"] for r in seq) == sum(r["taken"] for r in got)
    at = [r["position"] for r in seq]
    assert at == sorted(at) and 0 < at[0] < at[-1] < 1
    # demand follows the schedule: where the weight is steady half of the words come by t = 1/2, where it grows 1 -> 3 only 3/8
    for source, share in (("a", 0.5), ("b", 0.375), ("c", 0.625)):
        flat = [(i, "w " * 4, source2) for source2 in "abc" for i in range(400)]
        mine = [r for r in whole(mixing.plan_mix(frame(spark, flat))).collect() if r["source"] == source]
        early = sum(r["words"] for r in mine if r["position"] <= 0.5) / sum(r["words"] for r in mine)
        assert early == pytest.approx(share, abs=0.01)
    rows = mixing.per_document(*mixing.scheduled(odd)).collect()
    assert len(rows) == odd.count() and all((r["first_position"] is None) == (r["taken"] == 0) for r in rows)


def test_pipeline_mixes_whole_documents(spark, odd):
    import corpus_pipeline

    docs = odd.unionByName(frame(spark, [(100 + i, "two  blanks\n" * 400, s) for i, s in enumerate("abcabc")]))
    texts, size = {}, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert mixed and all(r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and 0 <= r["position"] <= 1 for r in mixed)
    for r in mixed:
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    plan = mixing.plan_mix(docs).collect()
    for source in size:
        mine = [r for r in plan if r["source"] == source]
        assert abs(size[source] - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1


def test_sharding(odd, none):
    got = sharding.shard(odd, shards=4).collect()
    assert len(got) == odd.count() and {r["shard"] for r in got} <= set(range(4))
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    rows = {r["id"]: r for r in got}
    assert rows[7]["shard"] == rows[8]["shard"] and rows[3]["shard"] == rows[4]["shard"]
    assert rows[0]["size"] == 1 and rows[12]["text_crc32"] == zlib.crc32(b"12 34 %%")
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize(("width"), [400, 24])
def test_repeats(odd, none, width):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    starts = {}
    for _, t in texts:
        for i in range(len(t) - width + 1):
            starts[t[i : i + width]] = starts.get(t[i : i + width], 0) + 1
    want = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if starts[t[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((str(i), len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = repeats.remove_repeats(odd, width=width).collect()
    assert sorted((str(r["id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == sorted(want)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.remove_repeats(none, width=width).count() == 0


def gone_by_force(texts, width):
    """(bytes, removed, spans, digest of the rest) of each text, from all windows of all texts."""
    starts = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            w = hash(t[i : i + width])
            starts[w] = starts.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if starts[hash(t[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t + b"x", np.uint8)[~gone])[:-1]).hexdigest()))
    return out


def judged(df):
    return [(r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("width", [400, 40])
def test_repeats_of_stitched_passages(spark, width):
    # passages of many lengths around the width, in different company, periodic runs and near copies
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep") for b in ("pha", "ta", "mma", "lta", "silon")]
    prose = lambda n: (" ".join(rng.choice(words, n // 4 + 2)))[:n]
    shared = [prose(n) for n in (*range(width - 3, width + 4), width * 2, width * 5)] + ["a" * (width + 5), "xyz" * width]
    texts = []
    for i in range(60):
        parts = [prose(int(rng.integers(0, 300)))]
        for _ in range(int(rng.integers(1, 4))):
            s = shared[int(rng.integers(len(shared)))]
            if rng.random() < 0.3:
                at = int(rng.integers(len(s)))
                s = s[:at] + "#" + s[at + 1 :]
            parts += [s, prose(int(rng.integers(0, 300)))]
        texts.append("".join(parts))
    texts += [texts[3], texts[4] + "!", texts[5][7:]]
    got = judged(repeats.remove_repeats(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), width=width))
    assert got == gone_by_force([t.encode() for t in texts], width)


def test_repeats_do_not_rest_on_a_rolling_hash(spark):
    # Thue-Morse words and their complements share all their polynomial hashes modulo a power of two
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    flipped = word.translate(str.maketrans("ab", "ba"))
    texts = ["1 " + word + " one", "2 " + flipped + " two", "3 " + word[:500] + " three"]
    assert judged(repeats.remove_repeats(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]))) == gone_by_force([t.encode() for t in texts], 400)


def test_repeats_of_long_and_of_hot_texts(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh "), 3_000_000))
    rows = [(0, long, "a"), (1, "head " + long[1_000_000:1_200_000] + " tail", "a"), (2, long[2_999_000:] + "end", "a"), (3, long[:399], "a"), (4, long[5:406], "a")]
    got = {r["id"]: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    spans = lambda i: [(s["start"], s["end"]) for s in got[i]["spans"]]
    # chance may let a repeat go on for a byte or two beyond what was copied
    near = lambda found, want: len(found) == len(want) and all(abs(a - b) <= 4 for f, w in zip(found, want, strict=True) for a, b in zip(f, w, strict=True))
    assert near(spans(0), [(5, 406), (1_000_000, 1_200_000), (2_999_000, 3_000_000)])
    assert near(spans(1), [(5, 200_005)]) and near(spans(2), [(0, 1000)]) and spans(3) == [] and spans(4) == [(0, 401)]
    copies = spark.range(10_000).selectExpr("id as doc_id", f"'{long[:700]}' as text").unionByName(spark.createDataFrame([(10_000, "new " + long[100:600] + " end")], "doc_id long, text string"))
    counted = {(r["n_bytes"], r["n_removed"]): r["count"] for r in repeats.remove_repeats(copies).groupBy("n_bytes", "n_removed").count().collect()}
    assert counted.pop((700, 700)) == 10_000 and list(counted) == [(508, 500)]


def test_near_dedup(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (None, 9)]
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = by_id(near_dedup.near_groups(odd, words=3, similarity=0.85))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), comp[i], comp[i] == i), i
    kept = near_dedup.deduplicated(odd, words=3, similarity=0.85)
    assert kept.where("doc_id in (7, 8)").count() == 1 and kept.where("doc_id < 3").count() == 3 and kept.where("doc_id = 9").count() == 2
    assert near_dedup.near_groups(none).count() == 0


def test_large_family_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 4)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        w = list(base)
        for k in rng.choice(120, i % 5, replace=False):
            w[k] = f"e{i}"
        rows.append((i, " ".join(w), "a"))
    sets = [{tuple(r[1].split()[k : k + 3]) for k in range(118)} for r in rows]
    comp = list(range(30))
    for _ in range(30):
        for i in range(30):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = by_id(near_dedup.near_groups(frame(spark, rows), words=3, similarity=0.85))
    assert [got[i]["component_id"] for i in range(30)] == comp


def test_token_store(spark, odd, none, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(odd, path, tokenizer_path=WORD)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(np.asarray([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    at = 0
    for r in got:
        assert r["start"] == at and bytes(r["ids"]) in texts[r["id"]] and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    assert [r["id"] for r in got if r["id"] is not None] == sorted(r["id"] for r in got if r["id"] is not None)
    assert token_store.read_document(spark, path, 12)[0].tobytes() == texts[12][0]
    assert len(token_store.read_document(spark, path, 9)) == 3
    assert token_store.round_trip(none, tokenizer_path=WORD).count() == 0


def test_token_store_starts_no_workers_for_its_dictionary(spark, tmp_path, monkeypatch):
    docs, path = frame(spark, [(i, f"{LINE} number {i} " * 5, "a") for i in range(100)]), str(tmp_path / "store")
    # a list of rows would be unpickled by Python workers of their own
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    token_store.write_store(docs, path, tokenizer_path=WORD)
    assert len(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]) > 0
    assert len(token_store.read_document(spark, path, 7)) == 1


def test_pipeline_stores_in_training_order(spark):
    import corpus_pipeline

    docs = frame(spark, [(i, f"{LINE} number {i} " * (1 + i % 3), "abc"[i % 3]) for i in range(200)])
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    want = [r["doc_id"] for r in sorted(mixed.collect(), key=lambda r: (r["position"], r["order_key"], r["pass_no"]))]
    # the store gets the rows in any order, as from files that are read again
    got = sorted(corpus_pipeline.store_tokens(spark, mixed.repartition(3, "text"), "").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(len(want))) and [r["doc_id"] for r in got] == want != sorted(want)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]


def test_token_counts(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    lib, cache = Tokenizer.from_file(BYTE), str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(odd, tokenizer_path=BYTE, limit=100, cache_path=cache)
        want = [(str(r["doc_id"]), len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
        assert sorted((str(r["id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == sorted(want)
        distinct = token_counts.open_cache(spark, cache)
        assert distinct.count() == distinct.select("content").distinct().count()
    assert token_counts.count_tokens(none, tokenizer_path=BYTE).count() == 0


def test_language_id(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_id.in_fold(F.col("doc_id"))
    profiles = language_id.learn(docs.where(~held))
    got = language_id.predict(docs.where(held), profiles, keep=("lang",)).collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    strange = frame(spark, [(1, None, "a"), (2, "", "a"), (3, "123 !!", "a"), (4, "x" * 9, "a")])
    assert [r["lang_pred"] for r in language_id.predict(strange, profiles).orderBy("id").collect()][:3] == ["und"] * 3
    assert language_id.predict(none, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(strange, language_id.learn(none)).collect()} == {"und"}


def test_language_id_of_many_scripts(spark):
    # far more than 62 letters, in which the long texts of one script come first
    rng, rows = np.random.default_rng(4), []
    scripts = {f"l{k}": [chr(c) for c in range(0x4E00 + 100 * k, 0x4E00 + 100 * k + (90 if k == 0 else 20))] for k in range(6)} | {"deseret": [chr(c) for c in range(0x10428, 0x10440)], "plain": list("abcdefghij")}
    for lang, letters in scripts.items():
        rows += [(len(rows) + i, " ".join("".join(rng.choice(letters, 4)) for _ in range(2000 if lang == "l0" else 60)), lang) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.learn(docs.where("doc_id % 3 > 0")), keep=("lang",)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    emoji = spark.createDataFrame([(1, "12 \U0001f600\U0001f680 34")], "doc_id long, text string")
    assert language_id.predict(emoji, language_id.learn(docs)).first()["lang_pred"] == "und"
    many = spark.createDataFrame([(i, chr(0x4E00 + i) * 9, f"m{i:03}") for i in range(450)], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in language_id.predict(many, language_id.learn(many), keep=("lang",)).collect())


def test_pipeline_drops_unlearned_languages(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(200)) for _ in range(20)]
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(corpus_pipeline.COLUMNS)
    strange = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate([finnish, *noise])], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(strange), "").select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.where("lang is not null and text rlike '[a-zA-Z]'").select("doc_id").collect()}
    assert clean and clean <= kept and not any(i >= 10**9 for i in kept)


def test_decontamination(spark, none):
    item = "A rather long benchmark question, about rivers and mountains and what lies between them?"
    edited = item.replace("rivers", "rovers").replace("between", "betwen")
    docs = frame(spark, [(1, "before " + item + " after", "a"), (2, LINE + edited.upper(), "a"), (3, LINE * 50, "a"), (4, None, "a"), (5, item[:40], "a"), (5, "yes!", "a")])
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, item), (13, "Yes"), (14, item)], "item_id long, text string")
    got = [(r["id"], [(m["item_id"], m["distance"]) for m in r["matches"]]) for r in decontamination.find_items(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, [(10, 0), (14, 0)]), (2, [(10, 2), (14, 2)]), (3, []), (4, []), (5, []), (5, [(13, 0)])], key=str)
    assert decontamination.find_items(none, bench).count() == 0 and decontamination.find_items(docs, bench.where("false")).where("size(matches) > 0").count() == 0


def test_short_items_inside_documents(spark):
    docs = frame(spark, [(1, LINE + "Who wrote Faust? " + LINE, "a"), (2, "who wrote faust", "a"), (3, "whowrote fausto", "a"), (4, LINE + "who wrotte faust", "a"), (5, "eyes and cats", "a"), (6, "say Yes: now", "a")])
    bench = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "yes"), (3, "cat")], "item_id long, text string")
    got = {r["id"]: [(m["item_id"], m["distance"], m["end"]) for m in r["matches"]] for r in decontamination.find_items(docs, bench).collect()}
    assert got == {1: [(1, 0, len(LINE) + 15)], 2: [(1, 0, 15)], 3: [], 4: [(1, 1, len(LINE) + 16)], 5: [], 6: [(2, 0, 7)]}


def test_myers_against_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 12), rng.integers(0, 30)))
        row = np.arange(len(p) + 1)
        best = len(p)
        for ch in t:
            new = np.zeros_like(row)
            for i, a in enumerate(p, 1):
                new[i] = min(row[i - 1] + (a != ch), row[i] + 1, new[i - 1] + 1)
            row, best = new, min(best, int(new[-1]))
        assert decontamination.best_match(p, t)[0] == best


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "http://a.net", "http://a.net/", "HTTP://X.Example.NET/en/7?q", "https://example.com/de/#x", "https://notexample.com/de/", "ftp://a.org/fr/1", "http://net/x", "a://b://c.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, action string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).orderBy("id").collect()]
    quiet, net = (None, "allow"), ("net/", "block")
    assert got == [quiet, quiet, quiet, quiet, quiet, net, ("example.net/en/", "allow"), ("example.com/de/", "block"), quiet, ("org/fr/", "allow"), net, quiet]
    assert url_filter.judge(pages.where("false"), rules).count() == 0
