"""Periodic runs held against a search over all periods in plain Python."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from dendrion.llm import queries, runs

WHITE = " \t\n\x0b\x0c\r"


def by_force(words, min_length=6, min_exponent=4):
    """All runs by walking every period over all words."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                # a multiple of a smaller period finds the same stretch again
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return "".join(" " if c in WHITE else c for c in text or "").split(" ")


def expected(doc_id, text):
    words = [w for w in split(text) if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = by_force(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=repr)


def test_window_of_sizes():
    assert [runs.window(*x) for x in ((6, 4), (6, 3), (2, 2), (20, 3))] == [4, 2, 0, 4]


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (2, 2), (4, 3)])
def test_random_sequences(min_length, min_exponent):
    rng = np.random.default_rng(min_length)
    for _ in range(400):
        n, kinds = int(rng.integers(0, 90)), int(rng.integers(1, 5))
        ids = rng.integers(0, kinds, n)
        for _ in range(int(rng.integers(0, 3))):
            if n > 4:
                a, p = int(rng.integers(0, n - 2)), int(rng.integers(1, 9))
                z = min(n, a + p * int(rng.integers(2, 8)) + int(rng.integers(0, p)))
                ids[a:z] = ids[a + np.arange(z - a) % min(p, n - a)]
        assert runs.find_runs(ids, min_length, min_exponent) == by_force(ids.tolist(), min_length, min_exponent)


def test_structured_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for s in (fibonacci[-1], "a" * 500, "ab" * 300 + "a", "aab" * 100 + "b" + "aab" * 100, "".join("ab"[bin(i).count("1") % 2] for i in range(900)), "abcabcabcabd" * 40):
        ids = np.array([ord(c) for c in s])
        for e in (2, 4):
            assert runs.find_runs(ids, 2 * e - 2, e) == by_force(s, 2 * e - 2, e)


def test_hashes_that_clash_change_nothing(monkeypatch):
    monkeypatch.setattr(runs, "_PRIME", 7)
    rng = np.random.default_rng(3)
    for _ in range(60):
        ids = np.tile(rng.integers(0, 3, int(rng.integers(1, 30))), 5)
        ids[int(rng.integers(0, len(ids)))] = 1
        assert runs.find_runs(ids, 2, 2) == by_force(ids.tolist(), 2, 2)


def test_long_periodic_texts_take_time_in_proportion():
    for ids in (np.zeros(200_000, np.int64), np.arange(300_000) % 3, np.arange(300_000) % 70_000):
        n = len(ids)
        assert runs.find_runs(ids) == [(0, n, int(ids.max()) + 1)]


def test_query_on_hard_rows(spark, tmp_path):
    texts = ["", None, " \t", "one", "go " * 6, "go " * 5, "a b " * 4 + "c", "\x85a\xa0b a b", "a\x1cb " * 7, "x y z " * 9 + "x", "p q " * 5 + "r " * 8 + "p q " * 5, "é ü " * 6] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "b a " * 5), (3, "b a " * 5), (None, "b a " * 5)]
    spark.createDataFrame([(i, t, "r", 7) for i, t in rows], "doc_id long, text string, runs string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert collected(got) == sorted((expected(*r) for r in rows), key=repr)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.queries()["op12_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in rows if len(split(r[1])) < 2500]
    got = [r for r in collected(queries.queries()["op12_periodic_runs"](spark, sf)) if r[0] in {i for i, _ in rows}]
    assert got == sorted((expected(*r) for r in rows), key=repr) and any(r[1] for r in got)


def test_operator_returns_runs_and_texts(spark):
    docs = spark.createDataFrame([("k", "to be " * 4 + "or not"), ("m", None)], "name string, body string")
    got = {r["id"]: r for r in runs.periodic_runs(docs, id_col="name", text_col="body").collect()}
    assert got["k"]["kept"] == "to be or not" and got["k"]["n_words"] == 10 and [tuple(r) for r in got["k"]["runs"]] == [(0, 8, 2)] and tuple(got["k"]["strongest"]) == (0, 8, 2)
    assert (got["m"]["kept"], got["m"]["n_words"], got["m"]["runs"], got["m"]["strongest"]) == ("", 0, [], None)
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)
