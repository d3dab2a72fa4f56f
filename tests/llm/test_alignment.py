"""Token alignment held against whole-text encoding and counting in plain Python."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dendrion.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_force(text, side_a, side_b):
    """(A ids, B ids, groups, links) by the libraries on the whole text and a walk over all bytes."""
    if not text:
        return None
    raw = b" " + text.encode()
    a, b = side_a.library.encode(" " + text, add_special_tokens=False).ids, side_b.library.encode(text)
    x, y = [side_a.bytes_of[i] for i in a], [side_b.bytes_of[i] for i in b]
    if b"".join(x) != raw or b"".join(y) != raw:
        return None
    ends_a, ends_b = dict(zip(itertools.accumulate(map(len, x)), range(len(a)), strict=True)), dict(zip(itertools.accumulate(map(len, y)), range(len(b)), strict=True))
    groups, i, j = [], 0, 0
    for at in range(1, len(raw) + 1):
        if at in ends_a and at in ends_b:
            groups.append((a[i : ends_a[at] + 1], b[j : ends_b[at] + 1]))
            i, j = ends_a[at] + 1, ends_b[at] + 1
    return a, b, groups, [(p[-1], q[-1]) for p, q in groups]


def expected(rows):
    al = alignment.aligner(A, B)
    found = [by_force(t, al.a, al.b) for _, t in rows]
    counts = Counter(link for f in found if f for link in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        names = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(names.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    names = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


HARD = ["", None, " ", "  ", "x ", " x", "\n\n x", "a▁b c", "<|endoftext|> <s> </s>x", "\x00a b", "a  b  c", "日本 語テキスト", "it's don't  x", "é ﬁ Å ́", "\x1c a\x1f b", "word,", "word,word", "a.%%% b\n(c)", "the the the", "²x ½", "x" * 300, "  y"]


def test_bitsets():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(rng.integers(1, n + 1, n // 3 + 1), n)) for _ in range(2))
        cuts, to_a, to_b = alignment.shared_cuts(np.diff(a, prepend=0), np.diff(b, prepend=0))
        assert cuts.tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert to_a.tolist() == [int((a <= c).sum()) for c in cuts] and to_b.tolist() == [int((b <= c).sum()) for c in cuts]
    assert [len(x) for x in alignment.shared_cuts(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_hard_texts_ties_and_clashing_columns(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "the word"), (3, "the word"), (None, "the word")]
    docs = spark.createDataFrame([(i, t, "k", -1) for i, t in rows], "doc_id long, text string, key string, n_a int")
    assert collected(alignment.align_tokens(docs, a_path=A, b_path=B)) == expected(rows)
    assert alignment.align_tokens(docs.limit(0), a_path=A, b_path=B).count() == 0


@pytest.mark.parametrize("links", [1, 50])
def test_documents_over_several_blocks_and_pieces(spark, monkeypatch, links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 40)
    monkeypatch.setattr(alignment, "TOGETHER_CHARS", 30)
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 3)
    monkeypatch.setattr(alignment, "KNOWN_STEMS", 2)
    al = alignment.Aligner(A, B)
    texts = [t for t in HARD if t] + ["many words, of which some are long. " * 9, "ok " * 30 + "▁ no"]
    got, want = list(al.align_all(texts)), [by_force(t, al.a, al.b) for t in texts]
    assert [g[:3] for g in got] == [(len(f[0]), len(f[1]), len(f[2])) if f else (0, 0, 0) for f in want]
    assert [np.frombuffer(g[4], np.int64).tolist() for g in got] == [[a << 32 | b for a, b in f[3]] if f else [] for f in want]


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.queries()["op13_token_alignment"](spark, sf)
    assert collected(got.withColumnRenamed("doc_id", "id")) == expected(rows)


def test_a_very_long_text(spark):
    base = "periods of words, and signs (some) repeat\n"
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").select("doc_id", F.expr(f"repeat('{base}', 60000)").alias("text"))
    al = alignment.aligner(A, B)
    one = by_force(base * 50, al.a, al.b)
    got = alignment.align_tokens(docs, a_path=A, b_path=B).first()
    per = len(one[0]) / 50
    assert abs(got["n_a"] / 60000 - per) < 0.1 and got["n_links"] == got["n_groups"] > 400_000 and got["n_best"] > 0
