"""What the search for repeats costs: memory of its samples, tables between its steps."""

import tracemalloc

import numpy as np
import pytest

from dendrion.llm import repeats, windows
from dendrion.llm.bytehash import U, mix


@pytest.mark.parametrize("reach", [1, 3, 8, 131])
def test_samples_are_the_least_keys_of_all_windows(reach):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 97 + k, n, dtype=np.uint8)) for k in (1, 2, 26) for n in (0, 7, reach + 6, reach + 7, reach + 8, 400, windows.BUFFER + 300, 2 * windows.BUFFER)]
    want = []
    for i, t in enumerate(texts):
        grams = np.array([int.from_bytes(t[k : k + windows.GRAM], "little") for k in range(len(t) - windows.GRAM + 1)], U)
        key = mix(grams + U(0x1234567)) >> U(24)
        last = None
        for w in range(len(key) - reach + 1):
            p = w + reach - 1 - int(np.argmin(key[w : w + reach][::-1]))
            if p != last:
                want.append((i, p, w))
            last = p
    assert list(zip(*(x.tolist() for x in windows.samples(texts, reach)), strict=True)) == want


def test_sampling_holds_the_keys_of_a_short_stretch_only():
    text = np.random.default_rng(5).integers(97, 123, 4_000_000, dtype=np.uint8).tobytes()
    windows.samples([text[:1000]], 131)
    tracemalloc.start()
    windows.samples([text], 131)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the samples themselves take some 1.5 MB, each of several times
    assert peak < 16e6


def test_records_of_rows_come_back():
    owner = np.array([0, 0, 2, 2, 2])
    column = repeats._packed(owner, 4, repeats._ITEM, rank=np.arange(5) << 40, j=np.arange(5), level=np.arange(5) % 2)
    assert [len(x) for x in column.to_pylist()] == [32, 0, 48, 0]
    for part, rows, first in ((column, owner, 0), (column.slice(1, 3), owner[2:] - 1, 2)):
        row, items = repeats._unpacked(part, repeats._ITEM)
        assert row.tolist() == rows.tolist() and items["rank"].tolist() == [k << 40 for k in range(first, 5)] and items["level"].tolist() == [k % 2 for k in range(first, 5)]


def test_tables_between_steps_hold_bytes_instead_of_lists(spark, monkeypatch):
    made, written = {}, repeats.written

    def noted(df, name):
        made[name] = dict(df.dtypes)
        return written(df, name)

    monkeypatch.setattr(repeats, "written", noted)
    passage = "".join(np.random.default_rng(6).choice(list("abcdefgh "), 1000))
    docs = spark.createDataFrame([(1, "one " + passage), (2, passage + " two"), (3, "three")], "doc_id long, text string")
    got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: [(4, 1004)], 2: [(0, 1000)], 3: []}
    assert not [(t, c) for t in ("repeat-known", "repeat-state") for c, kind in made[t].items() if "array" in kind]
