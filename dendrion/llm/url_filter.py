"""URL rules by a Bloom filter cascade.

Level 1 is a Bloom filter of the listed keys.  The corpus's complete key universe is known, so the
unlisted keys that level 1 lets through can be counted: level 2 encodes exactly those, level 3 the
listed keys that level 2 lets through, and so on until a level lets nothing through.  A key's
first missing level then tells its membership exactly, for every key of the universe, by bit tests
alone: no page is ever joined with the list.

Keys are ``host`` + ``path prefix``.  A url has one key for each listed number of labels at the end of
its host and each listed path length, since a rule fits a host with all its subdomains and any path
that starts with the rule's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, written

#: (host, path prefix, action)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Keys that one cascade holds at most, about, listed and let through by its first level together.  A longer list is split
#: by a hash of the keys into cascades of this size, one of which at a time is sent along with a pass over the pages.
RANGE_KEYS = 2_000_000
_HASHES = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path.  Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end.  Null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return fold_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1


def _keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys of a url that can be listed: its host's last labels, as many as a listed host has, with each prefix of the path that has a listed length."""
    suffixes = F.array(*(F.struct(F.lit(m).alias("m"), F.substring_index(host, ".", -m).alias("s")) for m in labels))
    suffixes = F.filter(suffixes, lambda x: _labels(host) >= x["m"])
    prefixes = F.array(*(F.struct(F.lit(n).alias("n"), F.substring(path, 1, n).alias("p")) for n in lengths))
    whole = F.filter(prefixes, lambda x: F.char_length(x["p"]) == x["n"])
    return F.flatten(F.transform(suffixes, lambda h: F.transform(whole, lambda x: F.concat(h["s"], F.lit("\t"), x["p"]))))


def _bit(key: Column, seed: int, i: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(n_bits))


@dataclass(frozen=True)
class Level:
    seed: int
    n_bits: int
    words: tuple[int, ...]

    def has(self, key: Column) -> Column:
        """Whether the filter lets the key through."""
        words = F.array(*(F.lit(w) for w in self.words)) if len(self.words) <= 64 else F.from_json(F.lit(str(list(self.words))), "array<long>")
        test = F.lit(True)
        for i in range(_HASHES):
            b = _bit(key, self.seed, i, self.n_bits)
            word = F.element_at(words, (F.floor(b / 64) + 1).cast("int"))
            test = test & (F.call_function("getbit", word, F.pmod(b, F.lit(64)).cast("int")) == 1)
        return test


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the universe.  The first level that rejects decides: an odd one says no, an even one yes."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            verdict = F.when(self.levels[depth - 1].has(key), verdict).otherwise(F.lit(depth % 2 == 0))
        return verdict


def _fill(keys: DataFrame, seed: int, bits_per_key: float) -> tuple[Level, int]:
    n = keys.count()
    n_bits = 64 * max(1, math.ceil(n * bits_per_key / 64))
    bits = F.explode(F.array(*(_bit(F.col("key"), seed, i, n_bits) for i in range(_HASHES))))
    # at most n_bits / 64 rows reach the driver, which the number of keys in a range bounds
    rows = keys.select(bits.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("mask")).collect()
    words = [0] * (n_bits // 64)
    for r in rows:
        words[r["word"]] = r["mask"]
    return Level(seed, n_bits, tuple(words)), n


def build_cascade(listed: DataFrame, universe: DataFrame, *, max_levels: int = 32) -> Cascade:
    """A cascade for the distinct non-null ``key`` of ``listed`` against those of ``universe``.

    Level 1 gets enough bits for about as many false positives as there are listed keys; later
    levels halve what passes at least, so the levels are few and their sizes fall geometrically.
    """
    listed = listed.select("key").where("key is not null").distinct()
    others = universe.select("key").where("key is not null").distinct().join(F.broadcast(listed) if listed.count() <= 100_000 else listed, "key", "left_anti")
    inside, outside, levels = listed, written(others, "url-universe"), []
    ratio = outside.count() / max(1, inside.count())
    bits = max(8.0, 1.5 * math.log2(ratio + 1) + 4)
    for depth in range(1, max_levels + 1):
        level, n = _fill(inside, depth, bits)
        levels.append(level)
        passed = outside.where(level.has(F.col("key")))
        passed = written(passed, "url-passed") if depth == 1 else passed
        if passed.isEmpty():
            return Cascade(tuple(levels))
        inside, outside, bits = passed, inside, 8.0
    raise ValueError("the cascade doesn't end; are the hash functions broken?")


def _longest(cascade: Cascade, action: str, part: int, parts: int) -> Column:
    """The longest of a row's keys that are listed in one range of a list; null without one."""

    def listed(k: Column) -> Column:
        inside = cascade.contains(k)
        return inside if parts == 1 else (F.pmod(F.xxhash64(k, F.lit("range")), F.lit(parts)) == part) & inside

    def entry(k: Column) -> Column:
        return F.struct(F.char_length(F.substring_index(k, "\t", 1)).alias("h"), F.char_length(k).alias("n"), F.lit(action).alias("action"), k.alias("key"))

    return F.array_max(F.transform(F.filter(F.col("keys"), listed), entry))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``.

    ``rules``: ``host, path, action`` (allow or block), its hosts in lower case.  The longest
    fitting rule wins, a longer host before a longer path; of a key listed with both actions,
    block wins.  Without a fitting rule the verdict is ``default``: the cascades hold all listed
    keys, and a page none of whose keys is listed is not filtered.  Null and malformed urls, with
    empty host and path, fit no rule; a url of any length and any number of labels is read whole.  Repeated pages are judged
    alike; other columns are ignored whatever their names; an empty table gives an empty result.
    Lists may be of any length: see ``RANGE_KEYS``.  Rules without host or path are left out.
    """
    rules = rules.select(F.col("action"), F.concat("host", F.lit("\t"), "path").alias("key"), F.char_length("path").alias("n"), _labels(F.col("host")).alias("m")).where("key is not null")
    # as many as path lengths and numbers of labels that occur in the list
    lengths, labels = (sorted(r[0] for r in rules.select(c).distinct().collect()) for c in "nm")
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", _keys(F.col("host"), F.col("path"), labels, lengths) if lengths else F.array().cast("array<string>"))
    universe = written(rows.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    best = F.lit(None).cast("struct<h:int,n:int,action:string,key:string>")
    rows = rows.withColumn("best", best)
    passes = [(a, r, -(-n // RANGE_KEYS)) for a, n in sorted(rules.groupBy("action").agg(F.count_distinct("key")).collect(), reverse=True) for r in range(-(-n // RANGE_KEYS))]
    for i, (action, part, parts) in enumerate(passes, 1):
        mine = F.pmod(F.xxhash64("key", F.lit("range")), F.lit(parts)) == part
        cascade = build_cascade(rules.where(F.col("action") == action).where(mine), universe.where(mine))
        rows = rows.withColumn("best", F.greatest("best", _longest(cascade, action, part, parts)))
        # a few passes are one plan; with many, each is written, so that no plan holds more than a few cascades
        rows = written(rows, "url-pass") if i % 4 == 0 and i < len(passes) else rows
    return rows.select("id", "host", "path", F.translate(F.col("best.key"), "\t", "").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
