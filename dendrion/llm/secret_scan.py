"""Secret scans with corpus-wide ownership frequency.

A scan of each text finds candidates: values that are assigned to a name such as ``token``, access
keys, long hexadecimal numbers, and bare tokens of mixed signs.  What a candidate is worth shows in
the corpus only: a value that many owners or repositories hold is an example that was copied from
some manual; one that a few hold, and that looks random, may be a live credential of theirs.

So the digests of all candidates are counted by distinct repositories and owners.  Spans of the first
three kinds are always reported, with the verdict beside them; bare tokens, which are mostly names
and numbers of other sorts, are reported only where they are live by that count.

Counting combines on both sides of each shuffle: (value, owner, repository), then (value, owner), then
the value.  The counts come back to the spans by a join, except for values that more than one in
``HOT_PARTS`` of all candidates have; there are fewer than that of them, so they are broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped, named, written

#: The kinds in the order in which they are listed, the names of assignments, the least lengths.
KINDS = ("assign", "access", "hex", "bare")
NAMES = ("password", "passwd", "secret", "token", "api_?key")
LEAST = {"assign": 6, "access": 20, "hex": 24, "bare": 20}
#: Signs of a value, and of a bare token.
VALUE, BARE = "A-Za-z0-9+/_.=-", "A-Za-z0-9+/_-"
#: A value looks random with so many different signs, a letter and a digit.
DISTINCT_SIGNS = 10
#: A value is hot with more than this share of all candidates; there can't be more hot values than parts.
HOT_PARTS = 1000

_WORDS = tuple(w.encode() for n in NAMES for w in ((n.replace("_?", "_"), n.replace("_?", "")) if "_?" in n else (n,)))
_ASSIGN = re.compile(rf"""(?:{"|".join(NAMES)})["']?\x20*[:=]\x20*["']?([{VALUE}]+)""".encode(), re.IGNORECASE)
_ACCESS = re.compile(b"AKIA[A-Z0-9]+")
_ALPHABET = {kind: np.isin(np.arange(256), [b for b in range(128) if re.fullmatch(f"[{signs}]", chr(b))]) for kind, signs in (("hex", "0-9a-f"), ("bare", BARE))}


def _stretches(data: np.ndarray, kind: str) -> list[tuple[int, int]]:
    """All whole stretches of a kind's signs that are long enough."""
    solid = _ALPHABET[kind][data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    edge = np.concatenate([[0] if solid[0] else np.zeros(0, np.int64), edge, [len(data)] if solid[-1] else np.zeros(0, np.int64)]).astype(np.int64)
    starts, ends = edge[::2], edge[1::2]
    long = np.flatnonzero(ends - starts >= LEAST[kind])
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def looks_random(value: bytes) -> bool:
    return len(set(value)) >= DISTINCT_SIGNS and any(c in b"0123456789" for c in value) and any(chr(c).isalpha() for c in value)


def candidates(text: str | None) -> list[tuple[int, int, int, bytes, bool]]:
    """(kind, start, end, digest of the value, whether it looks random) of a text; places are code points.

    Spans of one kind don't overlap, and a bare token overlaps no span of the other kinds.
    """
    raw = (text or "").encode()
    if not raw:
        return []
    low, found = raw.lower(), []
    if any(w in low for w in _WORDS):
        found += [(0, m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(raw) if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(raw) if len(m[0]) >= LEAST["access"]]
    data = np.frombuffer(raw, np.uint8)
    found += [(2, a, z, raw[a:z]) for a, z in _stretches(data, "hex")]
    taken = np.array(sorted((a, z) for _, a, z, _ in found)).reshape(-1, 2)
    # spans may lie in each other, so the greatest end so far counts
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    for a, z in _stretches(data, "bare"):
        k = np.searchsorted(taken[:, 0], z)
        if looks_random(raw[a:z]) and not (k and reach[k - 1] > a):
            found.append((3, a, z, raw[a:z]))
    found.sort(key=lambda s: (s[1], s[0]))
    if not raw.isascii():
        places = sorted({p for s in found for p in s[1:3]})
        point, at, chars = {}, 0, 0
        for p in places:
            chars += len(raw[at:p].decode())
            point[p], at = chars, p
        found = [(k, point[a], point[z], v) for k, a, z, v in found]
    return [(k, a, z, hashlib.sha256(v).digest()[:16], looks_random(v)) for k, a, z, v in found]


def _scan(id_type: pa.DataType, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("random", pa.bool_())])
        for b in batches:
            spans = [[{"start": a, "kind": k, "end": z, "value": v, "random": r} for k, a, z, v, r in candidates(t)] for t in b.column(3).to_pylist()]
            fixed = [b.column(0).cast(id_type), *(b.column(1 + i).cast(t) for i, t in enumerate(kinds))]
            yield pa.record_batch([pa.array(range(key, key + b.num_rows), pa.int64()), *fixed, pa.array(spans, pa.list_(span))], names=["key", "id", "owner", "repository", "spans"])
            key += b.num_rows

    return run


def ownership(spans: DataFrame) -> DataFrame:
    """``value, n, n_repositories, n_owners`` of rows ``value, owner, repository``; a repository belongs to its owner, null is an owner or repository like others."""
    places = spans.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value").agg(F.sum("n").alias("n"), F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, *, max_owners: int = 2, max_repositories: int = 20, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id, spans``, an array of ``start, kind, end, verdict, n_repositories, n_owners`` by start, then kind.

    Kinds: ``assign`` (a name, then ``:`` or ``=``, then a value), ``access``, ``hex``, ``bare``; places
    are code points, ends exclusive, leftmost matches of one kind without overlaps.  Verdicts:
    ``copied`` if more than ``max_owners`` owners or ``max_repositories`` repositories hold the value in
    any kind of candidate; else ``live`` if it looks random, ``weak`` if it doesn't.  Bare tokens are
    there only if live.

    Null and empty texts have no spans.  Null owners together are one owner, null repositories of an
    owner one repository.  Repeated rows are rows of their own (and one repository).  Columns of other
    names don't matter; an empty table gives an empty result.  Texts are read whole, at some ten
    bytes of memory for each of theirs.
    """
    rows = named(docs, id=id_col, owner=owner_col, repository=repository_col, text=text_col)
    types = [rows.schema[c].dataType for c in ("id", "owner", "repository")]
    fields = ", ".join(f"{c} {t.simpleString()}" for c, t in zip(("id", "owner", "repository"), types, strict=True))
    arrow = [to_arrow_type(t) for t in types]
    found = written(mapped(rows, _scan(arrow[0], arrow[1:]), f"key long, {fields}, spans array<struct<start: long, kind: int, end: long, value: binary, random: boolean>>"), "secret-candidates")
    single = found.where(F.size("spans") > 0).select("key", "id", "owner", "repository", F.explode("spans").alias("s")).select("key", "id", "owner", "repository", "s.*")
    counts = written(ownership(single.select("value", "owner", "repository")), "secret-owners")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(100, total // HOT_PARTS)
    facts = ("n_repositories", "n_owners")
    single = single.drop("owner", "repository")
    marked = single.join(F.broadcast(counts.where(hot).drop("n")), "value", "left")
    rest = marked.where("n_owners is null").drop(*facts).join(counts.where(~hot).drop("n"), "value")
    judged = marked.where("n_owners is not null").unionByName(rest)
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    judged = judged.withColumn("verdict", F.when(copied, "copied").when(F.col("random"), "live").otherwise("weak"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    # a row keeps its place in the result even if none of its bare tokens is live
    span = F.when((F.col("kind") < KINDS.index("bare")) | (F.col("verdict") == "live"), F.struct("start", F.col("kind").alias("order"), kind.alias("kind"), "end", "verdict", *facts))
    some = judged.groupBy("key", "id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    plain = F.transform("spans", lambda s: s.dropFields("order"))
    none = found.where(F.size("spans") == 0).select("key", "id", F.array().cast(some.schema["spans"].dataType).alias("spans"))
    return some.unionByName(none).select("id", plain.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
