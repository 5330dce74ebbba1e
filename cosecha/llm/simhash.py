"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 positions of a fingerprint has a non-zero vector of radius + 1
bits.  Mask v, one for each non-zero vector v, holds the positions whose
vector has an odd product with v.  Two fingerprints that differ in at most
``radius`` positions give that many vectors at most, which cannot span the
whole space: some v is orthogonal to all of them, its mask holds none of the
differing positions, and the pair meets in table v.  No pair is missed.

Documents become one vertex for each distinct fingerprint, so copies cost one
row.  A bucket of a table with up to ``BUCKET`` fingerprints is compared in
one step; a larger one goes through the same cover again with other vectors,
which adds about half of the positions that are left to its mask.  The pair
that met there meets again, so nothing is lost, and after a few levels a
bucket has so few free positions that it can hold no more fingerprints.
Only the links that a bucket needs to stay connected leave its step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, by_bytes, utf8, written
from .graph import components

SHINGLE = 3
RADIUS = 3
BUCKET = 1_024  # fingerprints that are compared with each other in one step
STEP = 1 << 16  # shingles whose bits are counted at a time

# ------------------------------------------------------------ fingerprints

# XXH64's primes (fixed values), the seed, and the sums that a text of 32 bytes or more starts from.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
SEED = 42
P1, P2, P3, P4, P5 = (np.uint64(p) for p in PRIMES)
SHORT = np.uint64(SEED + PRIMES[4])
LONG = [np.uint64((SEED + p) % (1 << 64)) for p in (PRIMES[0] + PRIMES[1], PRIMES[1], 0, -PRIMES[0])]


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(x: np.ndarray) -> np.ndarray:
    return _turn(x * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed ``SEED``) of the byte spans [start, end) of ``data``, all spans at once."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(held, (len(data) + 1, 8), (1, 1))

    def lanes(at: np.ndarray, width: int) -> np.ndarray:
        return np.ascontiguousarray(eight[at, :width]).view(f"<u{width}").ravel().astype(np.uint64)

    size = (end - start).astype(np.uint64)
    at = start.copy()
    out = np.full(len(start), SHORT, np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        sums = [np.full(len(long), s, np.uint64) for s in LONG]
        live = np.arange(len(long))
        while len(live):
            here = at[long[live]]
            for k, s in enumerate(sums):
                s[live] = _turn(s[live] + lanes(here + 8 * k, 8) * P2, 31) * P1
            at[long[live]] += 32
            live = live[end[long[live]] - at[long[live]] >= 32]
        h = _turn(sums[0], 1) + _turn(sums[1], 7) + _turn(sums[2], 12) + _turn(sums[3], 18)
        for s in sums:
            h = (h ^ _round(s)) * P1 + P4
        out[long] = h
    out += size
    live = np.flatnonzero(end - at >= 8)
    while len(live):
        out[live] = _turn(out[live] ^ _round(lanes(at[live], 8)), 27) * P1 + P4
        at[live] += 8
        live = live[end[live] - at[live] >= 8]
    live = np.flatnonzero(end - at >= 4)
    out[live] = _turn(out[live] ^ (lanes(at[live], 4) * P1), 23) * P2 + P3
    at[live] += 4
    live = np.flatnonzero(end > at)
    while len(live):
        out[live] = _turn(out[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        live = live[end[live] > at[live]]
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    return out


def fingerprints(batch: pa.RecordBatch, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text of a batch.

    A bit is 1 if over half of the text's shingle hashes have it, repeats
    included.  A text of fewer words than a shingle is one shingle; one
    without words has fingerprint zero.
    """
    data, offsets = utf8(batch.column("text"))
    n = len(data)
    if not n:
        return np.zeros(batch.num_rows, np.uint64)
    # Words joined by one blank: each word's bytes and the byte behind it.
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    size = end - start
    to = np.cumsum(size + 1) - size - 1  # where each word starts once joined
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    kept = np.ones(len(joined), bool)
    kept[to + size] = False
    joined[kept] = LOWER[data[~space]]
    ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
    count = np.diff(ends)
    heads = np.flatnonzero(np.arange(len(row)) <= (ends[1:] - np.minimum(shingle, np.maximum(count, 1)))[row])
    tails = np.minimum(heads + shingle, ends[1:][row[heads]]) - 1
    owner = row[heads]
    bits = np.zeros((batch.num_rows, 64), np.int64)
    for a in range(0, len(heads), STEP):
        h, who = heads[a:a + STEP], owner[a:a + STEP]
        found = xxh64(joined, to[h], to[tails[a:a + STEP]] + size[tails[a:a + STEP]])
        ones = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        bits[who[cuts]] += np.add.reduceat(ones, cuts, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=batch.num_rows)
    return np.packbits(2 * bits > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fingerprints(batch, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------- cover


def masks(radius: int, level: int = 0) -> list[int]:
    """The covering masks: each set of up to ``radius`` positions is outside at least one of them.

    The non-zero vectors of radius + 1 bits are dealt evenly to the 64
    positions, in an order drawn anew for each level.
    """
    size = 1 << (radius + 1)
    vectors = 1 + np.arange(64) % (size - 1)
    vectors = np.random.Generator(np.random.PCG64(1 + level)).permutation(vectors)
    return [sum(1 << p for p in range(64) if int(vectors[p] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(level: int, radius: int, held: Column) -> Column:
    """The masks of a level, each joined to the mask that a fingerprint's bucket has already."""
    return F.explode(F.array(*[held.bitwiseOR(F.lit(_signed(m))) for m in masks(radius, level)]))


def _linked(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among ``fps``: a forest of at most len(fps) - 1 links."""
    near = np.bitwise_count(fps[:, None] ^ fps) <= radius
    left, at, to = np.ones(len(fps), bool), [], []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        edge = [i]
        while edge:
            x = edge.pop()
            new = np.flatnonzero(near[x] & left)
            left[new] = False
            at += [x] * len(new)
            to += new.tolist()
            edge += new.tolist()
    return fps[at], fps[to]


def covering_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within ``radius`` bits.

    Any two fingerprints that differ in at most ``radius`` bits are joined by
    a chain of the returned links, each within the radius itself.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            values, ends = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
            ends = ends - ends[0]
            start, size = ends[:-1], np.diff(ends)
            two = start[size == 2]  # the bulk, all at once
            two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= radius]
            a, b = [values[two]], [values[two + 1]]
            for i in np.flatnonzero(size > 2):
                x, y = _linked(values[start[i]:start[i] + size[i]], radius)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v).view(np.int64))
                                              for k, v in (("a", a), ("b", b))})

    bucket = max(bucket, 1 << radius)  # so many may differ in free positions alone, whatever the masks
    links, level = None, 0
    rows = distinct.select("fp", F.lit(0).cast("long").alias("held"))
    while True:
        # A bucket is a mask and a key under it; ``held`` is the mask that led a large bucket here.
        met = rows.select("fp", _masks(level, radius, F.col("held")).alias("held"))
        met = (met if level == 0 else met.distinct()).withColumn("key", F.col("fp").bitwiseAND(F.col("held")))
        size = written(met.groupBy("held", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        shared = met.join(size, ["held", "key"])
        small = (shared.where(F.col("n") <= bucket).groupBy("held", "key")
                 .agg(F.collect_list("fp").alias("fps")).select("fps"))
        found = written(small.mapInArrow(compare, "a long, b long").distinct(), "links")
        links = found if links is None else links.unionByName(found)
        if not size.where(F.col("n") > bucket).limit(1).count():
            return links
        rows = written(shared.where(F.col("n") > bucket).select("fp", "held"), "large")
        level += 1


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE,
                       bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed 64 bits) and component_id.

    Fingerprints link when they differ in at most ``radius`` bits; equal ones
    are one vertex.  component_id is the smallest doc_id reachable by links,
    itself included.  Null, empty and blank texts have fingerprint zero and
    link like any other.  Rows with one doc_id and different texts are judged
    each by its text; a null doc_id never names a component unless its rows
    are alone in it.  An empty table gives an empty result; extra columns are
    ignored.
    """
    rows = written(with_fingerprint(docs, shingle), "fingerprints")
    known = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    label = components(covering_links(known.select("fp"), radius, bucket)).withColumnRenamed("v", "fp")
    named = known.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return simhash_components(docs.select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ----------------------------------------------------------------- in SQL


def _mul(x: str, p: int) -> str:
    return f"((({x})::UHUGEINT * {p}::UHUGEINT) % m)::UBIGINT"


def _add(*xs: str) -> str:
    return "((" + " + ".join(f"({x})::UHUGEINT" for x in xs) + ") % m)::UBIGINT"


def _rol(x: str, k: int) -> str:
    return f"(((({x})::UHUGEINT * {1 << k}::UHUGEINT) % m) + (({x}) >> {64 - k}))::UBIGINT"


def _sql() -> str:
    """XXH64 from its rule (wrapping products in 128 bits), bits counted, all pairs of distinct fingerprints."""
    p1, p2, p3, p4, p5 = PRIMES
    u = lambda x: f"{x % (1 << 64)}::UBIGINT"
    once = lambda x: _mul(_rol(_mul(x, p2), 31), p1)
    stripe = lambda j: (f"list_reduce(list_prepend({u(SEED + (p1 + p2, p2, 0, -p1)[j])}, list_transform("  # noqa: E731
                        f"range(n // 32), lambda i: words[4 * i + {j + 1}])), lambda v, k: "
                        + _mul(_rol(_add("v", _mul("k", p2)), 31), p1) + ")")
    merged = "h"
    for j in range(4):
        merged = _add(_mul(f"xor({merged}, {once(f'v{j}')})", p1), u(p4))
    hex_word = "'0x' || " + " || ".join(f"substr(x, (16 * i + {15 - 2 * b})::INT, 2)" for b in range(8))
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k}::UHUGEINT ELSE 0 END" for k in range(64))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
bytes AS (
  SELECT g, strlen(g) AS n, hex(encode(g)) AS x, 18446744073709551616::UHUGEINT AS m FROM (SELECT DISTINCT g FROM grams)),
split AS (
  SELECT *, list_transform(range(n // 8), lambda i: ({hex_word})::UBIGINT) AS words FROM bytes),
long_ AS (
  SELECT *, {", ".join(f"CASE WHEN n >= 32 THEN {stripe(j)} END AS v{j}" for j in range(4))} FROM split),
joined AS (
  SELECT *, CASE WHEN n >= 32 THEN {_add(_rol("v0", 1), _rol("v1", 7), _rol("v2", 12), _rol("v3", 18))} END AS h
  FROM long_),
started AS (
  SELECT g, n, x, m, words, {_add(f"CASE WHEN n >= 32 THEN {merged} ELSE {u(SEED + p5)} END", "n")} AS h FROM joined),
eights AS (
  SELECT g, n, x, m, list_reduce(list_prepend(h, list_transform(range(n // 32 * 4, n // 8), lambda i: words[i + 1])),
    lambda a, k: {_add(_mul(_rol("xor(a, " + once("k") + ")", 27), p1), u(p4))}) AS h FROM started),
fours AS (
  SELECT g, n, x, m, CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rol("xor(h, " + _mul(
      "('0x' || " + " || ".join(f"substr(x, (n // 8 * 16 + {7 - 2 * b})::INT, 2)" for b in range(4)) + ")::UBIGINT",
      p1) + ")", 23), p2), u(p3))} ELSE h END AS h FROM eights),
ones AS (
  SELECT g, m, list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n),
    lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT)),
    lambda a, k: {_mul(_rol("xor(a, " + _mul("k", p5) + ")", 11), p1)}) AS h FROM fours),
mixed AS (SELECT g, m, {_mul("xor(h, h >> 33)", p2)} AS h FROM ones),
twice AS (SELECT g, {_mul("xor(h, h >> 29)", p3)} AS h FROM mixed),
hashed AS (SELECT g, xor(h, h >> 32) AS h FROM twice),
counted AS (SELECT doc_id, ({bits})::UBIGINT AS b FROM grams JOIN hashed USING (g) GROUP BY doc_id),
fps AS (
  SELECT d.doc_id, coalesce(b, 0::UBIGINT) AS fp
  FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id),
distinct_ AS (SELECT fp, min(doc_id) AS doc FROM fps GROUP BY fp),
links AS (
  SELECT a.fp AS x, b.fp AS y FROM distinct_ a JOIN distinct_ b ON a.fp <> b.fp
   AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= 3),
reach AS (SELECT fp AS v, fp AS r FROM distinct_ UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.v),
low AS (SELECT v, min(d.doc) AS component_id FROM reach JOIN distinct_ d ON d.fp = reach.r GROUP BY v)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM fps JOIN low ON v = fp
"""


ORACLE_SQL = _sql()
