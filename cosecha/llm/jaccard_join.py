"""N-gram Jaccard join with PartEnum signatures.

Set sizes fall into bands whose ends differ by less than the threshold, so two
sets that link lie in one band or in neighbours.  For each such pair of bands,
linked sets differ in at most k elements.  The element domain is dealt into
n1 parts of n2 subparts; among n1 parts one holds at most k2 differences, so
some choice of n2 - k2 of its subparts holds none: the two sets share the
signature of that choice.  Where a choice holds few elements on average, there
are more parts than that needs, and the empty choices, which strangers share,
are left out but for sets with more of them than spare parts.  Only signatures
(64 bits) are shuffled, combined map-side.  Candidate pairs are first judged by
the sets' sizes and sketches, which bound the intersection from above; sets are
shuffled for the pairs that may link, and every link is verified by exact set
sizes.

Equal sets have equal 64-bit set keys, and a vertex of the join is such a key:
thousands of copies are one vertex.  Every member of a signature is compared
with the signature's first, which joins most families of near copies at one
comparison a member.  Where a signature still holds members of different
components, all its pairs of different components are judged by their sketches,
in blocks, and only what may link is emitted and verified.  No pair whose link
would join two components is left untested; pairs inside a component are mostly
not compared, so links are not counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_bytes, mix, utf8, words, written
from .graph import components

SHINGLE = 3
BLOCK = 1_000  # members of a signature whose sketches are compared together
GROUP_ROWS = 20_000  # members that one group of blocks holds, about
PERCENT = 90  # link: 100 * intersection >= PERCENT * union

_SALTS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D)]


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a batch.

    A text of fewer words than a shingle is one shingle of all its words; one
    without words is the empty set.
    """
    hashes, row, _, _ = words(*utf8(batch.column("text")))
    ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
    powers = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(size)]
    runs = hashes[:max(0, len(hashes) - size + 1)] * powers[0]
    for k in range(1, size):
        runs = runs + hashes[k:len(hashes) - size + 1 + k] * powers[k]
    runs = mix(runs)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        elif b > a:
            short = hashes[a:b] * np.array(powers[:b - a], np.uint64)
            yield mix((short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) ^ _SALTS[3])
        else:
            yield np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> np.uint64:
    """Equal sets have equal keys; others differ but for a chance of 2**-64 a pair."""
    return mix(mix(s ^ _SALTS[0]).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _SALTS[1])[0]


# ------------------------------------------------------------- signatures


@lru_cache(maxsize=None)
def band(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """Number and upper end of the band of a set size.  Ends follow from the threshold alone."""
    low, i = 1, 0
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return i, high
        low, i = high + 1, i + 1


@lru_cache(maxsize=None)
def _band_ends(upto: int, percent: int) -> tuple[int, ...]:
    ends, low = [], 1
    while low <= upto:
        ends.append(max(low, low * 100 // percent))
        low = ends[-1] + 1
    return tuple(ends)


def scheme(high: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of at most ``high`` elements: (n1 - spare) * (k2 + 1) > k."""
    # |x| + |y| <= 2 high; a difference of d elements leaves (sum - d) / (sum + d) >= percent / 100.
    k = 2 * high * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 0
    if k == 2:
        return 1, 4, 2, 0
    n1 = k // 2 + 1
    spare = 1 + n1 // 16 if 2 * high < 27 * n1 else 0  # under nine elements in a choice
    return n1 + spare, 3, 1, spare


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The 64-bit signatures of a set, for its band with the one below and with the one above."""
    if not len(s):
        return np.empty(0, np.uint64)
    ends = _band_ends(1 << (2 * len(s)).bit_length(), percent)
    i = int(np.searchsorted(ends, len(s)))
    out = []
    for pair, high in ((i, ends[i]), (i + 1, ends[i + 1])):  # instance j joins the bands j - 1 and j
        n1, n2, k2, spare = scheme(high, percent)
        seed = np.array([pair], np.uint64) * _SALTS[2]
        deal = mix(s ^ seed)  # the halves choose the part and the subpart, the whole is summed up
        cell = ((deal >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)) * np.uint64(n2) \
            + ((deal & np.uint64(0xFFFFFFFF)) * np.uint64(n2) >> np.uint64(32))
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell.view(np.int64), deal)
        sums = sums.reshape(n1, n2)
        place = np.arange(n1, dtype=np.uint64) * np.uint64(16)
        if k2 == 2:  # two of four subparts
            chosen = [(sums[:, a] + sums[:, b], np.uint64(4 * a + b)) for a in range(n2) for b in range(a)]
        elif k2 == 1:  # all but one subpart
            whole = sums.sum(axis=1, dtype=np.uint64)
            chosen = [(whole - sums[:, a], np.uint64(a)) for a in range(n2)]
            held = np.bincount(cell.view(np.int64), minlength=n1 * n2).reshape(n1, n2)
            filled = held.sum(axis=1, keepdims=True) > held
            # At least 1 + spare parts hold at most one difference; one of them has no empty choice here.
            if np.count_nonzero(~filled.all(axis=1)) <= spare:
                out += [mix(v ^ mix(place + which + seed))[filled[:, a]] for a, (v, which) in enumerate(chosen)]
                continue
        else:
            chosen = [(sums[:, 0], np.uint64(0))]
        out += [mix(v ^ mix(place + which + seed)) for v, which in chosen]
    return np.concatenate(out)


# ---------------------------------------------------------------- sketches


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's elements by their leading bits, two to four a bin; nothing if a count exceeds a byte."""
    bits = max(4, (len(s) // 4).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(n: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """left x right: whether the sets can link, by their sizes and the most that their sketches let them share."""
    x, y = n[left][:, None], n[right]
    possible = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    width = min((len(v) for v in sketches if v), default=0)
    if not width:
        return possible
    known = np.array([len(v) > 0 for v in sketches])
    counts = np.zeros((len(sketches), width), np.int32)
    for i, v in enumerate(sketches):  # longer ones are folded: their bins are those of the shorter, divided
        if v:
            counts[i] = np.frombuffer(v, np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int32)
    of_right = counts[right]
    for k, i in enumerate(left):
        if known[i] and possible[k].any():
            most = np.minimum(counts[i], of_right).sum(axis=1, dtype=np.int64)
            possible[k] &= (100 * most >= percent * (n[i] + n[right] - most)) | ~known[right]
    return possible


# -------------------------------------------------------------------- join


def _scan(docs: DataFrame, emit: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield emit(batch)

    return docs.mapInArrow(run, schema)


def _int64(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _signature_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, key) of every text's signatures."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs, keys = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for s in shingle_sets(batch, shingle):
            own = signatures(s, percent)
            sigs.append(own)
            keys.append(np.full(len(own), set_key(s) if len(own) else 0, np.uint64))
        return pa.RecordBatch.from_pydict({"sig": _int64(np.concatenate(sigs)), "key": _int64(np.concatenate(keys))})

    return _scan(docs, emit, "sig long, key long")


def _rows_with_shared(docs: DataFrame, shingle: int, percent: int, wanted) -> DataFrame:
    """(doc_id, n_shingles, key, sigs, sketch): every row, with its signatures that the filter holds, and its sketch
    if it has any; no key for an empty set."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = np.frombuffer(wanted.value, np.uint8)
        n, keys, sigs, sketches = [], [], [], []
        for s in shingle_sets(batch, shingle):
            own = signatures(s, percent)
            own = own[bloom.contains(packed, own)] if len(own) else own
            n.append(len(s))
            keys.append(set_key(s))
            sigs.append(own.view(np.int64))
            sketches.append(sketch(s) if len(own) else None)
        n = np.array(n, np.int64)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array(n),
            "key": pa.array(np.array(keys, np.uint64).view(np.int64), mask=n == 0),
            "sigs": pa.array(sigs, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())})

    return _scan(docs, emit, "doc_id long, n_shingles long, key long, sigs array<long>, sketch binary")


def _sets_of(docs: DataFrame, vertices: DataFrame, shingle: int) -> DataFrame:
    """(key, hashes) for the vertices: their sorted sets as binary."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bloom.seen(vertices, "key").tobytes())

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = np.frombuffer(wanted.value, np.uint8)
        sets = [s for s in shingle_sets(batch, shingle) if len(s)]
        keys = np.array([set_key(s) for s in sets], np.uint64)
        at = np.flatnonzero(bloom.contains(packed, keys)) if len(keys) else []
        return pa.RecordBatch.from_pydict({"key": _int64(keys[at] if len(keys) else keys),
                                           "hashes": pa.array([sets[i].tobytes() for i in at], pa.binary())})

    found = _scan(docs, emit, "key long, hashes binary").join(vertices, "key", "left_semi")
    return written(found.groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")


def _possible(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can link by the vertices' sizes and sketches."""
    x = vertices.select(F.col("key").alias("a"), "n", F.col("sketch").alias("x"))
    y = vertices.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = np.array([0]), np.array([1])
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            can = [bool(may_link(np.array([n[i], m[i]]), [x[i], y[i]], one, other, percent)[0, 0])
                   for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(can, pa.bool_())) for c in ("a", "b")],
                                             ["a", "b"])

    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    merged = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in batch.columns[:2]],
                                             ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def _labels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(key, component) of every vertex."""
    return written(vertices.join(components(links).withColumnRenamed("v", "key"), "key", "left").select(
        "key", F.coalesce("component", "key").alias("component")), "labels")


def _possible_in_signatures(here: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components inside each signature that can link by sizes and sketches.

    ``here`` has sig, key and component.  A signature's members are dealt into
    blocks of about ``BLOCK``; pairs of blocks are compared many in a group,
    and only pairs that can link leave it.
    """
    size = here.groupBy("sig").agg(F.count("*").alias("m"), F.min("component").alias("lo"),
                                   F.max("component").alias("hi")).where("lo <> hi")
    size = written(size.select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), "m"), "open")
    total = size.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP_ROWS))
    rows = (here.join(size.drop("m"), "sig").join(vertices, "key")
            .withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("grp", F.expr(f"cast(pmod(xxhash64(sig, i, j), {groups}) as int)"))
            .select("grp", "sig", "i", "j", "own", "key", "component", "n", "sketch"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sig, i, j, own, key, component, n = (
            part[c].to_numpy() for c in ("sig", "i", "j", "own", "key", "component", "n"))
        sketches = part["sketch"].tolist()
        order = np.lexsort((j, i, sig))
        a, b, c = sig[order], i[order], j[order]
        heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        found = []
        for lo, hi in zip(heads, np.append(heads[1:], len(order))):
            unit = order[lo:hi]
            left, right = np.flatnonzero(own[unit] == b[lo]), np.flatnonzero(own[unit] == c[lo])
            can = may_link(n[unit], [sketches[k] for k in unit], left, right, percent)
            x, y = np.nonzero(can & (component[unit][left][:, None] != component[unit][right]))
            x, y = key[unit[left[x]]], key[unit[right[y]]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b"]).drop_duplicates()

    return rows.groupBy("grp").applyInPandas(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets; component_id is the smallest doc_id reachable by links,
    itself included.  Null texts and texts without words have
    the empty set and link with nothing; rows with one doc_id and different
    texts are judged each by its text; a null doc_id never names a component
    unless its rows are alone in it.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Signatures that different sets share; min and max combine map-side.
    shared = (_signature_rows(docs, shingle, percent).groupBy("sig")
              .agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("sig", "low"))
    shared = written(shared, "shared")
    wanted = spark.sparkContext.broadcast(bloom.seen(shared, "sig").tobytes())
    rows = written(_rows_with_shared(docs, shingle, percent, wanted), "rows")
    members = (rows.where("key is not null").select("key", F.explode("sigs").alias("sig")).distinct()
               .join(shared, "sig"))
    members = written(members, "members")  # sig, key, low: the signature's first member
    vertices = written(rows.where("sketch is not null").groupBy("key")
                       .agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
                       .join(members.select("key").distinct(), "key"), "vertices")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link."""
        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        return written(_verified(pairs, _sets_of(docs, ends, shingle), percent), "links")

    # First every member against its signature's first.
    stars = members.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    links = linked(_possible(stars, vertices, percent))
    label = _labels(vertices.select("key"), links)
    # Then all of different components that signatures still hold together.
    here = members.select("sig", "key").join(label, "key")
    more = linked(_possible_in_signatures(here, vertices, percent))
    links = links.unionByName(more).distinct()
    label = _labels(vertices.select("key"), links)

    known = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"))
    named = (known.join(label, "key", "left").withColumn("component", F.coalesce("component", "key")))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    return rows.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows without a doc_id all stay."""
    copies = (jaccard_components(docs, percent, shingle).groupBy("doc_id")
              .agg(F.min("component_id").alias("_first")).where("_first < doc_id").select("doc_id"))
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS gs
    FROM w WHERE len(w) > 0), unnest(gs) t(g)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.v)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.r) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.v = d.doc_id GROUP BY d.doc_id
"""


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
