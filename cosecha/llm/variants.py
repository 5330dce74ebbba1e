"""Spelling variant grouping with asymmetric q-chunks.

Of two words one edit apart the shorter contributes two disjoint chunks, its
halves; the other its positional grams of those lengths.  One edit spoils one
chunk at most, so the other is a gram of the longer word, within shift one of
its own place.  The lengths say which shift: a chunk in front of the edit
stays where it is, one behind it moves by the difference of the lengths.  So
chunk and gram meet by equality of (lengths, which half, characters), and
grams at other places, that no chunk could meet, are never made.  A pair that
meets is verified on what is left of the two words.

Endings and beginnings can be shared by any number of words.  Where a chunk
brings more than ``PAIRS`` pairs together, what is left of these words (again
one edit apart, if the words are) is cut into two chunks the same way, and so
on: every step fixes half of the rest, so pairs stay in proportion to rows,
and nothing is lost.  Words are counted by vectorised steps inside the scan;
everything behind the counts is DataFrame joins and aggregates.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_bytes, utf8, written

MIN_CHARS = 5
MIN_COUNT = 3
PAIRS = 4_096  # pairs that one chunk may bring together before what is left is cut again
STEP_BYTES = 4 << 20
DAMAGE = 97  # the registered query's misspellings: one run in so many

# ------------------------------------------------------------------- words

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LATIN = 0xC3  # UTF-8 of U+00C0 to U+00FF: this byte and one more


def runs(batch: pa.RecordBatch, column: str = "text") -> tuple[pa.Array, np.ndarray]:
    """The maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a batch's texts, A-Z lower-cased, and each one's row."""
    data, offsets = utf8(batch.column(column))
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.empty(0, np.int64)
    low = LOWER[data]
    lead = low == _LATIN
    letter = _LETTER[low] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:n]
    last[:-1] &= ~letter[1:] | edge[1:n]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    bounds = np.append(0, np.cumsum(size)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(low[letter].tobytes()))
    return found, np.searchsorted(offsets, start, side="right") - 1


_SHIFTED = 64  # bytes of the longest run whose checksum is joined by table
_tables: list[np.ndarray] = []


def _shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What CRC-32 values turn into behind ``size`` more bytes (up to ``_SHIFTED``), without those bytes' own part."""
    if not _tables:
        _tables.append(np.array([[[zlib.crc32(bytes(k), b << 8 * i) ^ zlib.crc32(bytes(k)) for b in range(256)]
                                  for i in range(4)] for k in range(_SHIFTED + 1)], np.uint32))
    table = _tables[0]
    out = np.zeros(len(crc), np.uint32)
    for i in range(4):
        out ^= table[size, i, crc >> np.uint32(8 * i) & np.uint32(255)]
    return out


def _checksums(ids: list, row: np.ndarray, distinct: list[bytes], which: np.ndarray) -> np.ndarray:
    """crc32 of ``<doc_id>:<run>`` of every run, from those of the two parts."""
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    tails = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    size = np.array([len(w) for w in distinct], np.int64)[which]
    out = _shift(heads[row], np.minimum(size, _SHIFTED)) ^ tails[which]
    for at in np.flatnonzero(size > _SHIFTED):
        out[at] = zlib.crc32(distinct[which[at]], int(heads[row[at]]))
    return out


def counts(docs: DataFrame, min_chars: int = MIN_CHARS, damage: int = 0) -> DataFrame:
    """(word, n): the lower-cased runs of at least ``min_chars`` code points and how often each occurs.

    With ``damage``, a run whose crc32 (with its doc_id) it divides loses one
    code point first, as the registered query wants.
    """

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=STEP_BYTES):
            found, row = runs(batch)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            which, names = coded.indices.to_numpy(), coded.dictionary
            spoilt: Counter[str] = Counter()
            if damage:
                distinct = names.cast(pa.large_binary()).to_pylist()
                crc = _checksums(batch.column("doc_id").to_pylist(), row, distinct, which)
                hit = crc % np.uint32(damage) == 0
                for w, h in zip(which[hit].tolist(), crc[hit].tolist()):
                    run = distinct[w].decode()
                    at = h % len(run)
                    spoilt[run[:at] + run[at + 1:]] += 1
                which = which[~hit]
            n = np.bincount(which, minlength=len(names))
            long = pa.array(n > 0)
            long = pc.and_(long, pc.greater_equal(pc.utf8_length(names), min_chars))
            yield pa.RecordBatch.from_arrays([names.filter(long).cast(pa.string()), pa.array(n).filter(long)],
                                             ["word", "n"])
            rest = [(w, k) for w, k in spoilt.items() if len(w) >= min_chars]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rest], pa.string()),
                                              pa.array([k for _, k in rest], pa.int64())], ["word", "n"])

    each = docs.select("doc_id", "text").mapInArrow(step, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------- pairs


def _cut(rows: DataFrame) -> DataFrame:
    """Two rows of each: a half that must be equal joins the key, the other is what is left.

    ``size`` is the length of the shorter word's rest, ``extra`` by how much
    the other word's is longer, ``side`` 0 for the shorter word and 1 for the
    longer; words of equal length are on both sides (2).
    """
    half = F.floor(F.col("size") / 2).cast("int")
    moved = F.when(F.col("side") == 1, F.col("extra")).otherwise(0)  # a gram behind the edit
    front = F.struct(F.lit("f").alias("at"), F.col("rest").substr(F.lit(1), half).alias("chunk"),
                     F.col("rest").substr(half + 1, F.length("rest")).alias("rest"),
                     (F.col("size") - half).alias("size"))
    back = F.struct(F.lit("b").alias("at"), F.col("rest").substr(half + moved + 1, F.length("rest")).alias("chunk"),
                    F.col("rest").substr(F.lit(1), half + moved).alias("rest"), half.alias("size"))
    cut = rows.select("word", "n", "key", "extra", "side", F.explode(F.array(front, back)).alias("c"))
    return cut.select("word", "n", F.concat_ws("|", "key", "c.at", "c.chunk").alias("key"), "extra", "side",
                      F.col("c.rest").alias("rest"), F.col("c.size").alias("size"))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): every two words (word, n) one inserted, deleted or replaced code point apart, once.

    Words must be distinct.
    """
    length = F.length("word")
    roles = F.array(*[F.struct(F.lit(extra).alias("extra"), F.lit(side).alias("side"), size.alias("size"))
                      for extra, side, size in ((0, 2, length), (1, 0, length), (1, 1, length - 1))])
    rows = words.select("word", "n", F.explode(roles).alias("r")).select(
        "word", "n", F.concat_ws("|", "r.extra", "r.size").alias("key"), "r.extra", "r.side",
        F.col("word").alias("rest"), "r.size")
    found = None
    while True:
        parts = _cut(rows)
        side = lambda k: F.sum(F.when(F.col("side") == k, 1).otherwise(0))
        met = (parts.groupBy("key").agg((side(2) * (side(2) - 1) / 2 + side(0) * side(1)).cast("long").alias("pairs"))
               .where("pairs > 0"))
        shared = written(parts.join(met, "key"), "chunks")
        # Below two characters a rest can be no shorter, and the alphabet bounds the pairs.
        few = (F.col("pairs") <= pairs) | (F.col("size") < 2)
        here = shared.where(few)
        left = here.where("side <> 1").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"),
                                              F.col("rest").alias("x"), "extra")
        right = here.where("side <> 0").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"),
                                               F.col("rest").alias("y"))
        links = (left.join(right, "key").where("(extra = 1 or a < b) and levenshtein(x, y, 1) = 1")
                 .select("a", "a_n", "b", "b_n"))
        links = written(links, "links")
        found = links if found is None else found.unionByName(links)
        rows = shared.where(~few).drop("pairs")
        if not rows.limit(1).count():
            return found.distinct()  # both chunks of a pair may be whole


def variants(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Per word (word, n): word, form, root, n, n_near and form_n.

    Two words are near if one inserted, deleted or replaced code point turns
    one into the other.  A word's form is its near word of largest n (ties:
    smallest in code-point order) if that is at least twice its own n; its
    root is where following forms ends, the word itself without a form.  Words
    must be distinct.
    """
    words = written(words.select("word", "n"), "words")
    links = written(near_pairs(words, pairs), "pairs")
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    formed = F.col("best").isNotNull() & (-F.col("best.m") >= 2 * F.col("n"))
    table = written(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    # Counts double along forms, so the ways are short; each round doubles how far a row has come.
    way = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                          F.col("next").isNotNull().alias("moved")), "roots")
        way = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            break
    return table.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                  "n_near", "form_n")


def group_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = 0,
                   pairs: int = PAIRS) -> DataFrame:
    """``variants`` of the words of ``docs`` with at least ``min_chars`` code points and ``min_count`` occurrences.

    Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the texts with A-Z
    lower-cased.  Null and empty texts have none; repeated rows count each; a
    null doc_id is written as nothing where ``damage`` uses it.  An empty
    table gives an empty result; extra columns are ignored.
    """
    return variants(counts(docs, min_chars, damage).where(F.col("n") >= min_count), pairs)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return group_variants(docs, damage=DAMAGE)


# Near words by another way: a replaced code point leaves equal words once its place is cut out of both, an inserted
# one leaves the shorter word once it is cut out of the longer.
ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k)),
    lambda i: ('0x' || substr(hex(encode(k)), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM (SELECT run, c, coalesce(doc_id::VARCHAR, '') || ':' || run AS k FROM runs), crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT)
      ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, min_by(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form,
    CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word AND w.next IS NULL
"""
