"""Line dedup with two Bloom filters, for once-seen and twice-seen line hashes.

The first pass over the texts builds both filters; the second sends only the
keys that the twice-seen filter suspects through a shuffle, where their
documents are counted exactly and the first occurrence is chosen.  Lines that
occur once, the bulk of any corpus, never leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_bytes, give_back, short_batches, written

BLANKS = b" \t\n\r\x0b\x0c"
MIN_CHARS = 10


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped of blanks and lower-cased (A-Z); None if it is too short to count."""
    key = line.strip(BLANKS).lower()
    n = len(key)
    if n < min_chars or n < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def _lines(batch: pa.RecordBatch, column: str) -> Iterator[list[bytes]]:
    for text in pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist():
        yield text.split(b"\n")


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = bloom.BITS,
                counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")) -> DataFrame:
    """The columns of ``docs`` with repeated lines cut from ``text``, and the numbers of lines and of dropped lines.

    ``counts`` names these two, which ``docs`` must not have; None leaves them out.

    A key (see ``line_key``) found in at least two documents keeps its lines
    only in the smallest doc_id that holds it, however often it stands there.
    Null and empty texts are one empty line; a null text stays null.  Rows
    with one doc_id are one document to the count, and each is cut.  Rows
    without a doc_id are neither counted nor cut.  A document may lose all its
    lines; its text is then empty.  Other columns pass through.
    """
    spark = docs.sparkSession
    short_batches(spark)
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in by_bytes(batches):
            yield np.fromiter(
                (xxhash.xxh64_intdigest(k) for lines in _lines(batch, "text")
                 for k in {line_key(x, min_chars) for x in lines} if k is not None), np.uint64)
        give_back()

    suspected = spark.sparkContext.broadcast(bloom.twice_seen(named.select("text"), hashes, bits).tobytes())

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(suspected.value, np.uint8)
        for batch in by_bytes(batches):
            ids, keys = [], []
            for doc, lines in zip(batch.column("doc_id").to_pylist(), _lines(batch, "text")):
                own = {line_key(x, min_chars) for x in lines} - {None}
                ids += [doc] * len(own)
                keys += own
            if keys:
                held = bloom.contains(packed, np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i] for i in at], pa.int64()),
                                                  "key": pa.array([_digest(keys[i]) for i in at], pa.binary())})
        give_back()

    pairs = written(named.mapInArrow(suspects, "doc_id long, key binary"), "lines")
    # min and max combine map-side: a line that stands everywhere costs one row a task.
    repeated = (pairs.groupBy("key").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"))
                .where("keep < last").select("key", "keep"))
    drops = (pairs.join(repeated, "key").where("doc_id <> keep")
             .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))  # a document's own lines at most
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id"), F.col("text"), F.struct(*rest or [F.lit(0).alias("none")]).alias("rest"))
    joined = rows.join(drops.withColumnRenamed("doc_id", "to").hint("shuffle_hash"),
                       F.col("doc_id") == F.col("to"), "left").select("doc_id", "text", "rest", "keys")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts, total, dropped = [], [], []
            for lines, null, keys in zip(_lines(batch, "text"), pc.is_null(batch.column("text")).to_pylist(),
                                         batch.column("keys").to_pylist()):
                kept = lines
                if keys:
                    gone = set(keys)
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in gone]
                texts.append(None if null else b"\n".join(kept))
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("rest"),
                 pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                ["doc_id", "text", "rest", "_n_lines", "_n_dropped"])
        give_back()

    schema = joined.select("doc_id", "text", "rest").schema.add("_n_lines", "long").add("_n_dropped", "long")
    out = joined.mapInArrow(cut, schema)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns],
                      *[F.col(own).alias(name) for own, name in zip(("_n_lines", "_n_dropped"), counts or ())])


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
repeated AS (
  SELECT key, min(doc_id) AS keep FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.*, r.keep IS NOT NULL AND l.doc_id <> r.keep AS gone FROM lines l LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
