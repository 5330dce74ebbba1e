"""Helpers shared by the operators: tables, scratch tables and text batches."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cosecha.session import checkpoint_dir

# Bytes of text that one vectorised step takes at a time.  A longer document
# is one step of its own: texts are never cut.
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1_000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is shipped as usual (``--py-files``); the path
    then names nothing there and does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    importable(spark)
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The lineage ends there: a lost executor costs a re-read, never a re-run,
    and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, … that ``df`` has no column of (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand texts to Python workers in batches of at most ``rows`` rows from now on.

    Such a batch stands in both processes at once, outside the JVM's heap; the
    default of 10 000 rows of long texts is most of a small executor's room.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def by_bytes(batches: Iterable[pa.RecordBatch], text: str = "text",
             limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut between rows so that each holds about ``limit`` text bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        slot = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(slot)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and each row's offsets (null: no bytes)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- hashing

_ODD = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.up) < n:
            step = np.uint64(pow(self.base, len(self.up), 1 << 64))
            self.up = np.concatenate([self.up, self.up * step])
        return self.up[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` reads any span's hash off them."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUES[data] * UP.upto(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    down = DOWN.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lowered texts: hash, row, start and end of each."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    low = LOWER[data]
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return span_hash(prefix_hash(low), start, end), row, start, end
