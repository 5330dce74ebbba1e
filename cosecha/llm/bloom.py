"""Bloom filters built by Spark tasks and merged segment by segment.

A filter has a fixed number of bits, whatever the input's size: that is the
bound of what is broadcast.  On more keys it fills up and lets more rows pass
as suspects; it never loses one, and its users confirm suspects exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 1 << 26  # 8 MB
HASHES = 4
SEGMENT = 1 << 19  # bits


def positions(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bits of each 64-bit key, one row for each hash function."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([((keys + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)])


def contains(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter holds (with some that it doesn't)."""
    found = np.ones(len(keys), bool)
    for at in positions(keys, len(packed) * 8):
        found &= (packed[at >> 3] >> (7 - (at & 7))) & 1 == 1
    return found


def _packed(rows: Iterable, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        out[r["segment"] * (SEGMENT // 8):][:len(part)] = part
    return out


def _segments(*filters: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    for k in range(len(filters[0]) // SEGMENT):
        cut = slice(k * SEGMENT, (k + 1) * SEGMENT)
        if filters[0][cut].any():
            yield k, [zlib.compress(np.packbits(f[cut]).tobytes(), 1) for f in filters]


def _few_tasks(df: DataFrame) -> DataFrame:
    """At most four filters for each core, so that merging them stays bounded."""
    return df.coalesce(4 * max(1, df.sparkSession.sparkContext.defaultParallelism))


def twice_seen(df: DataFrame, keys: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]],
               bits: int = BITS) -> np.ndarray:
    """Two filters over all keys: once seen and, of those, seen again; returns the second.

    ``keys`` turns a task's batches into arrays of 64-bit keys.  A key that
    occurs twice in a task's arrays, or in two tasks, is in the result; where
    filters of two tasks meet, bits set in both count as seen again.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for found in keys(batches):
            found, n = np.unique(found, return_counts=True)
            at = positions(found, bits)
            again = once[at].all(axis=0) | (n > 1)
            twice[at[:, again]] = True
            once[at] = True
        rows = list(_segments(once, twice))
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([k for k, _ in rows], pa.int32()),
            "once": pa.array([x[0] for _, x in rows], pa.binary()),
            "twice": pa.array([x[1] for _, x in rows], pa.binary())})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.zeros(SEGMENT // 8, np.uint8)
        for a, b in zip(part["once"], part["twice"]):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = once | a, twice | b | (once & a)
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "bits": [zlib.compress(twice.tobytes(), 1)]})

    parts = _few_tasks(df).mapInArrow(build, "segment int, once binary, twice binary")
    return _packed(parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect(), bits)


def seen(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A filter of the values of a bigint column (nulls are left out)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(bits, bool)
        for batch in batches:
            once[positions(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64), bits)] = True
        rows = list(_segments(once))
        yield pa.RecordBatch.from_pydict({"segment": pa.array([k for k, _ in rows], pa.int32()),
                                          "bits": pa.array([x[0] for _, x in rows], pa.binary())})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(SEGMENT // 8, np.uint8)
        for a in part["bits"]:
            once = once | np.frombuffer(zlib.decompress(a), np.uint8)
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "bits": [zlib.compress(once.tobytes(), 1)]})

    schema = "segment int, bits binary"
    parts = _few_tasks(df.select(column)).mapInArrow(build, schema)
    return _packed(parts.groupBy("segment").applyInPandas(merge, schema).collect(), bits)
