"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are tokenised and cut into whole windows and a rest.  Lengths are
counted in steps of ``GRID`` tokens, rounded up, so the histogram has
``WINDOW / GRID`` bars whatever the corpus.  All ways to fill a window with at
most three lengths are the columns of a least-squares problem whose solution
says how often each is used; it is rounded down, made to fit the histogram,
and what is left is packed greedily, longest first.  Only the histogram comes
to the driver.  Each piece then finds its place by its rank in its bar.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, written
from .tokens import STEP_BYTES, default_path, word_tokenizer

WINDOW = 2048
GRID = 8
DEPTH = 3
END_ID = 1
# Rows that one (bar, part) cell of the ranking holds, about.
PART_ROWS = 200_000


def pieces(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: doc_id, start, length, ids_crc32, doc_tokens (and ids as little-endian uint32)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in by_bytes(batches, limit=STEP_BYTES):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            found, offsets = encode(batch.column("text"))
            raw, at = memoryview(found.tobytes()), (4 * offsets).tolist()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:]):
                ids = b"".join((raw[a:b], end))
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start:4 * (start + window)]
                    for k, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n, part)):
                        out[k].append(v)
            arrays = {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()}
            if not with_ids:
                arrays.pop("ids")
            yield pa.RecordBatch.from_pydict(arrays)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


# ------------------------------------------------------- the plan (driver)


def shallow_fillings(bars: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` bars (1 to ``bars``) that add up to ``bars``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int) -> None:
        if len(head) < depth:
            least = head[-1] if head else 1
            if rest >= least:
                found.append((*head, rest))
            for first in range(least, rest // 2 + 1):
                if rest - first >= first:
                    extend((*head, first), rest - first)

    extend((), bars)
    return sorted(set(found))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares, min |a x - b| with x >= 0, by active sets."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * n):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= small:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            own = a[:, at]
            gram = own.T @ own
            gram[np.diag_indices_from(gram)] *= 1 + 1e-10  # columns may depend on each other
            z = np.linalg.solve(gram, own.T @ b)
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = at[z <= 0]
            step = np.min(x[low] / np.maximum(x[low] - z[z <= 0], 1e-300))
            x[at] += step * (z - x[at])
            used[at[x[at] <= small * 1e-3]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def fill_plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """Windows for every piece of the histogram: (bar -> pieces in a window, number of such windows).

    ``histogram[k]`` counts the pieces of bar k (from 1); the plan uses each
    bar exactly that often.
    """
    bars = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []

    def use(parts: dict[int, int], times: int) -> None:
        if times > 0:
            plan.append((parts, times))
            for k, m in parts.items():
                left[k] -= m * times

    use({bars: 1}, int(left[bars]))  # whole windows need no partner
    ways = [w for w in shallow_fillings(bars, depth) if len(w) > 1 and all(left[k] for k in w)]
    if ways:
        columns = np.zeros((bars + 1, len(ways)))
        for j, way in enumerate(ways):
            for k in way:
                columns[k, j] += 1
        # Long pieces weigh more: a short one finds room anywhere.
        weight = np.sqrt(np.arange(bars + 1))[:, None]
        times = nnls(columns * weight, left * weight[:, 0], rounds=4 * bars)
        for j in np.argsort(-times, kind="stable"):
            parts = {k: ways[j].count(k) for k in set(ways[j])}
            use(parts, min(int(times[j]), *(int(left[k]) // m for k, m in parts.items())))
    while left.any():  # greedy: the longest piece left, and the longest that still fit
        parts: dict[int, int] = {}
        room = bars
        for k in range(int(np.flatnonzero(left).max()), 0, -1):
            if k <= room and left[k]:
                parts[k] = int(min(room // k, left[k]))
                room -= k * parts[k]
        use(parts, min(int(left[k]) // m for k, m in parts.items()))
    return plan


def _places(plan: list[tuple[dict[int, int], int]], bars: int) -> tuple[dict[int, np.ndarray], int]:
    """For each bar: rows (first rank, pieces in a window, first sequence), by rank; and the number of sequences."""
    at: dict[int, list] = {k: [] for k in range(1, bars + 1)}
    rank = np.zeros(bars + 1, np.int64)
    sequence = 0
    for parts, times in plan:
        for k, m in parts.items():
            at[k].append((int(rank[k]), m, sequence))
            rank[k] += m * times
        sequence += times
    return {k: np.array(v, np.int64).reshape(-1, 3) for k, v in at.items()}, sequence


# ----------------------------------------------------------------- packing


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, grid: int = GRID,
         with_ids: bool = False) -> DataFrame:
    """All documents as pieces of sequences of at most ``window`` tokens.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, the ids (little-endian uint32, as binary).  Each
    document's ids are followed by id 1, so a null or empty text is one
    token.  Repeated rows are packed each for itself; ties in the ranking are
    rows that agree in all these columns, so it doesn't matter which is first.
    An empty table gives no sequences.  Extra columns are ignored.
    """
    bars = window // grid
    cut = written(pieces(docs, path or default_path(), window, with_ids)
                  .withColumn("bar", F.expr(f"cast((length + {grid - 1}) div {grid} as int)")), "pieces")
    counts = {r["bar"]: r["n"] for r in cut.groupBy("bar").agg(F.count("*").alias("n")).collect()}  # `bars` rows
    histogram = np.zeros(bars + 1, np.int64)
    for k, n in counts.items():
        histogram[k] = n
    places, _ = _places(fill_plan(histogram), bars)

    # Ranks inside a bar: a part's rows follow those of the parts before it.
    parts = max(8, -(-int(histogram.sum()) // PART_ROWS))
    cut = cut.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id, start, ids_crc32), {parts}) as int)"))
    before = (cut.groupBy("bar", "part").agg(F.count("*").alias("n"))
              .select("bar", "part", (F.sum("n").over(Window.partitionBy("bar").orderBy("part")) - F.col("n"))
                      .alias("before")))
    order = Window.partitionBy("bar", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.join(before, ["bar", "part"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bar = batch.column("bar").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, slot = np.empty(len(bar), np.int64), np.empty(len(bar), np.int64)
            for k in np.unique(bar):
                own = np.flatnonzero(bar == k)
                first, m, base = places[int(k)].T
                way = np.searchsorted(first, rank[own], side="right") - 1
                step = rank[own] - first[way]
                sequence[own] = base[way] + step // m[way]
                slot[own] = step % m[way]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"])

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = ranked.select(*keep, "bar", "rank")
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("slot", T.LongType())])
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("bar"), "slot")
    return (ranked.mapInArrow(place, schema)
            .withColumn("offset", F.sum("length").over(inside) - F.col("length"))
            .select(*keep[:5], "sequence_id", "offset", *keep[5:]))
