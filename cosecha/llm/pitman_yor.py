"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are words and one end of text.  A token's context is the whole token
before it, or the text's begin.  Each context is a restaurant whose parent is
the restaurant of all tokens, whose base is uniform over the vocabulary and
one unknown token:

    P_u(w) = (c_uw - d1 t_uw + (a1 + d1 t_u.) P_0(w)) / (a1 + c_u.)
    P_0(w) = (c_0w - d0 t_0w + (a0 + d0 t_0.) / (V + 1)) / (a0 + c_0.)

with c_0w the tables that the contexts have for w.  Gibbs sweeps reseat the
customers of every dish one after another, given the totals of the others that
the sweep before left; the score averages the predictive probabilities of the
kept sweeps.

Texts are read in chunks.  Of each chunk its different pairs of words go once
to the part of the second word, with the documents they stand in, so a word's
dishes and its place in the parent are in one part; those of the frequent words
are spread over the parts by context, and the driver adds up their tables (one
number for each).  A restaurant's dishes lie in many parts: after each sweep
the parts send its tables to the part that adds them up, and get the sum back.
Draws are seeded by word and context, so no result depends on the road.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import by_bytes, give_back, mix, scratch, short_batches, utf8, words, written

FREQUENT = 1024  # words whose dishes are spread over the parts
CODED = 65_536  # words that are sent as numbers, all others as hashes
PART_TOKENS = 2_500_000  # tokens that one part holds, about
FLUSH = 2_000_000  # tokens of a chunk
SWEEPS, BURN_IN = 5, 2
STRENGTH = 1.0  # a0 and a1
END = np.uint64(0x9AE16A3B2F90404F)  # the end of text, as a word hash
BEGIN = np.uint64(0xC3A5C85C97CB3127)  # the begin of text, as a context
PSEUDO = 0.1


# ------------------------------------------------------------------- tokens


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context (the hash of the token before) and row of every token of a batch, ends included (after all words)."""
    data, offsets = utf8(batch.column("text"))
    word, row, _, _ = words(data, offsets)
    n = batch.num_rows
    context = np.full(len(word), BEGIN)
    inside = np.flatnonzero(row[1:] == row[:-1]) + 1
    context[inside] = word[inside - 1]
    closing = np.full(n, BEGIN)
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else row
    closing[row[last]] = word[last]
    return (np.concatenate([word, np.full(n, END)]), np.concatenate([context, closing]),
            np.concatenate([row, np.arange(n)]))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", toxicity.held_out(folds=10).alias("out"))


def _merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    heads = _heads(h)
    return h[heads], np.add.reduceat(n, heads) if len(heads) else n


def frequent_words(rows: DataFrame, size: int = CODED) -> tuple[np.ndarray, int]:
    """About the ``size`` commonest words (hashes, END first, then by falling counts), and the number of all tokens."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in by_bytes(batches):
            h, n = np.unique(tokens(batch)[0], return_counts=True)
            total += int(n.sum())
            known, times = _merged(np.concatenate([known, h]), np.concatenate([times, n]))
            if len(known) > 16 * size:
                top = np.sort(np.argpartition(-times, 8 * size)[:8 * size])
                known, times = known[top], times[top]
        if len(known) > 2 * size:
            top = np.argpartition(-times, 2 * size)[:2 * size]
            known, times = known[top], times[top]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(known.view(np.int64)), "n": pa.array(times),
            "total": pa.array(np.r_[total, np.zeros(max(0, len(known) - 1), np.int64)][:len(known)])})

    seen = written(rows.mapInArrow(count, "word long, n long, total long"), "frequent")
    total = seen.agg(F.sum("total")).first()[0] or 0
    top = seen.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size - 1).collect()
    found = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    return np.append(END, found[found != END]), total


def _place(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, new]) if len(keys[0]) else np.empty(0, np.int64)


# ------------------------------------------------------------------- packing


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers from 0 up, or floats: by byte planes, compressed.  Ascending ones are packed as differences."""
    out = []
    for x in arrays:
        real = x.dtype == np.float64
        x = x.view(np.uint64) if real else x.astype(np.uint64)
        rising = bool(not real and len(x) > 1 and (x[1:] >= x[:-1]).all())
        if rising:
            x = np.diff(x, prepend=np.uint64(0))
        size = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()
        body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out.append(bytes([size, rising, real]) + len(x).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``_pack``: int64 (hashes: the same bits), or float64."""
    got, at = [], 0
    while at < len(blob):
        size, rising, real = blob[at:at + 3]
        n, length = (int.from_bytes(blob[at + k:at + k + 8], "little") for k in (3, 11))
        at += 19
        x = np.zeros((n, 8), np.uint8)
        if size and n:
            planes = pa.decompress(blob[at:at + length], size * n, codec="zstd", asbytes=True)
            x[:, :size] = np.frombuffer(planes, np.uint8).reshape(size, n).T
        at += length
        x = x.reshape(-1).view(np.uint64)
        got.append((np.cumsum(x, dtype=np.uint64) if rising else x).view(np.float64 if real else np.int64))
    return got


def _coded(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes as numbers of the table's words, and the others as they are."""
    at = _place(table, x)
    return at >= 0, at[at >= 0], x[at < 0]


def _decoded(known: np.ndarray, number: np.ndarray, other: np.ndarray, table: np.ndarray) -> np.ndarray:
    x = np.empty(len(known), np.uint64)
    x[known == 1], x[known == 0] = table[number], other.view(np.uint64)
    return x


class Words:
    """The frequent words, as every task needs them: those sent as numbers, and the first ones, which are spread."""

    def __init__(self, spark: SparkSession, found: np.ndarray, size: int) -> None:
        self.size = min(size, len(found))
        self._shared = spark.sparkContext.broadcast((np.sort(found), np.sort(found[:size])))

    @property
    def coded(self) -> np.ndarray:
        return self._shared.value[0]

    @property
    def heavy(self) -> np.ndarray:
        return self._shared.value[1]


def _bucketed(df: DataFrame, parts: int, name: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``part``, and read back: no later shuffle by part."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = f"llm_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(4 * parts, "part").option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


# ------------------------------------------------------------------ counting


def _chunks(rows: DataFrame, frequent: Words, parts: int) -> DataFrame:
    """(part, chunk, pairs, places): the different pairs of each chunk by part; and, with a part below 0, its rows."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        made = held = docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, docs
            chunk = TaskContext.get().partitionId() << 24 | made
            word, context, doc = (np.concatenate(x) for x in list(zip(*kept))[:3])
            ids = pa.concat_arrays([k[3] for k in kept])
            out = np.concatenate([k[4] for k in kept])
            null = ids.is_null().to_numpy(zero_copy_only=False)
            info = _pack(ids.fill_null(0).to_numpy(zero_copy_only=False), null, out,
                         np.bincount(doc, minlength=len(out)))
            kept.clear()
            made, held, docs = made + 1, 0, 0
            part = mix(word)
            spread = _place(frequent.heavy, word) >= 0
            part[spread] = mix(word[spread] ^ mix(context[spread]))
            part = (part % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((context, word, part))
            word, context, doc, part = word[order], context[order], doc[order], part[order]
            del order, spread
            used, pairs, places = [-1 - chunk % 2**30], [info], [b""]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                w, u, d = (x[cuts[p]:cuts[p + 1]] for x in (word, context, doc))
                heads = _heads(w, u)
                n = np.add.reduceat((~out[d]).astype(np.int64), heads)
                first = _heads(w[heads])
                known, index = np.unique(u[heads], return_inverse=True)
                used.append(int(p))
                pairs.append(_pack(*_coded(w[heads][first], frequent.coded), np.diff(np.append(first, len(heads))),
                                   *_coded(known, frequent.coded), index, n))
                places.append(_pack(np.diff(np.append(heads, len(w))), d))
                if len(used) == 16:
                    yield batch_of(chunk, used, pairs, places)
                    used, pairs, places = [], [], []
            yield batch_of(chunk, used, pairs, places)

        def batch_of(chunk: int, used: list, pairs: list, places: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array(used, pa.int32()), "chunk": pa.array([chunk] * len(used), pa.int64()),
                "pairs": pa.array(pairs, pa.binary()), "places": pa.array(places, pa.binary())})

        for batch in by_bytes(batches):
            word, context, row = tokens(batch)
            out = batch.column("out").to_numpy(zero_copy_only=False).astype(bool)
            kept.append((word, context, (row + docs).astype(np.uint32), batch.column("doc_id"), out))
            held, docs = held + len(word), docs + batch.num_rows
            if held >= FLUSH:
                yield from flush()
        if kept:
            yield from flush()
        give_back()

    return rows.mapInArrow(emit, "part int, chunk long, pairs binary, places binary")


class Cells:
    """A part's pairs of words over all chunks: the dishes, sorted by word and context."""

    def __init__(self, blobs: Iterable[bytes], frequent: Words) -> None:
        word, context, n = [], [], []
        for blob in blobs:
            *coded, run, u, v, w, index, c = _unpack(blob)
            word.append(np.repeat(_decoded(*coded, frequent.coded), run))
            context.append(_decoded(u, v, w, frequent.coded)[index])
            n.append(c.astype(np.int32))
        self.sizes = [len(x) for x in n]  # pairs of each chunk
        word, context, n = (np.concatenate(x) for x in (word, context, n))
        order = np.lexsort((context, word))
        word, context = word[order], context[order]
        heads = _heads(word, context)
        self.of = np.empty(len(order), np.int32)  # the dish of each chunk's pairs
        self.of[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.append(heads, len(order))))
        self.c = np.add.reduceat(n[order].astype(np.int64), heads)  # training customers
        del order, n
        word, context = word[heads], context[heads]
        first = _heads(word)
        self.words, self.w = word[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
        self.contexts, self.u = np.unique(context, return_inverse=True)
        self.total = np.add.reduceat(self.c, first)  # training customers of each word
        self.many = np.flatnonzero(self.c > 1)  # dishes that a sweep reseats; others have a table a customer
        count = lambda of, x, size: np.bincount(of[x], minlength=size)
        self.single = count(self.w, self.c == 1, len(self.words))
        self.rest = count(self.u, self.c == 1, len(self.contexts))
        self.customers = np.bincount(self.u, weights=self.c, minlength=len(self.contexts)).astype(np.int64)
        self.busy = np.unique(self.u[self.many])  # contexts of those dishes
        self.heavy = _place(frequent.heavy, self.words)  # index among the frequent words, or -1
        # Words whose place in the parent a sweep reseats, here or (frequent ones) on the driver.
        self.kept = np.flatnonzero((self.total > 1) | (self.heavy >= 0) & (self.total > 0))
        self.of_many = np.searchsorted(self.kept, self.w[self.many])

    def seated(self, t: np.ndarray) -> np.ndarray:
        """The kept words' customers in the parent: the tables of all their dishes."""
        return self.single[self.kept] + np.bincount(self.of_many, weights=t, minlength=len(self.kept)).astype(np.int64)


def _slices(part: int, kind: int, sums: int, frequent: Words, contexts: np.ndarray, *values: np.ndarray) -> list[dict]:
    """Rows that send a part's numbers of each (sorted) context to the part that adds them up."""
    edges = np.array([-(-(q << 64) // sums) for q in range(1, sums)], np.uint64)
    cuts = np.r_[0, np.searchsorted(contexts, edges), len(contexts)]
    return [{"part": part, "kind": kind, "other": q, "numbers": [],
             "blob": _pack(*_coded(contexts[a:b], frequent.coded), *(v[a:b] for v in values))}
            for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _received(blobs: Iterable[bytes], frequent: Words) -> tuple[list[np.ndarray], int, list[list[np.ndarray]]]:
    """For each sender the indices of its contexts, the number of different ones, and its numbers."""
    rows = [_unpack(b) for b in blobs]
    contexts = [_decoded(*r[:3], frequent.coded) for r in rows]
    names, index = np.unique(np.concatenate(contexts), return_inverse=True)
    return np.split(index, np.cumsum([len(x) for x in contexts])[:-1]), len(names), [r[3:] for r in rows]


def _added(sent: DataFrame, frequent: Words) -> DataFrame:
    """The sums of what the parts sent, in each sender's order; of REST rows only for the contexts it marked."""

    def add(got: pd.DataFrame) -> pd.DataFrame:
        give_back()
        at, n, rows = _received(got["blob"], frequent)
        total = np.zeros(n, np.int64)
        for i, r in zip(at, rows):  # a sender's contexts are all different
            total[i] += r[0]
        return got[["part", "kind", "other"]].assign(
            blob=[_pack(total[i[r[1].astype(bool)]] if len(r) > 1 else total[i]) for i, r in zip(at, rows)])

    return sent.groupBy("other").applyInPandas(add, _MESSAGES)


def _last_sums(sent: DataFrame, frequent: Words, sweeps: list[int]) -> DataFrame:
    """For every context of a part its customers, and its tables in each kept sweep, over all parts."""

    def add(got: pd.DataFrame) -> pd.DataFrame:
        give_back()
        at, n, rows = _received(got["blob"], frequent)
        rest = (got["kind"] == REST).to_numpy()
        sums = np.zeros((1 + len(sweeps), n), np.int64)
        for r, i, asks, number in zip(rows, at, rest, got["sweep"]):
            if asks:
                sums[0, i] += r[2]
                sums[1:, i] += r[0]
            else:
                sums[1 + sweeps.index(number), i] += r[0]
        return got.loc[rest, ["part", "kind", "other"]].assign(
            blob=[_pack(*sums[:, i]) for i, asks in zip(at, rest) if asks])

    return sent.groupBy("other").applyInPandas(add, _MESSAGES)


def _answers(rows: pd.DataFrame, kind: int, columns: int = 1) -> list[np.ndarray]:
    """One part's answers of a kind, put together."""
    own = rows[rows["kind"] == kind].sort_values("other")
    got = [_unpack(b) for b in own["blob"]] or [[np.empty(0, np.int64)] * columns]
    return [np.concatenate(x) for x in zip(*got)]


# -------------------------------------------------------------------- seating

FIXED, STATE, SEND, REST = range(4)  # kinds of rows: a part's fixed arrays, its seating, tables and what never changes
_MESSAGES = "part int, kind int, other int, blob binary"
_ROWS = _MESSAGES + ", numbers array<bigint>"  # numbers: what the driver adds up
_COUNTS = ("vocabulary", "customers", "cell1", "cell2", "word1", "word2")


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """One random number in (0, 1) for each key."""
    odd = np.uint64(0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1)
    return ((mix(key + odd) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(customers: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator | None = None,
         each: np.ndarray | float = 0.0, key: np.ndarray | None = None) -> np.ndarray:
    """Tables that each dish's customers take, seated one after another.

    A customer takes a new table with weight ``strength`` + ``each`` * tables
    and an old one with weight customers - discount * tables.  The first weight's
    share only falls until the next new table, so the customers up to it are
    passed over at once: a candidate is drawn at the present share and taken with
    the odds of its own share to that, which is the same law.  Draws come from
    ``rng``, or are made from each dish's ``key``.
    """
    t = (customers > 0).astype(np.int64)
    n = t.copy()  # seated so far
    each = np.broadcast_to(np.asarray(each, np.float64), customers.shape)
    at, step = np.flatnonzero(customers > 1), 0
    while len(at):
        draw = [rng.random(len(at)) if key is None else _uniform(key[at], 2 * step + k) for k in (0, 1)]
        new = strength[at] + each[at] * t[at]
        old = n[at] - discount * t[at]
        share = new / (new + old)
        passed = np.minimum(np.floor(np.log(np.maximum(draw[0], 1e-300)) / np.log1p(-share)), n[at]).astype(np.int64)
        found = (passed < n[at]) & (n[at] + passed < customers[at])
        taken = found & (draw[1] * share < new / (new + old + passed))
        t[at] += taken
        n[at] += passed + (passed < n[at])
        at, step = at[n[at] < customers[at]], step + 1
    return t


class Totals:
    """The parent's totals, and the discounts, as of one sweep; with the frequent words' places in the parent."""

    def __init__(self, counts: dict[str, int], heavy_c: np.ndarray, heavy_tables: np.ndarray, root_c: int,
                 root_t: int) -> None:
        ever = heavy_c > 0
        self.heavy_c = heavy_c
        self.vocabulary, self.n = counts["vocabulary"] + int(ever.sum()), counts["customers"]
        word1, word2 = (counts[f"word{k}"] + int((heavy_tables == k).sum()) for k in (1, 2))
        guess = lambda a, b: float(np.clip(a / max(1, a + 2 * b), 0.05, 0.95))
        self.discounts = guess(word1, word2), guess(counts["cell1"], counts["cell2"])
        self.heavy_c0, self.heavy_t0 = heavy_tables, ever.astype(np.int64)
        self.root_c, self.root_t = root_c + int(heavy_tables.sum()), root_t + int(self.heavy_t0.sum())

    def after(self, table: np.ndarray, heavy_tables: np.ndarray, root_c: int, root_t: int, seed: np.uint64) -> Totals:
        """The totals after a sweep, which left these tables."""
        new = object.__new__(Totals)
        new.__dict__.update(self.__dict__)
        new.heavy_c0, new.heavy_t0 = heavy_tables, self.reseated(heavy_tables, self.heavy_t0, table, seed)
        new.root_c, new.root_t = root_c + int(heavy_tables.sum()), root_t + int(new.heavy_t0.sum())
        return new

    def reseated(self, c0: np.ndarray, t0: np.ndarray, word: np.ndarray, seed: np.uint64) -> np.ndarray:
        d0, base = self.discounts[0], 1 / (self.vocabulary + 1)
        return seat(c0, (STRENGTH + d0 * (self.root_t - t0)) * base, d0, each=d0 * base, key=mix(word + seed))

    def p0(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        d0 = self.discounts[0]
        return (c0 - d0 * t0 + (STRENGTH + d0 * self.root_t) / (self.vocabulary + 1)) / (STRENGTH + self.root_c)


    def parents(self, c0: np.ndarray, t0: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words: ``heavy`` is their index among the frequent ones, or -1."""
        known = self.p0(self.heavy_c0, self.heavy_t0)
        return np.where(heavy < 0, self.p0(c0, t0), known[np.maximum(heavy, 0)])


def _of_heavy(heavy: np.ndarray, numbers: np.ndarray, size: int) -> list[int]:
    """The frequent words' numbers, by their index."""
    at = heavy >= 0
    return np.bincount(heavy[at], weights=numbers[at], minlength=size).astype(np.int64).tolist()


def _begun(part: int, cells: Cells, frequent: Words, sums: int) -> list[dict]:
    """A part's rows before the first sweep, one table for each dish."""
    local = cells.heavy < 0
    kinds = np.bincount(cells.w[cells.c > 0], minlength=len(cells.words))
    busy, u = cells.contexts[cells.busy], np.searchsorted(cells.busy, cells.u[cells.many])
    marks = np.zeros(len(cells.contexts), bool)
    marks[cells.busy] = True
    fixed = _pack(*_coded(cells.words[cells.kept], frequent.coded), *_coded(busy, frequent.coded),
                  cells.single[cells.kept], cells.of_many, u, cells.c[cells.many])
    once = int((local & (cells.total == 1)).sum())
    counts = {"vocabulary": int((cells.total[local] > 0).sum()), "customers": int(cells.c.sum()),
              "cell1": int((cells.c == 1).sum()), "cell2": int((cells.c == 2).sum()),
              "word1": int((kinds[local] == 1).sum()), "word2": int((kinds[local] == 2).sum())}
    size = frequent.size
    numbers = [int(kinds[local].sum()), counts["vocabulary"], *_of_heavy(cells.heavy, kinds, size),
               *_of_heavy(cells.heavy, cells.total, size), *(counts[k] for k in _COUNTS)]
    state = _pack(np.ones(len(cells.many), np.int64), np.ones(len(cells.kept), np.int64))
    return [{"part": part, "kind": FIXED, "other": once, "blob": fixed, "numbers": []},
            {"part": part, "kind": STATE, "other": 0, "blob": state, "numbers": numbers},
            *_slices(part, REST, sums, frequent, cells.contexts, cells.rest, marks, cells.customers),
            *_slices(part, SEND, sums, frequent, busy, np.bincount(u, minlength=len(busy)))]


def _swept(part: int, fixed: bytes, once: int, state: bytes, others: np.ndarray, totals: Totals, frequent: Words,
           sums: int, seed: np.uint64) -> list[dict]:
    """One Gibbs sweep over a part's dishes and its words' places in the parent; ``others``: the contexts' tables."""
    rows = _unpack(fixed)
    word, context = _decoded(*rows[:3], frequent.coded), _decoded(*rows[3:6], frequent.coded)
    single, w, u, c = rows[6:]
    t, t0 = _unpack(state)
    heavy = _place(frequent.heavy, word)
    seated = lambda t: single + np.bincount(w, weights=t, minlength=len(word)).astype(np.int64)
    parent = totals.parents(seated(t), t0, heavy)[w]
    d1 = totals.discounts[1]
    t = seat(c, (STRENGTH + d1 * (others[u] - t)) * parent, d1, each=d1 * parent,
             key=mix(word[w] ^ mix(context[u] + seed)))
    c0 = seated(t)
    local = heavy < 0
    t0 = totals.reseated(np.where(local, c0, 0), t0, word, seed)
    return [{"part": part, "kind": STATE, "other": 0, "blob": _pack(t, t0),
             "numbers": [int(c0[local].sum()) + once, int(t0.sum()) + once, *_of_heavy(heavy, c0, frequent.size)]},
            *_slices(part, SEND, sums, frequent, context, np.bincount(u, weights=t, minlength=len(context)).astype(np.int64))]


def _numbers(rows: DataFrame) -> np.ndarray:
    got = (rows.where(F.col("kind") == STATE).select(F.posexplode("numbers").alias("i", "x"))
           .groupBy("i").agg(F.sum("x").alias("x")).collect())
    out = np.zeros(len(got), np.int64)
    for r in got:
        out[r["i"]] = r["x"]
    return out


# -------------------------------------------------------------------- scoring


def _part_scores(rows: pd.DataFrame, told: pd.DataFrame, frequent: Words, kept: list[Totals]) -> pd.DataFrame:
    """Of each chunk the sums over one part's words: documents, known words, base scores and scores."""
    rows = rows.sort_values("chunk")
    cells, last = Cells(rows["pairs"], frequent), kept[-1]
    d1 = last.discounts[1]
    customers, *tables = _answers(told, REST)
    c_word = np.where(cells.heavy < 0, cells.total, last.heavy_c[np.maximum(cells.heavy, 0)])
    p = np.zeros(len(cells.c))
    for totals, there, state in zip(kept, tables, told[told["kind"] == STATE].sort_values("sweep")["blob"]):
        t, t0 = _unpack(state)
        t_cell, c0, t0_word = (cells.c > 0).astype(np.int64), np.minimum(cells.total, 1), np.minimum(cells.total, 1)
        t_cell[cells.many], c0[cells.kept], t0_word[cells.kept] = t, cells.seated(t), t0
        parent = totals.parents(c0, t0_word, cells.heavy)[cells.w]
        p += (cells.c - d1 * t_cell + (STRENGTH + d1 * there[cells.u]) * parent) / (STRENGTH + customers[cells.u])
    score = np.log10(p / len(kept))
    base = np.log10((c_word + PSEUDO) / (last.n + PSEUDO * (last.vocabulary + 1)))
    out, at = [], 0
    for size, places in zip(cells.sizes, rows["places"]):
        times, doc = _unpack(places)
        cell = np.repeat(cells.of[at:at + size], times)
        at += size
        ids, index = np.unique(doc, return_inverse=True)
        total = lambda x: np.bincount(index, weights=x, minlength=len(ids))
        out.append(_pack(ids, total(c_word[cells.w[cell]] > 0), total(base[cells.w[cell]]), total(score[cell])))
    return pd.DataFrame({"chunk": rows["chunk"], "blob": out})


def scored(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, frequent_size: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from rows whose crc32(doc_id as text) mod 10 is not 0; a
    null doc_id counts as a training row.  A null or empty text is one token,
    its end.  Repeated rows are rows of their own, in training and in the
    result.  With no training rows the vocabulary is empty and every token has
    the base's probability.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = _prepared(docs)
    found, total = frequent_words(rows.select("text"))
    frequent = Words(spark, found, frequent_size)
    parts = max(12, -(-total // PART_TOKENS))
    size = frequent.size

    # From here on each part's rows are in one bucket.
    chunks = _bucketed(_chunks(rows, frequent, parts).repartition(4 * parts, "part"), parts, "chunks")
    pairs = chunks.where("part >= 0")

    def begin(got: pd.DataFrame) -> pd.DataFrame:
        give_back()
        cells = Cells(got["pairs"], frequent)
        return pd.DataFrame(_begun(int(got["part"].iloc[0]), cells, frequent, parts),
                            columns=["part", "kind", "other", "blob", "numbers"])

    seating = _bucketed(pairs.select("part", "pairs").groupBy("part").applyInPandas(begin, _ROWS), parts, "seating")
    fixed = seating.where(F.col("kind") == FIXED).drop("numbers")
    asked = seating.where(F.col("kind") == REST).drop("numbers")
    rest = written(_added(asked, frequent), "rest")

    numbers = _numbers(seating)
    if not len(numbers):  # no rows at all
        numbers = np.zeros(2 + 2 * size + len(_COUNTS), np.int64)
    totals = Totals(dict(zip(_COUNTS, numbers[2 + 2 * size:].tolist())), numbers[2 + size:2 + 2 * size],
                    numbers[2:2 + size], int(numbers[0]), int(numbers[1]))
    kept: list[Totals] = []
    states: list[DataFrame] = []

    def swept(state: DataFrame, totals: Totals, seed: np.uint64) -> DataFrame:

        def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            give_back()
            (tables,), (never,) = _answers(told, SEND), _answers(told, REST)
            out = _swept(int(own["part"].iloc[0]), own["blob"].iloc[0], int(own["other"].iloc[0]),
                         told.loc[told["kind"] == STATE, "blob"].iloc[0], never + tables, totals, frequent, parts, seed)
            return pd.DataFrame(out, columns=["part", "kind", "other", "blob", "numbers"])

        told = (state.where(F.col("kind") == STATE).drop("numbers").unionByName(rest)
                .unionByName(_added(state.where(F.col("kind") == SEND).drop("numbers"), frequent)))
        return written(fixed.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(run, _ROWS), "seating")

    state = seating
    for number in range(sweeps):
        seed = mix(np.array([number + 1], np.uint64))[0]
        state = swept(state, totals, seed)
        numbers = _numbers(state)
        if len(numbers):
            totals = totals.after(frequent.heavy, numbers[2:], int(numbers[0]), int(numbers[1]), seed)
        if number >= burn_in:
            kept.append(totals)
            states.append(state.drop("numbers").withColumn("sweep", F.lit(number)))

    every = states[0]
    for x in states[1:]:
        every = every.unionByName(x)
    sums = _last_sums(asked.withColumn("sweep", F.lit(-1)).unionByName(every.where(F.col("kind") == SEND)),
                      frequent, list(range(burn_in, sweeps)))
    told = every.where(F.col("kind") == STATE).unionByName(sums.withColumn("sweep", F.lit(-1)))

    def score(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return _part_scores(own, told, frequent, kept)

    got = pairs.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(score, "chunk long, blob binary")
    whole = chunks.where("part < 0").select("chunk", F.col("pairs").alias("blob"), F.lit(True).alias("rows")).unionByName(
        got.withColumn("rows", F.lit(False)))

    def by_row(got: pd.DataFrame) -> pd.DataFrame:
        doc_id, null, out, n = _unpack(got.loc[got["rows"], "blob"].iloc[0])
        sums = np.zeros((3, len(n)))
        for blob in got.loc[~got["rows"], "blob"]:
            at, *x = _unpack(blob)
            sums[:, at] += x
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(doc_id, null.astype(bool)), "held_out": out.astype(bool), "n_tokens": n,
            "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]})

    return whole.groupBy("chunk").applyInPandas(
        by_row, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"), "base_score",
        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return scored(docs).drop("perplexity")
