"""Suffix-array dedup with a run-length index: long matches in repetitive corpora.

A string of ``LENGTH`` bytes that occurs twice has, at both places, the same
anchor: the k-mer of smallest hash inside it.  The places whose strings share
an anchor form a run, and the bytes they cover are the anchor's context there.
Anchors that occur once, the bulk of any corpus, never meet another text.
Where all contexts of an anchor are equal, all of it repeats.  The other
contexts, each distinct one once, are indexed by groups of whole anchors:

* their suffixes are sorted and give the Burrows-Wheeler transform, of which
  only the runs are kept, with the suffix positions at each run's two ends;
* the matching statistics stream over the text: at a run's end the length of
  the match with the neighbouring suffix is computed, and between such places
  it falls by one with each position;
* positions whose statistic reaches ``LENGTH`` mark the context.

An anchor of more contexts than a group may hold is split by what stands beside
it: strings with at least h bytes before the anchor share those h bytes, the
others share the bytes after it.  Each context goes by either half, equal halves
are marked whole and go on as one, only halves that meet others stay, and what
is still too large is halved again, at last to single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_bytes, prefix_hash, span_hash, utf8, written

LENGTH = 200
KMER = 32
GROUP_BYTES = 2 << 20  # context bytes that are indexed together, about
HOT_CONTEXTS = 2_000  # distinct contexts that are indexed together; beyond, they are split


# ------------------------------------------------------------------- anchors


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kmer: int = KMER
                  ) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: row, first and last start, hash of the anchor and of the context.

    The anchor of a string is its k-mer of smallest hash (32 bits of it), the
    leftmost of equals: it depends on the string's bytes alone.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    starts = np.arange(len(data) - kmer + 1)
    hashes = span_hash(prefix, starts, starts + kmer)
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    anchor = (_sliding_min(order, length - kmer + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    room = np.maximum(0, sizes - length + 1)
    row = np.repeat(np.arange(len(sizes)), room)
    at = np.arange(int(room.sum())) + np.repeat(offsets[:-1] - (np.cumsum(room) - room), room)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = anchor[at]
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    tails = np.append(heads[1:], len(at)) - 1
    first, last = at[heads], at[tails]
    context = span_hash(prefix, first, last + length) + (anchor[heads] - first).astype(np.uint64)
    return row[heads], first, last, hashes[anchor[heads]], context


# --------------------------------------------------------------------- index


class RunIndex:
    """A run-length index of several texts: their run-compressed transform and the suffixes at run ends."""

    SYMBOLS = 7  # symbols of nine bits in one word; 0 ends a text

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        self.starts = ends - sizes
        n = int(ends[-1]) + 1
        text = np.zeros(n + self.SYMBOLS, np.int64)
        where = np.ones(n, bool)
        where[ends] = False
        text[:n][where] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.rest = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols before the text's end
        word = np.zeros(n, np.int64)
        for k in range(self.SYMBOLS):
            word = word << 9 | np.where(self.rest >= k, text[k:n + k], 0)
        self.word, self.n = word, n
        order = self._sorted_suffixes()
        before = np.where(self._is_start(order), 0, text[order - 1])
        # Run-length transform: symbol and suffixes at both ends of each run.
        new = np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], n) - 1
        self.symbols, self.lengths = before[head], tail - head + 1
        self.head, self.tail = order[head], order[tail]
        self._ahead_of_head = np.where(head > 0, order[head - 1], -1)
        self._behind_tail = np.where(tail + 1 < n, order[np.minimum(tail + 1, n - 1)], -1)

    def _is_start(self, at: np.ndarray) -> np.ndarray:
        return (at == 0) | (self.rest[at - 1] == 0)

    def _sorted_suffixes(self) -> np.ndarray:
        """Suffix positions in order, by doubling; suffixes that are equal to their ends keep their place."""
        width = self.SYMBOLS
        order = np.argsort(self.word, kind="stable")
        sorted_words = self.word[order]
        ended = self.rest < width
        while True:
            fresh = np.r_[True, (sorted_words[1:] != sorted_words[:-1]) | ended[order[1:]] | ended[order[:-1]]]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(fresh)
            if fresh.all():
                return order
            follow = np.zeros(self.n, np.int64)
            follow[:max(0, self.n - width)] = rank[width:]
            follow[ended] = 0
            pairs = rank * (self.n + 1) + follow
            # Only suffixes that still share their rank are sorted again, in the places they hold.
            shared = ~fresh | ~np.append(fresh[1:], True)
            spots = np.flatnonzero(shared)
            own = order[spots]
            order[spots] = own[np.argsort(pairs[own], kind="stable")]
            sorted_words = pairs[order]
            width *= 2
            ended = self.rest < width

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, inside their texts."""
        out = np.zeros(len(a), np.int64)
        most = np.minimum(self.rest[a], self.rest[b])
        live = np.flatnonzero(most > 0)
        while len(live):
            x = self.word[a[live] + out[live]] ^ self.word[b[live] + out[live]]
            same = x == 0
            lead = np.full(len(live), self.SYMBOLS, np.int64)
            bits = np.frexp(x[~same].astype(np.float64))[1]  # at most one too high, by rounding up
            bits -= (x[~same] >> (bits - 1)) == 0
            lead[~same] = (9 * self.SYMBOLS - bits) // 9
            out[live] += lead
            live = live[same & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match that also starts at another position."""
        best = np.zeros(self.n, np.int64)
        for sampled, neighbour in ((self.head, self._ahead_of_head), (self.tail, self._behind_tail)):
            reach = np.zeros(self.n, np.int64)
            has = neighbour >= 0
            at = sampled[has]
            reach[at] = self.common(at, neighbour[has]) + at
            known = np.zeros(self.n, np.int64)
            known[sampled] = sampled + 1
            last = np.maximum.accumulate(known) - 1  # the sampled position that the stream passed last
            best = np.maximum(best, np.where(last >= 0, reach[np.maximum(last, 0)] - np.arange(self.n), 0))
        return best


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For each text, the first and last start of a ``length``-byte string that also starts elsewhere."""
    index = RunIndex(texts)
    hit = np.flatnonzero(index.matching_statistics() >= length)
    lo, hi = np.searchsorted(hit, index.starts), np.searchsorted(hit, index.starts + [len(t) for t in texts])
    return [(int(hit[a] - s), int(hit[b - 1] - s)) if b > a else None for a, b, s in zip(lo, hi, index.starts)]


# ---------------------------------------------------------------------- dedup


def _runs(docs: DataFrame, length: int, kmer: int) -> DataFrame:
    """(anchor, context) of every run of the corpus."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            _, _, _, anchor, context = anchored_runs(*utf8(batch.column("text")), length, kmer)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor.view(np.int64)),
                                              "context": pa.array(context.view(np.int64))})

    return docs.mapInArrow(emit, "anchor long, context long")


def _places(docs: DataFrame, length: int, kmer: int, repeated, varied) -> DataFrame:
    """(anchor, context, key, start, bytes, body) of the runs whose anchors the first filter holds; body if the second."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, differs = (np.frombuffer(x.value, np.uint8) for x in (repeated, varied))
        for batch in by_bytes(batches):
            data, offsets = utf8(batch.column("text"))
            row, first, last, anchor, context = anchored_runs(data, offsets, length, kmer)
            own = np.flatnonzero(bloom.contains(again, anchor)) if len(anchor) else np.empty(0, np.int64)
            row, first, last, anchor, context = (x[own] for x in (row, first, last, anchor, context))
            body = bloom.contains(differs, anchor) if len(anchor) else []
            raw = data.tobytes()
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(anchor.view(np.int64)), "context": pa.array(context.view(np.int64)),
                "key": batch.column("key").take(pa.array(row)), "start": pa.array(first - offsets[row]),
                "bytes": pa.array(last - first + length),
                "body": pa.array([raw[a:b + length] if x else None for a, b, x in zip(first, last, body)],
                                 pa.binary())})

    return docs.mapInArrow(emit, "anchor long, context long, key long, start long, bytes long, body binary")


def _indexed(contexts: DataFrame, length: int, groups: int, by: str = "anchor") -> DataFrame:
    """(anchor, context, lo, hi): the repeated strings' first and last start in each context.

    ``shift``, where there is one, is where the body starts in its context.
    """

    def index(part: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(list(part["body"]), length)
        rows = [(a, c, x[0] + s, x[1] + s) for a, c, s, x in
                zip(part["anchor"], part["context"], part["shift"], found) if x]
        return pd.DataFrame(rows, columns=["anchor", "context", "lo", "hi"])

    if "shift" not in contexts.columns:
        contexts = contexts.withColumn("shift", F.lit(0).cast("long"))
    return (contexts.withColumn("grp", F.expr(f"cast(pmod(xxhash64({by}), {groups}) as int)"))
            .groupBy("grp").applyInPandas(index, "anchor long, context long, lo long, hi long"))


_PIECE = "anchor long, context long, body binary, shift long, at long, low long, high long, key long"


def _whole(contexts: DataFrame, length: int, kmer: int) -> DataFrame:
    """The contexts as pieces: body, its start in the context, the anchor's place in the context and the least and
    most bytes that the strings meant have before the anchor."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "body"):
            at = []
            for body in batch.column("body").to_pylist():
                prefix = prefix_hash(np.frombuffer(body, np.uint8)[:length])
                starts = np.arange(length - kmer + 1)
                hashes = span_hash(prefix, starts, starts + kmer) & np.uint64(0xFFFFFFFF00000000)
                at.append(int(np.argmin(hashes)))  # the leftmost of the smallest, as in anchored_runs
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor"), batch.column("context"), batch.column("body"), pa.array([0] * n, pa.int64()),
                 pa.array(at, pa.int64()), pa.array([0] * n, pa.int64()), pa.array([length - kmer] * n, pa.int64()),
                 batch.column("anchor")], ["anchor", "context", "body", "shift", "at", "low", "high", "key"])

    return contexts.select("anchor", "context", "body").mapInArrow(emit, _PIECE)


def _halves(pieces: DataFrame, length: int, kmer: int) -> DataFrame:
    """Each piece by its strings with few and with many bytes before the anchor; equal strings have equal keys."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "body"):
            rows = []
            for r in batch.to_pylist():
                body, shift, at = r["body"], r["shift"], r["at"]
                prefix = prefix_hash(np.frombuffer(body, np.uint8))
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    first = max(shift, at - high)  # starts of the half's first and last string in the context
                    last = min(shift + len(body) - length, at - low)
                    if first > last or low > high:
                        continue
                    # What all strings of the half have around the anchor.
                    a, b = at - low - shift, at - high + length - shift
                    key = span_hash(prefix, np.array([a]), np.array([b])) + np.uint64(low) * np.uint64(length)
                    rows.append(r | {"body": body[first - shift:last - shift + length], "shift": first, "low": low,
                                     "high": high, "key": int(key.view(np.int64)[0])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return pieces.mapInArrow(emit, _PIECE)


def _split(contexts: DataFrame, length: int, kmer: int, group_bytes: int, hot_contexts: int) -> DataFrame:
    """The same as ``_indexed`` for anchors of very many contexts, by halves of their strings."""
    pieces, marks = written(_whole(contexts, length, kmer), "pieces"), []
    for _ in range((length - kmer + 1).bit_length()):
        halves = written(_halves(pieces, length, kmer).withColumn("same", F.expr("xxhash64(key, body, at - shift)")),
                         "halves")
        # Equal pieces repeat as a whole, single strings at last, and one goes on for all of them.
        one = written(halves.groupBy("same").agg(
            F.count("*").alias("n"),
            F.min(F.struct("anchor", "context", *[c for c in pieces.columns if c not in ("anchor", "context")]))
            .alias("piece")), "pieces")
        marks.append(halves.join(one.where("n > 1").select("same"), "same").select(
            "anchor", "context", F.col("shift").alias("lo"), F.expr(f"shift + length(body) - {length}").alias("hi")))
        pieces = one.select("piece.*").select(*pieces.columns).where("low < high")
        size = written(pieces.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.length("body")).alias("b"))
                       .where("m > 1"), "sizes")
        total = size.where(F.col("m") <= hot_contexts).agg(F.sum("b")).first()[0] or 0
        met = pieces.join(size.drop("b"), "key")
        if total:
            marks.append(_indexed(met.where(F.col("m") <= hot_contexts), length, -(-int(total) // group_bytes), "key"))
        pieces = written(met.where(F.col("m") > hot_contexts).drop("m").select(*pieces.columns), "pieces")
        if not pieces.limit(1).count():
            break
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, group_bytes: int = GROUP_BYTES,
                   hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(key, spans): for every text with repeats, the byte spans (start, end) to remove, one for each run.

    ``docs`` has key (one value for equal rows) and text.
    """
    spark = docs.sparkSession
    groups = (_runs(docs, length, kmer).groupBy("anchor")
              .agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
              .where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("varied")))
    groups = written(groups, "anchors")
    repeated = spark.sparkContext.broadcast(bloom.seen(groups, "anchor").tobytes())
    varied = spark.sparkContext.broadcast(bloom.seen(groups.where("varied"), "anchor").tobytes())
    places = written(_places(docs, length, kmer, repeated, varied).join(groups, "anchor"), "places")
    light = places.drop("body")

    contexts = written(places.where("varied").groupBy("anchor", "context")
                       .agg(F.count("*").alias("n"), F.first("body").alias("body")), "contexts")
    size = contexts.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(F.length("body")).alias("b"))
    total = size.where(F.col("m") <= hot_contexts).agg(F.sum("b")).first()[0] or 0
    hot = size.where(F.col("m") > hot_contexts).select("anchor")
    few = contexts.join(hot, "anchor", "left_anti")
    marks = _indexed(few, length, max(1, -(-int(total) // group_bytes)))
    if hot.limit(1).count():
        many = contexts.join(hot, "anchor", "left_semi")
        marks = marks.unionByName(_split(many, length, kmer, group_bytes, hot_contexts))
    # Contexts that stand at several places repeat as a whole.
    whole = contexts.where("n > 1").select("anchor", "context", F.lit(0).cast("long").alias("lo"),
                                           (F.length("body") - length).cast("long").alias("hi"))
    marks = marks.unionByName(whole).groupBy("anchor", "context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = light.where("not varied").select("key", "start", (F.col("start") + F.col("bytes")).alias("end")).unionByName(
        light.where("varied").join(marks, ["anchor", "context"]).select(
            "key", (F.col("start") + F.col("lo")).alias("start"),
            (F.col("start") + F.col("hi") + length).alias("end")))
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted((s["start"], s["end"]) for s in spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x[1]))
        else:
            out.append(x)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans and what is kept.

    Every byte covered by a string of ``length`` bytes that also starts
    anywhere else, in the same text or another, is removed; all strings are
    judged on the input.  ``kept`` is binary, since a cut may fall inside a
    character; with ``digest`` it is ``kept_sha256`` instead.  Null texts are
    empty; texts shorter than ``length`` lose nothing; of equal rows none is
    spared; a null doc_id is a row like any other.  Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.select("key", "text"), length, **options)
    joined = rows.join(spans.withColumnRenamed("key", "to").hint("shuffle_hash"), F.col("key") == F.col("to"),
                       "left").select("doc_id", "text", "spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            removed, kept, merged = [], [], []
            texts = batch.column("text").cast(pa.binary())
            for body, found in zip(texts.to_pylist(), batch.column("spans").to_pylist()):
                gone = _union(found or [])
                at, left = 0, []
                for a, b in gone:
                    left.append(body[at:a])
                    at = b
                left.append(body[at:])
                rest = b"".join(left)
                removed.append(len(body) - len(rest))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                merged.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([len(m) for m in merged], pa.int64()),
                 pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string() if digest else pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256" if digest else "kept"])

    kept = "kept_sha256 string" if digest else "kept binary"
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  f"spans array<struct<start: long, end: long>>, {kept}")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return remove_repeats(docs, digest=True).drop("spans")
