"""k-nearest-neighbour search over embedding vectors and what it finds.

Candidates and queries are dealt into blocks of bounded size, and each pair of
blocks is one group, spread by a shuffle.  In a group one matrix product rates
all pairs, and only those that can be among a query's k nearest there, by the
bounds of rounding, leave it.  Their distances are array expressions
(``zip_with`` + ``aggregate``) on the JVM, which alone decide the ranks.  Top-k
is two-level: within each (query, candidate block) the k best survive, then the
k best of those per query, so no task sorts all candidates of one query.

The approximate search hashes vectors by random projections into the buckets
of several tables and joins queries only to candidates of their buckets and of
those one sign away; each bucket is paired in such blocks.  ``retrieve``
fetches documents late: only the blocks of the document store that hold a found
id are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..session import importable, scratch_path, spread

CANDIDATES, QUERIES = 32_768, 8_192  # rows of a block
STEP, ASKED = 4_096, 256  # candidates and queries that are rated at a time

def _as_double(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def l2_squared(a: str, b: str) -> Column:
    d = F.zip_with(_as_double(a), _as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str, b: str) -> Column:
    d = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_as_double(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a: str, b: str) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def label_centroids(emb: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per label: (label, centroid array<double>).

    Element-wise mean via posexplode + groupBy (label, position), then the
    positions are gathered back in order; the group is one label's dimension
    list (the vector length), never its rows.
    """
    ex = emb.select(label, F.posexplode(vec).alias("pos", "v"))
    per = ex.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return (per.groupBy(label)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_s"))
            .select(F.col(label).alias("query_id"), F.transform("_s", lambda s: s["m"]).alias("query_vec")))


def _top(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k nearest of (query_id, cand_id, distance, _blk) per query, first within each block."""
    order = [F.col("distance").asc(), F.col("cand_id").asc()]
    local = (scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_blk").orderBy(*order)))
             .filter(F.col("_r") <= k))
    top = (local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
           .filter(F.col("rank") <= k))
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias(id_col),
                      round_half_up("distance", 9).alias("distance"),
                      round_half_up((F.lit(1.0) - F.col("distance")) * 100, 1).alias("relevancia"))


def _distance(metric: str) -> Column:
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be l2 or cosine")
    return l2_squared("cand_vec", "query_vec") if metric == "l2" else cosine_distance("cand_vec", "query_vec")


def _matrix(column: pa.ChunkedArray, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers end to end, where each vector starts, and its length; -1 where every distance is NULL."""
    column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64())
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    void = pc.is_null(column).to_numpy(zero_copy_only=False).copy()
    void[row[pc.is_null(values).to_numpy(zero_copy_only=False)]] = True
    flat = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
    if cosine:
        void |= np.bincount(row, weights=flat != 0, minlength=len(size)) == 0
    return flat, start, np.where(void, -1, size)


def _candidates_of(q: np.ndarray, c: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that hold each query's k nearest, whatever the rounding.

    Of equal candidates, which stand in order of id, the first k are enough.
    """
    first = np.flatnonzero(pd.DataFrame({"v": [x.tobytes() for x in c]}).groupby("v").cumcount() < k)
    c = c[first]
    room = 8 * (q.shape[1] + 4) * np.finfo(float).eps
    q2, c2 = (q * q).sum(axis=1), (c * c).sum(axis=1)
    if cosine:
        q, c = q / np.sqrt(q2)[:, None], c / np.sqrt(c2)[:, None]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a in range(0, len(q), ASKED):
        most = np.full(min(ASKED, len(q) - a), np.inf)  # the k-th nearest is no farther
        for b in range(0, len(c), STEP):
            d = q[a:a + ASKED] @ c[b:b + STEP].T
            if cosine:
                d, spare = 1 - d, room
            else:
                both = q2[a:a + ASKED, None] + c2[None, b:b + STEP]
                d, spare = both - 2 * d, room * both
            if d.shape[1] >= k and not np.isfinite(most).all():
                most = np.fmin(most, np.partition(d + spare, k - 1, axis=1)[:, k - 1])
            x, y = np.nonzero(~(d - spare > most[:, None]))  # what is not a number stays
            found.append((x + a, y + b))
    x, y = (np.concatenate(part) for part in zip(*found))
    return x, first[y]


def _near(k: int, metric: str):
    """Of a block of candidates and one of queries, the pairs that hold each query's k nearest in order of id."""
    cosine = metric == "cosine"

    def pair(cands: pa.Table, asked: pa.Table) -> pa.Table:
        cands = cands.take(pc.sort_indices(cands, sort_keys=[("cand_id", "ascending")], null_placement="at_start"))
        qv, q_at, q_size = _matrix(asked.column("query_vec"), cosine)
        cv, c_at, c_size = _matrix(cands.column("cand_vec"), cosine)
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in np.unique(q_size):
            mine = np.flatnonzero(q_size == size)
            void = np.flatnonzero((c_size != size) | (size < 0))[:k]  # NULL distances come first, by id
            x.append(np.repeat(mine, len(void)))
            y.append(np.tile(void, len(mine)))
            like = np.flatnonzero((c_size == size) & (size >= 0))
            if len(like):
                place = np.arange(size)
                with np.errstate(all="ignore"):
                    i, j = _candidates_of(qv[q_at[mine][:, None] + place], cv[c_at[like][:, None] + place], k, cosine)
                x.append(mine[i])
                y.append(like[j])
        x, y = np.concatenate(x), np.concatenate(y)
        left, right = asked.select(["query_id", "query_vec"]).take(x), cands.select(["cand_id", "cand_vec"]).take(y)
        return pa.table([*left.columns, *right.columns], ["query_id", "query_vec", "cand_id", "cand_vec"])

    return pair


def _in_blocks(cands: DataFrame, asked: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """(query_id, query_vec, cand_id, cand_vec) for each query's k nearest, and few more, in each group of ``keys``."""
    _distance(metric)
    importable(cands.sparkSession)
    out = asked.select("query_id", "query_vec").schema
    for f in cands.select("cand_id", "cand_vec").schema:
        out = out.add(f.name, f.dataType)
    return cands.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_near(k, metric), out)


def _dealt(df: DataFrame, own: str, blocks: Column, other: str, others: Column, *by: str) -> DataFrame:
    """``df`` dealt into ``blocks`` blocks by ``by``, each row once for each of the ``others`` blocks."""
    return (df.withColumn(own, F.pmod(F.xxhash64(*by), blocks).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.greatest(others.cast("int"), F.lit(1)) - 1))))


def knn(queries: DataFrame, candidates: DataFrame, k: int = 5, metric: str = "l2",
        id_col: str = "vec_id", vec: str = "embedding", blocks: int | None = None) -> DataFrame:
    """Top-k candidates per query: (query_id, rank, id, distance, relevance).

    ``queries`` has (query_id, query_vec).  ``metric`` is ``l2`` (squared
    Euclidean, the vector store default) or ``cosine``.  ``relevance`` is
    (1 - d)·100 rounded to 1 decimal, as shown to users.  ``blocks``, the least
    number of candidate blocks, defaults to the session's number of shuffle
    partitions, which follows the cluster; blocks of more than ``CANDIDATES``
    rows are cut further.
    """
    blocks = blocks or max(8, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = F.lit(max(blocks, -(-candidates.count() // CANDIDATES)))
    parts = F.lit(max(1, -(-queries.count() // QUERIES)))
    cands = candidates.select(F.col(id_col).alias("cand_id"), F.col(vec).alias("cand_vec"))
    cands = _dealt(cands, "_blk", blocks, "_part", parts, "cand_id", "cand_vec")
    asked = _dealt(queries.select("query_id", "query_vec"), "_part", parts, "_blk", blocks, "query_id", "query_vec")
    scored = _in_blocks(cands, asked, ["_blk", "_part"], k, metric).select(
        "query_id", "cand_id", _distance(metric).alias("distance"),
        F.pmod(F.xxhash64("cand_id"), F.lit(64)).alias("_blk"))
    return _top(scored, k, id_col)


# ---------------------------------------------------------------- approximate
@dataclass(frozen=True)
class Projections:
    """Random hyperplanes: ``tables`` hashes of ``bits`` signs each, for vectors of ``dim`` numbers."""

    dim: int
    tables: int = 16
    bits: int = 6
    seed: int = 42

    def planes(self) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return rng.standard_normal((self.dim, self.tables * self.bits))

    def buckets(self, vec: str, probe: bool = False) -> Column:
        """The vector's bucket in each table; with ``probe`` also those that differ in one sign.

        An array of table * 2^bits + bucket; NULL for a NULL vector or one of
        another length.
        """
        planes, bits, tables = self.planes(), self.bits, self.tables

        @F.pandas_udf("array<long>")
        def hashed(column: pd.Series) -> pd.Series:
            good = column.map(lambda v: v is not None and len(v) == len(planes)).to_numpy(bool)
            out = np.full(len(column), None, object)
            if good.any():
                signs = np.stack(column[good].to_list()).astype(float) @ planes > 0
                own = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits))
                if probe:
                    flips = np.concatenate([[0], 1 << np.arange(bits)])
                    own = own[:, :, None] ^ flips
                own = own + (np.arange(tables) << bits).reshape((1, tables) + (1,) * (own.ndim - 2))
                out[np.flatnonzero(good)] = list(own.reshape(len(own), -1))
            return pd.Series(out)

        return hashed(F.col(vec))


def knn_lsh(queries: DataFrame, candidates: DataFrame, projections: Projections, k: int = 5, metric: str = "l2",
            id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``knn`` over the candidates that share a bucket with the query or lie one sign away from it.

    Distances are exact and no found candidate is dropped; a near vector may
    be missed where all tables part it from the query.  The query set may
    have any size.
    """
    own = spread(candidates).select(F.col(id_col).alias("cand_id"), F.col(vec).alias("cand_vec"),
                                    F.explode(projections.buckets(vec)).alias("_b")).where("cand_id is not null")
    asked = queries.select("query_id", "query_vec", F.explode(projections.buckets("query_vec", probe=True)).alias("_b"))
    # A full bucket is several blocks, on either side.
    held = own.groupBy("_b").agg(F.ceil(F.count("*") / CANDIDATES).alias("_c")).join(
        asked.groupBy("_b").agg(F.ceil(F.count("*") / QUERIES).alias("_q")), "_b")
    for_own, for_asked = (held.select("_b", F.col("_c").alias(f"_c{x}"), F.col("_q").alias(f"_q{x}")) for x in "ab")
    own = _dealt(own.join(for_own, "_b"), "_i", F.col("_ca"), "_j", F.col("_qa"), "cand_id", "cand_vec")
    asked = _dealt(asked.join(for_asked, "_b"), "_j", F.col("_qb"), "_i", F.col("_cb"), "query_id", "query_vec")
    # Whatever is among a query's k nearest is so in a bucket, too.
    pairs = _in_blocks(own, asked, ["_b", "_i", "_j"], k, metric).select("query_id", "cand_id").distinct()
    scored = (pairs.join(candidates.select(F.col(id_col).alias("cand_id"), F.col(vec).alias("cand_vec")), "cand_id")
              .join(queries, "query_id")
              .select("query_id", "cand_id", _distance(metric).alias("distance"),
                      F.pmod(F.xxhash64("cand_id"), F.lit(64)).alias("_blk")))
    return _top(scored, k, id_col)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(n_consultas, esperados, hallados, recall): how many of the exact neighbours were found."""
    hit = exact.select("query_id", id_col).join(
        found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    n, h = F.count(F.lit(1)), F.count("hit")
    return hit.agg(F.count_distinct("query_id").alias("n_consultas"), n.alias("esperados"), h.alias("hallados"),
                   F.try_divide(h, n).alias("recall"))


# ------------------------------------------------------------- what was found
def write_text_store(docs: DataFrame, path: str, id_col: str, blocks: int = 256) -> DataFrame:
    """The documents as a store in ``blocks`` folders by the hash of their id."""
    block = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(blocks)).cast("int")
    (docs.withColumn("_block", block).hint("rebalance", "_block").write.mode("overwrite").partitionBy("_block")
     .parquet(path))
    return docs.sparkSession.read.parquet(path)


def retrieve(top: DataFrame, store: DataFrame, id_col: str, store_id: str, text: str, tags: list[str],
             blocks: int = 256) -> DataFrame:
    """``top`` with the text, tag columns and label of each found id.

    The label is ``[tag|…|rel:x%]``; empty tags are left out, the first is "?"
    if it is missing.  ``top`` is found first and written, so its size is
    known: while Spark can broadcast it, the blocks of the store (a partition
    column) that hold none of its ids are pruned at run time, and texts are
    read for the other blocks alone.
    """
    spark = top.sparkSession
    path = scratch_path(spark, f"top-{uuid.uuid4().hex[:12]}")
    at = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(blocks)).cast("int")
    top.withColumn("_block", at).write.parquet(path)
    # The comparison holds for every row: Spark prunes only by a side that has a filter.
    wanted = spark.read.parquet(path).where("_block >= 0").alias("t")
    rows = store.select("_block", F.col(store_id).alias("_id"), F.col(text).alias("texto"), *tags).alias("s")
    joined = wanted.join(rows, (F.col("t._block") == F.col("s._block")) & (F.col(f"t.{id_col}") == F.col("s._id")))
    shown = [F.coalesce(F.nullif(F.col(f"s.{tags[0]}").cast("string"), F.lit("")), F.lit("?"))]
    shown += [F.nullif(F.col(f"s.{t}").cast("string"), F.lit("")) for t in tags[1:]]
    label = F.concat(F.lit("["), F.concat_ws("|", *shown, F.format_string("rel:%.1f%%", F.col("t.relevancia"))),
                     F.lit("]"))
    return joined.select(*[F.col(f"t.{c}") for c in top.columns], label.alias("etiqueta"),
                         *[F.col(f"s.{t}") for t in tags], F.col("s.texto"))
