"""Exact top-k search by inner product in an M-tree of paged metric nodes.

Inner products become distances by one more component: with M the largest
squared length, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the k largest products are the k nearest.

The tree is a table of pages.  Vectors are routed to the nearest of a bounded
sample of routers, laid out by router and distance from it, and cut into
pages.  A page names one of its vectors as routing object and stores its
covering radius and every entry's distance to it.  A query visits pages best
first, by d(q, object) - radius, until that exceeds its k-th distance so far;
inside a page it computes only those entries whose stored distance leaves them
in reach: |d(q, object) - d(entry, object)| <= k-th distance.

Queries come in blocks and pages in groups; each pair of a block and a group
is one bounded piece of work, whose best k go to a last ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PAGE = 512  # entries of a page
GROUP_PAGES = 16  # pages that are searched together
BLOCK = 1024  # queries that are searched together
ROUTERS = 1024  # rows sampled at most, for routing and for first bounds
SCALE = 256


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component as long; null if the vector is, or holds null or a non-finite number."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("long")))


def _matrix(rows: Iterable, width: int) -> np.ndarray:
    """Lists of numbers as a matrix, short ones filled up with zeros."""
    rows = list(rows)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _last(x: np.ndarray, longest: float) -> np.ndarray:
    """The component that makes all vectors equally long."""
    return np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))


def _slack(longest: float) -> float:
    """More than rounding can move a distance; bounds are loosened by it, scores are exact integers."""
    return 1e-6 * (1.0 + np.sqrt(longest))


def pages(vectors: DataFrame, routers: np.ndarray, longest: float, width: int, page: int = PAGE) -> DataFrame:
    """The leaf level: page long, ids, vectors, distances (binary arrays), object (binary) and radius.

    Every row of ``vectors`` (vec_id, v) is in one page.  Rows are spread by
    router, distance and id, so equal vectors, however many, fill many pages.
    """
    last = _last(routers, longest)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), width)
            own = _last(x, longest)
            square = ((x * x).sum(axis=1) + own * own)[:, None] + (routers * routers).sum(axis=1) + last * last \
                - 2 * (x @ routers.T + np.outer(own, last))
            near = square.argmin(axis=1)
            yield pa.RecordBatch.from_pydict({
                "router": pa.array(near.astype(np.int32)),
                "far": pa.array(np.sqrt(np.maximum(0, square[np.arange(len(x)), near]))),
                "vec_id": batch.column("vec_id"), "v": batch.column("v")})

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def node(rows: list[tuple]) -> dict:
            ids = np.array([r[1] for r in rows], np.int64)
            x = _matrix([r[2] for r in rows], width)
            whole = np.column_stack([x, _last(x, longest)])
            middle = int(((whole - whole.mean(axis=0)) ** 2).sum(axis=1).argmin())
            away = np.sqrt(((whole - whole[middle]) ** 2).sum(axis=1))
            return {"ids": ids.tobytes(), "vectors": x.tobytes(), "distances": away.tobytes(),
                    "object": whole[middle].tobytes(), "radius": float(away.max())}

        schema = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("distances", pa.binary()),
                            ("object", pa.binary()), ("radius", pa.float64())])
        rows: list[tuple] = []
        for batch in batches:
            made = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("router", "vec_id", "v"))):
                if rows and (rows[-1][0] != r[0] or len(rows) == page):
                    made.append(node(rows))
                    rows = []
                rows.append(r)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
        if rows:
            yield pa.RecordBatch.from_pylist([node(rows)], schema)

    routed = vectors.mapInArrow(route, "router int, far double, vec_id long, v array<bigint>")
    laid = routed.repartitionByRange("router", "far", "vec_id").sortWithinPartitions("router", "far", "vec_id")
    return written(laid.mapInArrow(cut, "ids binary, vectors binary, distances binary, object binary, radius double")
                   .withColumn("page", F.monotonically_increasing_id()), "pages")


class _Best:
    """The k best (score, id) of one query: higher scores first, ties to smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            top = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[top], ids[top]
        for s, i in zip(scores.tolist(), ids.tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i))
            elif (s, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i))

    def least(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else -np.inf


def search(query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, nodes: list[dict], longest: float,
           k: int) -> Iterator[tuple[int, int, int]]:
    """Best-first search of the nodes: (query, id, score) of each query's k best there.

    ``floor`` has scores that a query's k best reach anyhow; what is under
    that need not be found.
    """
    dims = queries.shape[1]
    objects = np.stack([n["object"] for n in nodes])
    squares = (queries * queries).sum(axis=1)
    far = squares[:, None] + (objects * objects).sum(axis=1) - 2 * queries @ objects[:, :dims].T
    far = np.sqrt(np.maximum(0, far))
    near = far - np.array([n["radius"] for n in nodes])
    slack = _slack(longest)
    for q in range(len(query_ids)):
        best = _Best(k)
        for j in np.argsort(near[q], kind="stable"):
            reach = np.sqrt(max(0.0, squares[q] + longest - 2 * max(best.least(), floor[q]))) + slack \
                if max(best.least(), floor[q]) > -np.inf else np.inf
            if near[q, j] > reach:
                break  # and so are all further nodes
            node = nodes[j]
            at = np.flatnonzero(np.abs(node["distances"] - far[q, j]) <= reach)
            if len(at):
                scores = node["vectors"][at] @ queries[q]
                own = node["ids"][at] != query_ids[q]
                wanted = own & (scores >= max(best.least(), floor[q]))
                best.add(scores[wanted], node["ids"][at][wanted])
        for s, i in best.heap:
            yield int(query_ids[q]), -i, int(s)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", page: int = PAGE,
          block: int = BLOCK, routers: int = ROUTERS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by integer inner product.

    Both tables have vec_id and the vector column; candidates are all rows but
    those with the query's own vec_id.  Rows with a null vec_id, a null vector
    or a vector that holds null or a non-finite number take no part.  Shorter
    vectors count as filled up with zeros.  Repeated candidate rows are
    candidates each; of queries with one vec_id the smallest vector is asked.
    Ties go to smaller vec_ids; with fewer than k candidates all are returned.
    Products up to 2**53 are exact.
    """
    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v")).where(
            "vec_id is not null and v is not null")

    data = written(prepared(vectors), "vectors")
    asked = written(prepared(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = data.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"),
                    F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    n_queries, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not size["n"] or not n_queries:
        return data.sparkSession.createDataFrame([], empty)
    longest, width = float(size["longest"]), max(size["width"], wide)
    sample = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(routers).collect()  # `routers` rows
    sample_ids = np.array([r["vec_id"] for r in sample])
    sample_x = _matrix((r["v"] for r in sample), width)
    leaves = pages(data, sample_x[:max(1, min(routers, size["n"] // page))], longest, width, page)

    blocks = -(-n_queries // block)

    def first_bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's k-th best score among the sampled rows: its k best are no worse."""
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            x = _matrix(batch.column("v").to_pylist(), width)
            scores = x @ sample_x.T
            scores[ids[:, None] == sample_ids] = -np.inf
            floor = np.sort(scores, axis=1)[:, -k] if len(sample_ids) >= k else np.full(len(ids), -np.inf)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "floor": pa.array(floor),
                                              "q": pa.array([r.tobytes() for r in x], pa.binary())})

    bounded = asked.mapInArrow(first_bounds, "vec_id long, floor double, q binary").withColumn(
        "block", F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)"))
    groups = max(1, -(-size["n"] // (page * GROUP_PAGES)))
    grouped = leaves.withColumn("grp", F.expr(f"cast(pmod(xxhash64(page), {groups}) as int)"))
    left = bounded.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(asked_: pd.DataFrame, nodes_: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        if len(asked_) and len(nodes_):
            nodes = []
            for n in nodes_.itertuples():
                ids = np.frombuffer(n.ids, np.int64)
                nodes.append({"ids": ids, "vectors": np.frombuffer(n.vectors).reshape(len(ids), -1),
                              "distances": np.frombuffer(n.distances), "object": np.frombuffer(n.object),
                              "radius": n.radius})
            x = np.stack([np.frombuffer(q) for q in asked_["q"]])
            rows = list(search(asked_["vec_id"].to_numpy(), x, asked_["floor"].to_numpy(), nodes, longest, k))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInPandas(
        visit, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def report(embeddings: DataFrame) -> DataFrame:
    """The registered query: every row whose vec_id is divisible by 50 against all rows."""
    return top_k(embeddings, embeddings.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
