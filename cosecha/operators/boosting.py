"""Boosted regression trees with L1/L2 leaf weights, grown one tree a round (M2, M4).

The training state is one table of row blocks: the binned features (a byte
each), the target and the running prediction.  A round grows one tree.  In a
pass every partition adds up gradient histograms of the nodes its rows are at,
the sums of the partitions meet in a tree reduction, and the driver picks
splits from a table whose size depends on nodes, features and bins alone.  To
need fewer passes than levels, splits are guessed on a bounded sample first
and rows follow the guesses: a node's histogram is the sum of those below it,
so one pass checks all levels.  A guess stands only if it is the best split of
the whole histogram; below any other the next pass goes on.  The tree is the
same whatever was guessed, and passes are never more than levels.  No tree is
ever fitted twice.  The running prediction is moved on every ``MOVE_EVERY``
rounds; in between a pass adds the few trees that it lacks, which costs less
than keeping the blocks anew.  The first pass of a round also adds up the
validation loss.  Blocks are written to the shared folder every ``CUT_EVERY``
rounds, which ends their lineage.

A fitted model is a handful of arrays.  It scores rows in Arrow batches, and
gives each row its exact Shapley values against one baseline row, leaf by
leaf: a leaf is reached by a coalition that holds the features for which only
the row goes its way and none of those for which only the baseline does, and
such a game has a closed form.  Work is linear in rows and leaves; nothing is
exploded or shuffled.
"""

from __future__ import annotations

import json
import math
import operator
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, scratch_path, spread

MOVE_EVERY = 4
CUT_EVERY = 24
BLOCK_ROWS = 1 << 16
COLLECTED = 64  # partitions whose histograms the driver adds up itself
SAMPLE_ROWS = 1 << 14  # train rows, about, that splits are guessed on
ACCURACY = 10_000  # of the quantiles that features are cut at: ranks are off by one in so many at most

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins, target, val?, key, prediction


@dataclass(frozen=True)
class BoostParams:
    """800 rounds of depth 5 at rate 0.05, 0.8 of rows and features a tree, a
    child weight of 5, L1 0.1, L2 1.0, 30 rounds of patience."""

    rounds: int = 800
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_child: float = 5.0
    l1: float = 0.1
    l2: float = 1.0
    patience: int = 30
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order; ``feature`` is -1 at a leaf.  A value up to ``cut`` goes left, a missing one as told."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n))

    def levels(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def nodes_of_bins(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each binned row is at after ``levels`` splits."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            b = bins[rows, np.maximum(f, 0)]
            right = np.where(b == 0, ~self.missing_left[node], b > self.bin[node])
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.levels()):
            f = self.feature[node]
            v = x[rows, np.maximum(f, 0)]
            right = np.where(np.isnan(v), ~self.missing_left[node], v > self.cut[node])
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return self.value[node]

    def leaves(self) -> Iterator[tuple[float, dict[int, tuple[float, float, bool]]]]:
        """(value, feature -> (above, up to, whether missing passes)) of each leaf."""
        def walk(node: int, path: dict[int, tuple[float, float, bool]]):
            f = int(self.feature[node])
            if f < 0:
                yield float(self.value[node]), path
                return
            low, high, lost = path.get(f, (-math.inf, math.inf, True))
            cut, left = float(self.cut[node]), bool(self.missing_left[node])
            yield from walk(2 * node + 1, path | {f: (low, min(high, cut), lost and left)})
            yield from walk(2 * node + 2, path | {f: (max(low, cut), high, lost and not left)})

        yield from walk(0, {})


@dataclass
class BoostedTrees:
    """A fitted model: ``base`` plus the trees up to the best round."""

    features: list[str]
    base: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)  # validation RMSE after each round tried
    passes: int = 0  # over the training state

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.score(x)
        return out

    def shapley(self, x: np.ndarray, baseline: np.ndarray) -> np.ndarray:
        """Exact Shapley values, rows by features, of score(x) - score(baseline)."""
        out = np.zeros(x.shape)
        k = x.shape[1]
        w = np.zeros((k + 1, k + 1))  # a features that must be in, b that must not: weight of one of the a
        for a in range(1, k + 1):
            for b in range(k + 1 - a):
                w[a, b] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
        for tree in self.trees:
            for value, path in tree.leaves():
                names = list(path)
                if not names or value == 0.0:
                    continue
                def passes(v: np.ndarray, bounds: tuple[float, float, bool]) -> np.ndarray:
                    return np.where(np.isnan(v), bounds[2], (v > bounds[0]) & (v <= bounds[1]))
                own = np.stack([passes(x[:, f], path[f]) for f in names], axis=1)
                base = np.array([bool(passes(baseline[f:f + 1], path[f])[0]) for f in names])
                inside, outside = own & ~base, ~own & base
                a, b = inside.sum(axis=1), outside.sum(axis=1)
                reached = (own | base).all(axis=1)
                plus = np.where(reached & (a > 0), value * w[a, b], 0.0)
                minus = np.where(reached & (b > 0), value * w[b, a], 0.0)
                for j, f in enumerate(names):
                    out[:, f] += np.where(inside[:, j], plus, 0.0) - np.where(outside[:, j], minus, 0.0)
        return out

    def prediction(self) -> Column:
        """The score of each row as a column over the model's features (null: missing)."""
        model = self
        importable(SparkSession.active())

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.score(_matrix(columns)))

        return scored(*[F.col(f).cast("double") for f in self.features])

    def attribute(self, df: DataFrame, baseline: dict[str, float], prefix: str = "shap_") -> DataFrame:
        """``df`` with a Shapley value for each feature, ``prediccion`` and ``prediccion_base``.

        The values of a row add up to its prediction less that of the baseline.
        """
        model, k = self, len(self.features)
        importable(df.sparkSession)
        base = np.array([np.nan if baseline[f] is None else float(baseline[f]) for f in self.features])
        start = float(self.score(base[None, :])[0])

        @F.pandas_udf("array<double>")
        def explained(*columns: pd.Series) -> pd.Series:
            x = _matrix(columns)
            return pd.Series(list(np.column_stack([model.shapley(x, base), model.score(x)])), dtype=object)

        out = df.withColumn("_explained", explained(*[F.col(f).cast("double") for f in self.features]))
        got = [F.col("_explained")[i].alias(f"{prefix}{f}") for i, f in enumerate(self.features)]
        return out.select(*[F.col(c) for c in df.columns], *got, F.col("_explained")[k].alias("prediccion"),
                          F.lit(start).alias("prediccion_base"))

    def importance(self) -> dict[str, int]:
        """How many splits use each feature."""
        used = np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.empty(0, np.int64)])
        return {f: int((used == i).sum()) for i, f in enumerate(self.features)}

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows (tree, node, feature, cut, missing_left, value), features by name."""
        rows = [(t, n, self.features[f] if f >= 0 else None, float(x.cut[n]), bool(x.missing_left[n]),
                 float(x.value[n])) for t, x in enumerate(self.trees) for n, f in enumerate(x.feature)]
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, missing_left boolean, "
                                           "value double")

    def save(self, spark: SparkSession, path: str) -> None:
        head = json.dumps({"features": self.features, "base": self.base, "losses": self.losses})
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        head = json.loads(spark.read.parquet(f"{path}/head").first()[0])
        place = {f: i for i, f in enumerate(head["features"])}
        trees: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/trees").collect():  # a model, not data
            trees.setdefault(r.tree, []).append(r)
        out = []
        for t in sorted(trees):
            rows = sorted(trees[t], key=lambda r: r.node)
            out.append(Tree(np.array([place.get(r.feature, -1) for r in rows]), np.zeros(len(rows), np.int64),
                            np.array([r.cut for r in rows]), np.array([r.missing_left for r in rows]),
                            np.array([r.value for r in rows])))
        return cls(head["features"], head["base"], out, head["losses"])


def _matrix(columns: Iterable[pd.Series]) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])


# ------------------------------------------------------------------ training


def cut_points(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 increasing cut points for each feature, from approximate quantiles (one aggregate)."""
    probs = [i / bins for i in range(1, bins)]
    got = train.agg(*[F.percentile_approx(F.col(f).cast("double"), probs, ACCURACY).alias(f"q{i}")
                      for i, f in enumerate(features)]).first()
    return [np.unique(np.array(got[f"q{i}"] or [], np.float64)) for i in range(len(features))]


def _blocks(rows: DataFrame, features: list[str], target: str, split: str, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, y, val, key): blocks of train and validation rows; bin 0 is a missing value."""
    source = rows.where(F.col(split).isin("train", "val") & F.col(target).isNotNull()).select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
        F.col(target).cast("double").alias("y"), (F.col(split) == "val").alias("val"),
        F.xxhash64(*features, target).alias("key"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                bins = np.zeros((part.num_rows, len(cuts)), np.uint8)
                for i, c in enumerate(cuts):
                    x = part.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                    bins[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, side="left"))
                y = part.column(len(cuts)).to_numpy(zero_copy_only=False).astype(np.float64)
                val = part.column(len(cuts) + 1).to_numpy(zero_copy_only=False).astype(bool)
                key = part.column(len(cuts) + 2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({name: pa.array([x.tobytes()], pa.binary()) for name, x in (
                    ("bins", bins), ("y", y), ("val", val), ("key", key))})

    return source.mapInArrow(cut, "bins binary, y binary, val binary, key binary")


def _uniform(key: np.ndarray, *seed: int) -> np.ndarray:
    """A number in [0, 1) for each row from its hash: the same wherever it lies and however often a task runs."""
    x = key.view(np.uint64) ^ np.random.Generator(np.random.PCG64(seed)).integers(1 << 63, dtype=np.uint64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the splitmix64 constants
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _sums(block: Block, tree: Tree, slots: np.ndarray, n_slots: int, width: int, p: BoostParams,
          round_: int) -> np.ndarray:
    """Sums [slot, feature, bin, (gradient, rows)] over a block's sampled train rows."""
    bins, y, val, key, pred = block
    slot = slots[tree.nodes_of_bins(bins, tree.levels())]
    use = np.flatnonzero((slot >= 0) & ~val & (_uniform(key, p.seed, round_) < p.row_share))
    slot, own, g = slot[use] * width, bins[use], (pred - y)[use]
    out = np.empty((n_slots, bins.shape[1], width, 2))
    for f in range(bins.shape[1]):
        at = slot + own[:, f]
        out[:, f, :, 0] = np.bincount(at, g, n_slots * width).reshape(n_slots, width)
        out[:, f, :, 1] = np.bincount(at, minlength=n_slots * width).reshape(n_slots, width)
    return out


def _on(block: Block, trees: list[Tree]) -> Block:
    """The block with its running prediction moved on by ``trees``."""
    bins, y, val, key, pred = block
    for t in trees:
        pred = pred + t.value[t.nodes_of_bins(bins, t.levels())]
    return bins, y, val, key, pred


def _pass(state: RDD, lacks: list[Tree], tree: Tree, slots: np.ndarray, n_slots: int, k: int, width: int,
          p: BoostParams, round_: int) -> tuple[np.ndarray, float, float]:
    """``_sums`` of all blocks, and the validation error and count before this tree."""

    def add(blocks: Iterable[Block]) -> Iterator[np.ndarray]:
        out = np.zeros(n_slots * k * width * 2 + 2)
        for block in blocks:
            block = _on(block, lacks)
            _, y, val, _, pred = block
            out[0] += float(np.square((pred - y)[val]).sum())
            out[1] += int(val.sum())
            out[2:] += _sums(block, tree, slots, n_slots, width, p, round_).ravel()
        yield out

    parts = state.mapPartitions(add)
    if state.getNumPartitions() <= COLLECTED:
        got = np.sum(parts.collect(), axis=0)
    else:
        got = parts.treeReduce(operator.add, 3)
    return got[2:].reshape(n_slots, k, width, 2), got[0], got[1]


def _threshold(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _weight(g: float, h: float, p: BoostParams) -> float:
    return float(-_threshold(np.array(g), p.l1) / (h + p.l2)) if h + p.l2 > 0 else 0.0


def best_split(sums: np.ndarray, allowed: np.ndarray, p: BoostParams
               ) -> tuple[float, int, int, bool, tuple[float, float], tuple[float, float]] | None:
    """(gain, feature, bin, missing left?, left sums, right sums) of a node's histogram [feature, bin, 2], or None."""
    total = sums[0].sum(axis=0)  # every feature's bins add up to the node
    gain_of = lambda x: np.square(_threshold(x[..., 0], p.l1)) / (x[..., 1] + p.l2 + 1e-300)
    base = gain_of(total)
    lost = sums[:, 0, :]
    up_to = np.cumsum(sums[:, 1:, :], axis=1)
    best = None
    for missing_left in (True, False):
        left = up_to + lost[:, None, :] if missing_left else up_to
        right = total - left
        gain = np.where((left[..., 1] >= p.min_child) & (right[..., 1] >= p.min_child),
                        (gain_of(left) + gain_of(right) - base) / 2, -np.inf)
        gain[~allowed] = -np.inf
        top = gain.max()
        if not top > 1e-9 or best is not None and top <= best[0] * (1 + 1e-9):
            continue
        # Sums in another order differ in their last digits: of splits as good as the best the first is taken.
        f, b = np.unravel_index(int(np.argmax(gain >= top * (1 - 1e-9))), gain.shape)
        best = (float(gain[f, b]), int(f), int(b) + 1, missing_left, tuple(left[f, b]), tuple(right[f, b]))
    return best


class _Grower:
    """Grows trees over the state with the help of a sample, which it keeps up to date."""

    def __init__(self, sample: Block, share: float, k: int, width: int, cuts: list[np.ndarray], p: BoostParams):
        self.sample, self.share, self.k, self.width, self.cuts, self.p = sample, share, k, width, cuts, p

    def move_sample(self, tree: Tree) -> None:
        self.sample = _on(self.sample, [tree])

    def _put(self, tree: Tree, node: int, split) -> None:
        """Make ``node`` split so, or a leaf."""
        if split is None:
            tree.feature[node] = -1
            return
        _, f, b, missing_left, left, right = split
        tree.feature[node], tree.bin[node], tree.missing_left[node] = f, b, missing_left
        tree.cut[node] = self.cuts[f][b - 1] if b <= len(self.cuts[f]) else math.inf
        for child, (g, h) in ((2 * node + 1, left), (2 * node + 2, right)):
            tree.value[child] = self.p.rate * _weight(g, h, self.p)

    def _guess(self, tree: Tree, nodes: list[int], allowed: np.ndarray, round_: int) -> None:
        """Splits for ``nodes`` and all below them from the sample."""
        first_leaf = len(tree.feature) // 2
        nodes = [n for n in nodes if n < first_leaf]
        while nodes:
            for n in nodes:
                tree.feature[n] = -1
            slots = np.full(len(tree.feature), -1, np.int64)
            slots[nodes] = np.arange(len(nodes))
            sums = _sums(self.sample, tree, slots, len(nodes), self.width, self.p, round_) / self.share
            for n, own in zip(nodes, sums):
                self._put(tree, n, best_split(own, allowed, self.p))
            nodes = [c for n in nodes if tree.feature[n] >= 0 for c in (2 * n + 1, 2 * n + 2) if c < first_leaf]

    def grow(self, state: RDD, lacks: list[Tree], round_: int) -> tuple[Tree, float, float, int]:
        """One tree, the validation error and count before it, and the passes that it took.

        ``lacks`` are the trees that the state's prediction has not yet.
        """
        k, p = self.k, self.p
        allowed = np.zeros(k, bool)
        chosen = np.random.Generator(np.random.PCG64([p.seed, round_])).permutation(k)
        allowed[chosen[:max(1, int(p.feature_share * k))]] = True
        tree = Tree.empty(p.depth)
        first_leaf = len(tree.feature) // 2
        open_, passes, error, count = [0], 0, 0.0, 0.0
        while open_:
            self._guess(tree, open_, allowed, round_)
            # Rows are counted at the lowest inner node on their way; the children of the last level are leaves.
            below = [n for o in open_ for n in self._under(tree, o)]
            read = [n for n in below if 2 * n + 1 >= first_leaf or tree.feature[n] < 0]
            counted = tree if not read else self._up_to(tree, read)
            slots = np.full(len(tree.feature), -1, np.int64)
            slots[read] = np.arange(len(read))
            found, e, c = _pass(state, lacks, counted, slots, len(read), k, self.width, p, round_)
            if passes == 0:
                error, count = e, c
            passes += 1
            sums = {n: found[i] for i, n in enumerate(read)}
            for n in sorted(below, reverse=True):
                if n not in sums:
                    sums[n] = sums[2 * n + 1] + sums[2 * n + 2]
            if 0 in sums:
                g, h = sums[0][0].sum(axis=0)
                tree.value[0] = p.rate * _weight(g, h, p)
            again, check = [], list(open_)
            while check:
                n = check.pop()
                split = best_split(sums[n], allowed, p)
                guessed = (tree.feature[n], tree.bin[n], tree.missing_left[n]) if tree.feature[n] >= 0 else None
                right = guessed == (split[1:4] if split else None)
                self._put(tree, n, split)
                children = [c for c in (2 * n + 1, 2 * n + 2) if split and c < first_leaf]
                (check if right else again).extend(children)
            open_ = sorted(again)
        return tree, error, count, passes

    @staticmethod
    def _under(tree: Tree, node: int) -> list[int]:
        """The inner nodes and would-be inner nodes of a subtree."""
        first_leaf = len(tree.feature) // 2
        out, at = [], [node]
        while at:
            n = at.pop()
            out.append(n)
            if tree.feature[n] >= 0 and 2 * n + 1 < first_leaf:
                at += [2 * n + 1, 2 * n + 2]
        return out

    @staticmethod
    def _up_to(tree: Tree, read: list[int]) -> Tree:
        """The tree cut off at the nodes that are read."""
        feature = tree.feature.copy()
        feature[read] = -1
        return Tree(feature, tree.bin, tree.cut, tree.missing_left, tree.value)


def _state(spark: SparkSession, path: str, k: int, base: float, partitions: int) -> RDD:
    """The written blocks, joined to about ``BLOCK_ROWS`` rows each."""

    def joined(blocks: list[Block]) -> Block:
        return tuple(np.concatenate(x) for x in zip(*blocks))

    def read(rows: Iterable) -> Iterator[Block]:
        held: list[Block] = []
        for r in rows:
            y = np.frombuffer(r.y, np.float64)
            pred = np.full(len(y), base) if r.pred is None else np.frombuffer(r.pred, np.float64)
            held.append((np.frombuffer(r.bins, np.uint8).reshape(-1, k), y, np.frombuffer(r.val, bool),
                         np.frombuffer(r.key, np.int64), pred))
            if sum(len(b[1]) for b in held) >= BLOCK_ROWS:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    return spark.read.parquet(path).rdd.coalesce(partitions).mapPartitions(read)


def _write(spark: SparkSession, state: RDD, path: str) -> None:
    rows = state.map(lambda b: tuple(x.tobytes() for x in b))
    spark.createDataFrame(rows, "bins binary, y binary, val binary, key binary, pred binary").write.parquet(path)


def _sample(state: RDD, share: float, seed: int) -> Block:
    """About ``SAMPLE_ROWS`` train rows, chosen by their hash, for the driver."""

    def take(block: Block) -> Block:
        _, _, val, key, _ = block
        held = np.flatnonzero(~val & (_uniform(key, seed, 1 << 20) < share))
        return tuple(x[held] for x in block)

    return tuple(np.concatenate(x) for x in zip(*state.map(take).collect()))


def fit(rows: DataFrame, features: list[str], target: str, p: BoostParams = BoostParams(),
        split: str = "split") -> BoostedTrees:
    """Boosted trees of the ``train`` rows, stopped by the loss of the ``val`` rows.

    Rounds end when the validation loss has not fallen for ``patience`` rounds
    (or at ``rounds``); the model keeps the trees up to the best round.
    Without validation rows all rounds are kept.  Rows without a target take
    no part; a null or NaN feature is missing and each split learns which way
    it goes.  Without train rows the model is the constant 0.
    """
    if not 2 <= p.bins <= 255:
        raise ValueError(f"bins must be 2 to 255, not {p.bins}")
    spark = rows.sparkSession
    importable(spark)
    train = rows.where((F.col(split) == "train") & F.col(target).isNotNull())
    cuts = cut_points(train, features, p.bins)
    k, width = len(features), max(len(c) for c in cuts) + 2
    base, count = train.agg(F.avg(F.col(target).cast("double")), F.count(F.lit(1))).first()
    if base is None:
        return BoostedTrees(features, 0.0, [])
    path = scratch_path(spark, f"boosting-{uuid.uuid4().hex[:12]}")
    (spread(_blocks(rows, features, target, split, cuts)).withColumn("pred", F.lit(None).cast("binary"))
     .write.parquet(f"{path}/0"))
    partitions = -(-count // BLOCK_ROWS)  # with fewer rows a task costs more than its work
    state = _state(spark, f"{path}/0", k, base, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    share = min(1.0, SAMPLE_ROWS / count)
    grower = _Grower(_sample(state, share, p.seed), share, k, width, cuts, p)
    behind = None  # the state before, which the first pass over the next one reads once more
    trees: list[Tree] = []
    lacks: list[Tree] = []
    losses: list[float] = []
    passes = 0
    best = 0  # trees up to the best round
    for round_ in range(p.rounds + 1):
        tree, error, count, used = grower.grow(state, lacks, round_)
        passes += used
        if behind is not None:
            behind.unpersist()
            behind = None
        if round_ and count:
            losses.append(math.sqrt(error / count))
            best = best if best and losses[best - 1] <= losses[-1] else len(losses)
            if len(losses) - best >= p.patience:
                break
        if round_ == p.rounds or tree.feature[0] < 0 and tree.value[0] == 0.0:
            break
        trees.append(tree)
        lacks.append(tree)
        grower.move_sample(tree)
        if len(lacks) == MOVE_EVERY:
            done, lacks = lacks, []
            moved = state.map(lambda block, done=done: _on(block, done), preservesPartitioning=True)
            if len(trees) % CUT_EVERY == 0:
                _write(spark, moved, f"{path}/{len(trees)}")
                moved = _state(spark, f"{path}/{len(trees)}", k, base, partitions)
            behind, state = state, moved.persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    return BoostedTrees(features, float(base), trees[:best] if losses else trees, losses, passes)
