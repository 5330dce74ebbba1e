"""Boosted trees: exact splits, L1/L2 leaves, patience, one pass a guess, attributions and written results in SQL."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cosecha.functions.numeric import round_half_up
from cosecha.operators import boosting as B
from cosecha.operators import model as M
from cosecha.operators.boosting import BoostParams, fit

from conftest import SF_SMALL


def rows(n=600, seed=1, missing=0.0):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        x, y, z = rnd.random(), rnd.randrange(6), rnd.gauss(0, 1)
        t = 3 * x - 2 * (y == 2) + 0.3 * z * y + rnd.gauss(0, 0.05)
        out.append((k, None if rnd.random() < missing else x, float(y), z, t, "val" if k % 5 == 0 else "train"))
    return out


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, "id int, x double, y double, z double, t double, split string").repartition(parts)


def by_hand(data, p, rounds):
    """The same boosting on plain arrays, every cut between two values tried; no sampling, no missing values."""
    x = np.array([r[1:4] for r in data if r[5] == "train"], float)
    t = np.array([r[4] for r in data if r[5] == "train"])
    pred = np.full(len(t), t.mean())
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0), g)
    score = lambda g, h: soft(g) ** 2 / (h + p.l2)

    def leaf(at, depth):
        g, h = (pred - t)[at].sum(), len(at)
        best = (1e-9, None)
        for f in range(3) if depth else ():
            for c in np.unique(x[at, f])[:-1]:
                left, right = at[x[at, f] <= c], at[x[at, f] > c]
                if min(len(left), len(right)) < p.min_child:
                    continue
                gl = (pred - t)[left].sum()
                gain = (score(gl, len(left)) + score(g - gl, len(right)) - score(g, h)) / 2
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (left, right))
        if best[1] is None:
            step[at] = -p.rate * soft(g) / (h + p.l2)
        else:
            for part in best[1]:
                leaf(part, depth - 1)

    for _ in range(rounds):
        step = np.zeros(len(t))
        leaf(np.arange(len(t)), p.depth)
        pred = pred + step
    return pred


def test_equals_boosting_by_hand(spark):
    """Few enough values that every cut is a cut point: predictions agree to the last digits."""
    rnd = random.Random(3)
    data = [(k, float(rnd.randrange(9)), float(rnd.randrange(5)), float(rnd.randrange(20)), rnd.gauss(0, 1) + k % 7, "train")
            for k in range(400)]
    data = [(k, x, y, z, t + 2 * (x > 4) * (y < 2) - z / 5, s) for k, x, y, z, t, s in data]
    for p in (BoostParams(rounds=6, depth=3, rate=0.3, row_share=1, feature_share=1, bins=200, l1=2.0, l2=3.0),
              BoostParams(rounds=4, depth=4, rate=0.5, row_share=1, feature_share=1, bins=200, l1=0, l2=0, min_child=1)):
        model = fit(frame(spark, data), ["x", "y", "z"], "t", p)
        got = model.score(np.array([r[1:4] for r in data], float))
        assert model.n_trees == p.rounds
        assert np.allclose(got, by_hand(data, p, p.rounds), atol=1e-9)


def test_regularisation_shrinks_leaves(spark):
    df = frame(spark, rows())
    sizes = []
    for l1, l2 in ((0, 0), (0, 200), (20, 0), (1e9, 0)):
        m = fit(df, ["x", "y", "z"], "t", BoostParams(rounds=3, depth=2, l1=l1, l2=l2, row_share=1, feature_share=1))
        sizes.append(sum(np.abs(t.value).sum() for t in m.trees))
    assert sizes[0] > sizes[1] > 0 and sizes[0] > sizes[2] > 0 and sizes[3] == 0


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_same_model_whatever_was_guessed(spark, monkeypatch, missing):
    """A sample of a few rows, other partitions and cuts of the lineage change the passes and nothing else."""
    p = BoostParams(rounds=7, depth=4, rate=0.3)
    data = rows(missing=missing)
    one = fit(frame(spark, data), ["x", "y", "z"], "t", p)
    monkeypatch.setattr(B, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    monkeypatch.setattr(B, "COLLECTED", 2)
    monkeypatch.setattr(B, "MOVE_EVERY", 2)
    monkeypatch.setattr(B, "CUT_EVERY", 4)
    two = fit(frame(spark, data, 7), ["x", "y", "z"], "t", p)
    assert one.passes <= p.rounds + 2 < two.passes <= (p.rounds + 1) * p.depth
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data], float)
    assert np.allclose(one.score(x), two.score(x), atol=1e-9)
    assert np.allclose(one.losses, two.losses, atol=1e-9)


def test_patience_keeps_the_best_round(spark):
    p = BoostParams(rounds=200, patience=5, depth=3, rate=0.5)
    m = fit(frame(spark, rows()), ["x", "y", "z"], "t", p)
    assert m.n_trees == 1 + int(np.argmin(m.losses)) > 5
    assert len(m.losses) == min(p.rounds, m.n_trees + p.patience)
    df = frame(spark, rows()).withColumn("p", m.prediction())
    r2 = {r.split: r.r2 for r in M.regression_metrics(df, "t", "p").collect()}
    assert r2["val"] > 0.9 and r2["train"] > 0.9
    val = df.where("split = 'val'").selectExpr("sqrt(avg((t - p) * (t - p)))").first()[0]
    assert math.isclose(val, min(m.losses), rel_tol=1e-9)


def test_odd_inputs(spark):
    p = BoostParams(rounds=3, depth=2, rate=0.5)
    assert fit(frame(spark, []), ["x"], "t", p).n_trees == 0
    only = [(k, None, 1.0, float("nan"), 2.0, "train") for k in range(20)] + [(99, None, None, None, None, "val")]
    m = fit(frame(spark, only), ["x", "y", "z"], "t", p)
    assert np.allclose(m.score(np.full((2, 3), np.nan)), 2.0)
    no_val = fit(frame(spark, [(*r[:5], "train") for r in rows(100)]), ["x", "y"], "t", p)
    assert no_val.n_trees == 3 and no_val.losses == []


def test_shapley_values_equal_all_coalitions(spark, tmp_path):
    m = fit(frame(spark, rows(missing=0.1)), ["x", "y", "z"], "t", BoostParams(rounds=8, depth=4, rate=0.4))
    base = {"x": 0.5, "y": None, "z": 0.1}
    b = np.array([0.5, np.nan, 0.1])
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows(60, 5, 0.1)], float)
    want = np.zeros(x.shape)
    for order in itertools.permutations(range(3)):
        at = np.tile(b, (len(x), 1))
        for f in order:
            before = m.score(at)
            at[:, f] = x[:, f]
            want[:, f] += (m.score(at) - before) / 6
    assert np.allclose(m.shapley(x, b), want, atol=1e-12)
    m.save(spark, str(tmp_path))
    again = B.BoostedTrees.load(spark, str(tmp_path))
    assert np.array_equal(again.score(x), m.score(x)) and again.losses == m.losses
    out = again.attribute(frame(spark, rows(60, 5, 0.1)), base).collect()
    assert all(math.isclose(r.shap_x + r.shap_y + r.shap_z, r.prediccion - r.prediccion_base, abs_tol=1e-9) for r in out)


def test_written_results_in_sql(spark, tmp_path):
    """Metrics of the written predictions, and additivity of every written attribution, by DuckDB."""
    from cosecha.plans import q_model
    from cosecha.plans import datasets as DS
    q_model.q_predict_gbt(spark, SF_SMALL).write.parquet(str(tmp_path / "p"))
    q_model.q_attribution_gbt(spark, SF_SMALL).write.parquet(str(tmp_path / "a"))
    got = {r.split: (r.n, r.r2, r.rmse, r.mae) for r in q_model.q_train_gbt(spark, SF_SMALL).collect()}
    want = duckdb.sql(f"""
        SELECT split, count(*), 1 - sum((rendimiento - prediccion)^2) / (var_pop(rendimiento) * count(*)),
               sqrt(avg((rendimiento - prediccion)^2)), avg(abs(rendimiento - prediccion))
        FROM '{tmp_path}/p/*.parquet' GROUP BY split""").fetchall()
    assert set(got) == {r[0] for r in want}
    for split, n, r2, rmse, mae in want:
        assert got[split][0] == n and all(abs(a - b) < 1e-4 for a, b in zip(got[split][1:], (r2, rmse, mae)))
    total = " + ".join(f"shap_{f}" for f in DS.FEATURES)
    rows_, bad = duckdb.sql(f"SELECT count(*), count_if(abs({total} + prediccion_base - prediccion) > 1e-9) "
                            f"FROM '{tmp_path}/a/*.parquet'").fetchall()[0]
    assert rows_ == got["test"][0] and bad == 0


def test_rounding_leaves_what_is_out_of_range(spark):
    df = spark.createDataFrame([(1e30,), (-1e30,), (2.345,), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(round_half_up("x", 2)).collect()] == [1e30, -1e30, 2.35, None, float("inf")]
