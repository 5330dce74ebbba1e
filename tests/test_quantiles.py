"""Exact quantiles by sketch, bracket and selection agree with Spark's percentile whatever the sizes and names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cosecha.operators import quantiles as Q
from cosecha.operators.impute import impute_by_group
from cosecha.operators.outliers import detect_anomalies, iqr_flag, winsorize_upper

PROBS = {"q0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99, "q100": 1.0}


def rows():
    rnd = random.Random(7)
    out = [("hot", float(rnd.randint(0, 500)) / 7.0) for _ in range(3000)]  # over a third of the rows, with ties
    out += [("hot", 3.0)] * 400 + [("wide", rnd.gauss(0, 1e6)) for _ in range(2500)]
    out += [(f"g{i % 20}", rnd.gauss(10, 3)) for i in range(2000)]
    out += [("const", 5.0)] * 3000 + [("one", 1.0)] + [("nulls", None)] * 3
    return out + [(None, float(k)) for k in range(40)]  # NULL is a group of its own


@pytest.mark.parametrize("sketch,margin", [(Q.SKETCH, Q.MARGIN), (64, 4 * 2.446 / 64 ** 0.9433), (64, 0.0)])
def test_equal_percentile_of_every_group(spark, sketch, margin):
    """Without a margin brackets miss; the counts show it and the whole range is taken."""
    df = spark.createDataFrame(rows(), "k0 string, a double").repartition(5)
    want = {r.k0: r for r in df.groupBy("k0").agg(*[F.percentile("a", p).alias(n) for n, p in PROBS.items()]).collect()}
    got = {r.k0: r for r in Q.quantiles(df, {n: ("a", p) for n, p in PROBS.items()}, ["k0"], margin, sketch).collect()}
    assert set(got) == set(want) and None in got
    for g, w in want.items():
        for n in PROBS:
            assert got[g][n] == w[n] or math.isclose(got[g][n], w[n], rel_tol=1e-12, abs_tol=1e-12), (g, n)


def test_several_columns_over_all_and_any_names(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("xy"), rnd.choice([None, 1, 2]), rnd.gauss(0, 1), None if i % 3 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, b int, a double, n double")
    wanted = {"v": ("a", 0.5), "t": ("n", 0.9), "lo": ("a", 0.01)}
    for group in ([], ["k"], ["k", "b"]):
        got = {tuple(r[g] for g in group): (r.v, r.t, r.lo) for r in Q.quantiles(df, wanted, group).collect()}
        want = {tuple(r[g] for g in group): (r.v, r.t, r.lo) for r in df.groupBy(*group).agg(
            F.percentile("a", 0.5).alias("v"), F.percentile("n", 0.9).alias("t"),
            F.percentile("a", 0.01).alias("lo")).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(x, y, abs_tol=1e-12) for g in got for x, y in zip(got[g], want[g]))


def test_nan_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "g string, v double")
    got = {r.g: (r.lo, r.hi) for r in Q.quantiles(df, {"lo": ("v", 0.5), "hi": ("v", 1.0)}, ["g"]).collect()}
    assert got["a"][0] == 2.0 and math.isnan(got["a"][1]) and math.isnan(got["b"][0])
    none = df.limit(0)
    assert Q.quantiles(none, {"m": ("v", 0.5)}, ["g"]).count() == 0
    assert [r.m for r in Q.quantiles(none, {"m": ("v", 0.5)}, []).collect()] in ([], [None])


def test_building_the_plan_runs_no_job(spark):
    df = spark.createDataFrame(rows(), "g string, x double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantile-plan", "")
    impute_by_group(detect_anomalies(winsorize_upper(iqr_flag(df, "x", ["g"]), "x", ["g"]), "x", ["g"]), ["x"], ["g"])
    assert list(tracker.getJobIdsForGroup("quantile-plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_null_group_keeps_its_median(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 11.0), (None, None), ("a", 2.0), ("a", None)], "g string, x double")
    filled = impute_by_group(df, ["x"], ["g"], require_keys=False)
    assert sorted((r.g or "", r.x) for r in filled.collect()) == [("", 1.0), ("", 6.0), ("", 11.0), ("a", 2.0), ("a", 2.0)]
    kept = impute_by_group(df, ["x"], ["g"])
    assert kept.where("g is null and x is null").count() == 1
