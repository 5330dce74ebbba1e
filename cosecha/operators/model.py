"""Model operators (M1, M3-M5, A14, A15, A17); boosted trees are in ``boosting``.

* ``hash_split``: deterministic train / val / test split from a hash of the
  row key (no shuffle, no driver state, stable when data grows).
* ``regression_metrics``: R², RMSE, MAE and n per split in one aggregate.
* ``fit_ols`` / ``linear_attribution``: least squares from sufficient
  statistics (one aggregate of means and covariances; the k×k solve runs on
  the driver, as Spark ML's normal-equation solver does) and the exact
  contributions ``coef·(x - mean)``.
* ``attribution_summary`` / ``attribution_by_group``: long-format summaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..session import spread


def hash_bucket(keys: list[str], seed: int = 42, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the first 32 bits of md5(key|seed)."""
    s = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_split(df: DataFrame, keys: list[str], test: float = 0.15, val: float = 0.15,
               seed: int = 42) -> DataFrame:
    """Adds ``split`` ∈ {train, val, test} (M1)."""
    b = hash_bucket(keys, seed)
    t_cut, v_cut = round(test * 100), round((test + val) * 100)
    split = F.when(b < t_cut, "test").when(b < v_cut, "val").otherwise("train")
    return spread(df).withColumn("split", split)


def regression_metrics(pred: DataFrame, y: str, p: str, split: str = "split") -> DataFrame:
    """R² = 1 - SSres/SStot (4 decimals), RMSE, MAE (6 decimals), n per split."""
    g = pred.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(y) - F.col(p)) ** 2).alias("_ssr"),
        F.var_pop(y).alias("_var"),
        F.avg(F.abs(F.col(y) - F.col(p))).alias("_mae"))
    return g.select(split, "n",
                    round_half_up(F.lit(1.0) - F.try_divide(F.col("_ssr"), F.col("_var") * F.col("n")), 4).alias("r2"),
                    round_half_up(F.sqrt(F.col("_ssr") / F.col("n")), 6).alias("rmse"),
                    round_half_up("_mae", 6).alias("mae"))


def r2_gap(metrics: DataFrame, threshold: float = 0.15, split: str = "split") -> DataFrame:
    """Over-fitting check: R²(train) - R²(test) and whether it exceeds the threshold."""
    r = metrics.groupBy().pivot(split, ["train", "test"]).agg(F.first("r2"))
    gap = round_half_up(F.col("train") - F.col("test"), 4)
    return r.select(F.col("train").alias("r2_train"), F.col("test").alias("r2_test"), gap.alias("gap_r2"),
                    (gap > threshold).alias("sobreajuste"))


@dataclass
class LinearModel:
    features: list[str]
    coef: list[float]
    intercept: float
    means: list[float]

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coef):
            out = out + F.lit(c) * F.col(f)
        return out


def fit_ols(df: DataFrame, features: list[str], target: str) -> LinearModel:
    """Ordinary least squares from one aggregate of means and covariances."""
    import numpy as np
    aggs = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)] + [F.avg(target).alias("m_y")]
    for i, a in enumerate(features):
        aggs.append(F.covar_samp(a, target).alias(f"cy_{i}"))
        for j, b in enumerate(features):
            if j >= i:
                aggs.append(F.covar_samp(a, b).alias(f"c_{i}_{j}"))
    r = df.agg(*aggs).first()
    k = len(features)
    cxx = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    cxy = np.array([r[f"cy_{i}"] for i in range(k)], dtype=float)
    coef = np.linalg.solve(cxx, cxy)
    means = [r[f"m_{i}"] for i in range(k)]
    intercept = r["m_y"] - float(np.dot(coef, means))
    return LinearModel(features, [float(c) for c in coef], float(intercept), [float(m) for m in means])


def linear_attribution(df: DataFrame, model: LinearModel, prefix: str = "shap_", digits: int = 4) -> DataFrame:
    """Exact Shapley values of a linear model: coef·(x - mean) per feature (M4)."""
    return df.withColumns({f"{prefix}{f}": round_half_up(F.lit(c) * (F.col(f) - F.lit(m)), digits)
                           for f, c, m in zip(model.features, model.coef, model.means)})


def attribution_summary(attr: DataFrame, features: list[str], prefix: str = "shap_") -> DataFrame:
    """Per feature: mean |φ|, mean φ, population std of φ, sorted."""
    cols = [f"{prefix}{f}" for f in features]
    long = attr.select(*cols).unpivot([], cols, "col", "v")
    return (long.groupBy("col").agg(round_half_up(F.avg(F.abs("v")), 6).alias("shap_mean_abs"),
                                    round_half_up(F.avg("v"), 6).alias("shap_mean"),
                                    round_half_up(F.stddev_pop("v"), 6).alias("shap_std"))
            .select(F.regexp_replace("col", "^" + prefix, "").alias("feature"), "shap_mean_abs", "shap_mean",
                    "shap_std")
            .orderBy(F.col("shap_mean_abs").desc(), "feature"))


def attribution_by_group(attr: DataFrame, features: list[str], group: str, prefix: str = "shap_") -> DataFrame:
    """Mean φ per (group, feature), long format."""
    cols = [f"{prefix}{f}" for f in features]
    long = attr.select(group, *cols).unpivot([group], cols, "col", "v")
    return (long.groupBy(group, "col").agg(round_half_up(F.avg("v"), 6).alias("shap_media"))
            .select(group, F.regexp_replace("col", "^" + prefix, "").alias("feature"), "shap_media"))
