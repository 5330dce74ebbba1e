"""Outlier, anomaly and winsorising operators.

Every per-group statistic is one ``groupBy`` aggregate (``avg``,
``stddev_samp``) or an exact quantile (``quantiles``), joined back on the
group key, so work is spread by key and partial aggregation happens map-side.
No group is ever collected; a NULL key is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from .quantiles import group_quantiles, join_groups


def iqr_flag(df: DataFrame, value: str, group: list[str], k: float = 3.0,
             where: Column | None = None, flag: str = "outlier_flag") -> DataFrame:
    """Flag rows outside [q1 - k·iqr, q3 + k·iqr] of their group.

    Only rows matching ``where`` (and with a non-NULL value) take part and can
    be flagged; every other row gets FALSE, so re-running resets old flags.
    """
    cond = F.col(value).isNotNull() if where is None else (where & F.col(value).isNotNull())
    j = join_groups(df, group_quantiles(df.filter(cond), value, group, {"_q1": 0.25, "_q3": 0.75}), group)
    iqr = F.col("_q3") - F.col("_q1")
    out = cond & ((F.col(value) < F.col("_q1") - k * iqr) | (F.col(value) > F.col("_q3") + k * iqr))
    return j.withColumn(flag, F.coalesce(out, F.lit(False))).drop("_q1", "_q3")


def winsorize_upper(df: DataFrame, value: str, group: list[str], p: float = 0.99,
                    raw_col: str | None = None, digits: int = 6) -> DataFrame:
    """Clip ``value`` at its group's p-th percentile (C10), keeping the raw copy.

    The threshold is rounded to ``digits`` (the precision of the value), then
    ``least`` applies it; NULL values stay NULL.
    """
    raw_col = raw_col or f"{value}_raw"
    cap = group_quantiles(df, value, group, {"_cap": p}).select(*group, round_half_up("_cap", digits).alias("_cap"))
    j = join_groups(df.withColumn(raw_col, F.col(value)), cap, group)
    clipped = F.when(F.col(value).isNull() | F.col("_cap").isNull(), F.col(value)) \
        .otherwise(F.least(F.col(value), F.col("_cap")))
    return j.withColumn(value, clipped).drop("_cap")


def zscore(df: DataFrame, value: str, group: list[str], out: str = "z", digits: int = 6) -> DataFrame:
    """(x - mean) / sample std within the group (W7); NULL when std is 0 or NULL."""
    st = (df.filter(F.col(value).isNotNull()).groupBy(*group)
          .agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")))
    z = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))
    return join_groups(df, st, group).withColumn(out, round_half_up(z, digits)).drop("_mean", "_std")


def detect_anomalies(df: DataFrame, value: str, group: list[str], method: str | Column = "ambos",
                     z_thr: float = 2.5, iqr_k: float = 2.0, min_obs: int = 5,
                     keep_all: bool = False) -> DataFrame:
    """Anomalies per group by z-score and/or IQR.

    Groups with fewer than ``min_obs`` non-NULL values are skipped (the batch
    tool uses 5, the dashboard 0).  z uses the sample std and only counts when
    std > 0; the IQR fence only when iqr > 0.  Adds ``z``, ``media``, ``std``
    (unrounded),
    ``q1``, ``q3``, band columns ``lim_inf``/``lim_sup``, ``anomalia`` and the
    label ``tipo`` (alto / bajo by the sign of z).  With ``keep_all=False`` only
    flagged rows are returned.  ``method`` may be a column: each row by its own.
    """
    if isinstance(method, str) and method not in ("zscore", "iqr", "ambos"):
        raise ValueError(f"method must be zscore, iqr or ambos, not {method!r}")
    base = df.filter(F.col(value).isNotNull())
    st = (base.groupBy(*group)
          .agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("media"),
               F.stddev_samp(value).alias("std"))
          .filter(F.col("_n") >= min_obs))
    st = join_groups(st, group_quantiles(base, value, group, {"q1": 0.25, "q3": 0.75}), group, "inner")
    j = join_groups(base, st, group, "inner")
    x, std = F.col(value), F.col("std")
    iqr = F.col("q3") - F.col("q1")
    z = F.when(std > 0, (x - F.col("media")) / std)
    by_z = F.coalesce((std > 0) & (F.abs(z) > z_thr), F.lit(False))
    by_iqr = (iqr > 0) & ((x < F.col("q1") - iqr_k * iqr) | (x > F.col("q3") + iqr_k * iqr))
    m = F.lit(method) if isinstance(method, str) else method
    flag = F.coalesce((m.isin("zscore", "ambos") & by_z) | (m.isin("iqr", "ambos") & by_iqr), F.lit(False))
    out = (j.withColumn("z", round_half_up(z, 6))
           .withColumn("lim_inf", round_half_up(F.col("q1") - iqr_k * iqr, 9))
           .withColumn("lim_sup", round_half_up(F.col("q3") + iqr_k * iqr, 9))
           .withColumn("anomalia", flag)
           .withColumn("tipo", F.when(F.coalesce(z, F.lit(0.0)) > 0, "alto").otherwise("bajo"))
           .withColumn("q1", round_half_up("q1", 9))
           .withColumn("q3", round_half_up("q3", 9))
           .drop("_n"))
    return out if keep_all else out.filter(F.col("anomalia"))


def series_kpis(df: DataFrame, value: str, group: list[str], flagged: str = "anomalia") -> DataFrame:
    """Dashboard KPIs of one or more series (X4): observations, anomalies, their
    share, mean and sample std (NULL for a single observation)."""
    n = F.count(F.col(value))
    return df.groupBy(*group).agg(
        n.alias("observaciones"), F.count_if(F.col(flagged)).alias("anomalias"),
        round_half_up(F.try_divide(F.count_if(F.col(flagged)) * 100.0, n), 1).alias("pct_anomalias"),
        F.avg(value).alias("media"), F.stddev_samp(value).alias("std"))
