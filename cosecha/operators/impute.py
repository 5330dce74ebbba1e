"""Median imputation.

A group's medians come from ``quantiles`` (exact at every size) and are joined
back on the group key; only NULL cells are filled (``coalesce``), so existing
values never change.  The hierarchical variant runs the levels one after the
other: every level's medians are computed on the output of the previous level
(trap Q6), which a single ``coalesce`` of three independent medians would get
wrong.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .quantiles import group_medians, join_groups


def impute_by_group(df: DataFrame, cols: list[str], group: list[str],
                    require_keys: bool = True, flag_suffix: str | None = None) -> DataFrame:
    """Fill NULLs of ``cols`` with the median of their group.

    Rows whose group key is NULL are left alone when ``require_keys``; else
    they are a group of their own.  With ``flag_suffix`` a boolean
    ``<col><suffix>`` marks the filled cells.
    """
    keyed = F.lit(True)
    for g in group:
        keyed = keyed & F.col(g).isNotNull()
    med = group_medians(df.filter(keyed) if require_keys else df, cols, group)
    j = join_groups(df, med, group)
    out = {}
    for c in cols:
        if flag_suffix:
            out[f"{c}{flag_suffix}"] = F.col(c).isNull() & F.col(f"_med_{c}").isNotNull()
        out[c] = F.coalesce(F.col(c), F.col(f"_med_{c}"))
    return j.withColumns(out).drop(*[f"_med_{c}" for c in cols]).select(
        *df.columns, *[k for k in out if k not in df.columns])


def impute_hierarchical(df: DataFrame, cols: list[str], levels: list[list[str]]) -> DataFrame:
    """Chained median imputation over ``levels``.

    Each level but the last is written to the shared folder: the next one
    reads its input several times, and a lost executor costs one level, not
    the whole chain.
    """
    spark, out = df.sparkSession, df
    for i, g in enumerate(levels):
        out = impute_by_group(out, cols, g)
        if i < len(levels) - 1:
            path = scratch_path(spark, f"impute-{uuid.uuid4().hex[:12]}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
    return out
