"""Climate operators: provincial rollup (A1), physical limits (C4),
sparse-column drop (C6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

# Physical limits per climate variable (lower, upper), inclusive.
PHYSICAL_LIMITS = {
    "t_media":     (-20.0, 45.0),
    "t_max_abs":   (-15.0, 50.0),
    "t_min_abs":   (-30.0, 40.0),
    "t_max_med":   (-20.0, 48.0),
    "t_min_med":   (-25.0, 42.0),
    "precip_mm":   (0.0, 1000.0),
    "dias_precip": (0.0, 31.0),
    "horas_sol":   (0.0, 400.0),
    "hr_media":    (0.0, 100.0),
}


def climate_rollup(clima_mensual: DataFrame) -> DataFrame:
    """Province × month climate (the reference's ``clima_provincial`` view).

    One aggregate with map-side partial aggregation; the station table is never
    collected.  Rounding goes through DECIMAL so ties round half-up.
    """
    return (clima_mensual.filter(F.col("cod_provincia").isNotNull())
            .groupBy("cod_provincia", "anio", "mes")
            .agg(round_half_up(F.avg("t_media"), 1).alias("t_media_c"),
                 round_half_up(F.max("t_max_abs"), 1).alias("t_max_abs_c"),
                 round_half_up(F.min("t_min_abs"), 1).alias("t_min_abs_c"),
                 round_half_up(F.avg("precip_mm"), 1).alias("precip_media_mm"),
                 round_half_up(F.avg("horas_sol"), 1).alias("horas_sol_med"),
                 round_half_up(F.avg("hr_media"), 1).alias("hr_media_pct"),
                 F.count(F.lit(1)).alias("n_estaciones")))


def apply_physical_limits(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Values outside [lo, hi] become NULL (limits inclusive), other columns kept."""
    limits = limits or PHYSICAL_LIMITS
    out = []
    for c in df.columns:
        if c in limits:
            lo, hi = limits[c]
            out.append(F.when(F.col(c).between(lo, hi), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def physical_limit_counts(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """How many values each limit nulls, in one pass (long format)."""
    limits = {k: v for k, v in (limits or PHYSICAL_LIMITS).items() if k in df.columns}
    aggs = [F.count_if(F.col(c).isNotNull() & ~F.col(c).between(lo, hi)).alias(c)
            for c, (lo, hi) in limits.items()]
    wide = df.agg(*aggs)
    return wide.unpivot([], list(limits), "variable", "n_fuera_rango")


def sparse_columns(df: DataFrame, cols: list[str], threshold: float = 0.85) -> DataFrame:
    """Null ratio per column from one aggregate, with a drop flag."""
    n = F.count(F.lit(1))
    wide = df.agg(*[(F.count_if(F.col(c).isNull()) / n).alias(c) for c in cols])
    long = wide.unpivot([], cols, "columna", "ratio_nulos")
    return long.withColumn("descartar", F.col("ratio_nulos") > threshold)


def drop_sparse_columns(df: DataFrame, cols: list[str], threshold: float = 0.85) -> DataFrame:
    """Drop the candidate columns whose NULL ratio exceeds ``threshold``.

    The ratios come from one aggregate (one row to the driver); the schema
    decision is the only thing taken on the driver.
    """
    row = sparse_columns(df, cols, threshold).filter("descartar").select("columna").collect()
    return df.drop(*[r.columna for r in row])
