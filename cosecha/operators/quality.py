"""Profiles, validity counts and reports.

Each report is one aggregate pass producing a small DataFrame; counts for
every column come from one ``agg`` instead of one query per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from .quantiles import quantiles


def null_profile(df: DataFrame, cols: list[str] | None = None, keep_zero: bool = False) -> DataFrame:
    """NULL count and percentage of every column (A5), long format."""
    cols = cols or df.columns
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "columna", "nulos")
    long = long.select("columna", "nulos",
                       round_half_up(F.try_divide(F.col("nulos") * 100.0, F.col("_n")), 4).alias("pct"))
    return long if keep_zero else long.filter(F.col("nulos") > 0)


def target_stats(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """min, mean, median, max, sample std of a column."""
    one = df.agg(F.lit(0).alias("_one"), F.min(col).alias("_min"), F.avg(col).alias("_avg"), F.max(col).alias("_max"),
                 F.stddev_samp(col).alias("_std"))
    median = quantiles(df.select(F.lit(0).alias("_one"), col), {"_med": (col, 0.5)}, ["_one"])
    names = {"_min": "min", "_avg": "media", "_med": "mediana", "_max": "max", "_std": "std"}
    return one.join(median, "_one", "left").select(
        *[round_half_up(c, 9).alias(f"{prefix}_{n}") for c, n in names.items()])


def dataset_profile(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One-row readiness report of a modelling dataset."""
    nulls = [F.count_if(F.col(c).isNull()) for c in features]
    feat_nulls = reduce(lambda a, b: a + b, nulls)
    all_nulls = feat_nulls + F.count_if(F.col(target).isNull())
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  F.lit(len(df.columns)).alias("columnas"),
                  F.count_distinct("cultivo").alias("cultivos_unicos"),
                  F.count_distinct("cod_provincia").alias("provincias_cubiertas"),
                  F.min("anio").alias("periodo_min"), F.max("anio").alias("periodo_max"),
                  feat_nulls.alias("nulos_en_features"),
                  (all_nulls == 0).alias("dataset_listo"))


def table_summary(df: DataFrame, distinct_cols: list[str], min_col: str, max_col: str) -> DataFrame:
    """COUNT, COUNT DISTINCT of several columns, MIN, MAX in one pass (A2)."""
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  *[F.count_distinct(c).alias(f"distintos_{c}") for c in distinct_cols],
                  F.min(min_col).alias(f"min_{min_col}"), F.max(max_col).alias(f"max_{max_col}"))


def validity_counts(df: DataFrame, rules: dict[str, "F.Column"]) -> DataFrame:
    """Counts of rows breaking each rule, one aggregate (F8)."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])


def quality_report(avances: DataFrame, coyuntura: DataFrame, clima: DataFrame) -> DataFrame:
    """Validation report of all tables (X12): one aggregate per table, long format."""
    a = avances.agg(F.count(F.lit(1)).alias("filas"), F.count_if(F.col("sup_avance") < 0).alias("sup_negativas"),
                    F.count_if(F.col("prod_avance").isNull()).alias("prod_nulas"),
                    F.count_if(~F.col("periodo_mes").between(1, 12)).alias("meses_invalidos"),
                    F.count_distinct("cultivo").alias("cultivos"))
    c = coyuntura.agg(F.count(F.lit(1)).alias("filas"),
                      F.count_if(F.col("precio_sem_actual") <= 0).alias("precios_no_positivos"),
                      F.count_if(F.abs("variacion_pct") > 50).alias("variaciones_extremas"),
                      F.count_if(~F.col("semana").between(1, 53)).alias("semanas_invalidas"))
    m = clima.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("indicativo").alias("estaciones"),
                  F.count_if(F.col("t_media").isNull()).alias("t_media_nulas"),
                  (F.count_if(~F.col("t_media").between(-20.0, 45.0))
                   + F.count_if(~F.col("precip_mm").between(0.0, 1000.0))).alias("fuera_de_rango"))

    def long(df, name):
        return df.unpivot([], df.columns, "metrica", "valor").select(F.lit(name).alias("tabla"), "metrica",
                                                                     F.col("valor").cast("bigint").alias("valor"))
    return long(a, "avances").unionByName(long(c, "coyuntura")).unionByName(long(m, "clima_mensual"))


def verify_checks(avances: DataFrame, coyuntura: DataFrame, estaciones: DataFrame, clima: DataFrame,
                  minimums: dict[str, int] | None = None) -> DataFrame:
    """Data verification suite (X11): minimum row counts and key NULL checks
    as a (chequeo, valor, minimo, ok) table."""
    mins = {"avances": 1000, "coyuntura": 100, "estaciones": 7, "clima": 60, **(minimums or {})}

    def rows(df, name, key):
        n = F.count(F.lit(1))
        return df.agg(F.lit(f"{name}_min_filas").alias("chequeo"), n.alias("valor"),
                      F.lit(mins[key]).alias("minimo"), (n >= mins[key]).alias("ok"))
    keys_null = F.count_if(F.col("periodo_anio").isNull() | F.col("cultivo").isNull() | F.col("nivel").isNull())
    nulls = avances.agg(F.lit("avances_claves_nulas").alias("chequeo"), keys_null.alias("valor"),
                        F.lit(0).alias("minimo"), (keys_null == 0).alias("ok"))
    return (rows(avances, "avances", "avances").unionByName(rows(coyuntura, "coyuntura", "coyuntura"))
            .unionByName(rows(estaciones, "estaciones", "estaciones")).unionByName(rows(clima, "clima", "clima"))
            .unionByName(nulls))
