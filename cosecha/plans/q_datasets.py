"""Queries of the batch pipeline: X8-X10, C5, C7, C8, C10, W5, A18, A11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.encode import mappings
from ..sources.tables import Tables
from . import datasets as DS
from . import oracle_datasets as OD
from .oracle import R, with_tables
from .registry import query


def _pipe(spark, d) -> DS.DatasetBuilder:
    return DS.DatasetBuilder(Tables.get(spark, d))


V1_COLS = ", ".join(DS.FEATURES_V1 + [DS.TARGET] + DS.META_V1)
V2_COLS = ", ".join(DS.FEATURES + [DS.TARGET] + DS.META)


@query("model_dataset_v1", with_tables(f"SELECT {V1_COLS} FROM v1", OD.v1_ctes()))
def q_v1(spark, d):
    return _pipe(spark, d).v1()


@query("model_dataset_v2", with_tables(f"SELECT {V2_COLS} FROM v2", OD.v2_ctes()))
def q_v2(spark, d):
    return _pipe(spark, d).v2()


@query("model_dataset_v3", with_tables(f"SELECT {V2_COLS} FROM v3", OD.v3_ctes()))
def q_v3(spark, d):
    return _pipe(spark, d).v3()


@query("impute_hierarchical", with_tables(
    "SELECT cultivo, cod_provincia, anio, mes, t_media_c, precip_media_mm, hr_media_pct FROM v3", OD.v3_ctes()))
def q_impute_hierarchical(spark, d):
    return _pipe(spark, d).v3().select("cultivo", "cod_provincia", "anio", "mes", *DS.CLIMATE_FEATURES)


@query("iqr_flag", with_tables("""
SELECT nivel, ccaa, cod_provincia, cultivo, periodo_anio, periodo_mes, sup_avance, outlier_flag
FROM av_valid""", OD.av_valid_cte()))
def q_iqr_flag(spark, d):
    return _pipe(spark, d).av_valid().select("nivel", "ccaa", "cod_provincia", "cultivo", "periodo_anio",
                                             "periodo_mes", "sup_avance", "outlier_flag")


@query("impute_median", with_tables(
    f"SELECT indicativo, anio, mes, cod_provincia, {', '.join(DS.CLIMATE_IMPUTE)} FROM cl_imp", OD.climate_ctes()))
def q_impute_median(spark, d):
    return DS.imputed_climate(Tables.get(spark, d).clima_mensual()).select(
        "indicativo", "anio", "mes", "cod_provincia", *DS.CLIMATE_IMPUTE)


@query("climate_rollup_clean", with_tables("SELECT * FROM cp_v2", OD.climate_ctes()))
def q_climate_rollup_clean(spark, d):
    return _pipe(spark, d).clima_prov_v2()


@query("winsorize_p99", with_tables(
    "SELECT cultivo, cod_provincia, anio, mes, rendimiento, rendimiento_raw FROM v2", OD.v2_ctes()))
def q_winsorize(spark, d):
    return _pipe(spark, d).v2().select("cultivo", "cod_provincia", "anio", "mes", "rendimiento", "rendimiento_raw")


@query("label_encode", with_tables("""
SELECT 'cultivo' AS columna, clase, codigo FROM _e2_cultivo
UNION ALL SELECT 'provincia', clase, codigo FROM _e2_provincia
UNION ALL SELECT 'ccaa', clase, codigo FROM _e2_ccaa""", OD.v2_ctes()))
def q_label_encode(spark, d):
    v2 = _pipe(spark, d).v2()
    return mappings(v2, DS.ENCODED)


@query("target_stats", with_tables(f"""
SELECT {R('min(rendimiento)', 9)} AS rend_min, {R('avg(rendimiento)', 9)} AS rend_media,
       {R('median(rendimiento)', 9)} AS rend_mediana, {R('max(rendimiento)', 9)} AS rend_max,
       {R('stddev_samp(rendimiento)', 9)} AS rend_std
FROM v3""", OD.v3_ctes()))
def q_target_stats(spark, d):
    from ..operators.quality import target_stats
    return target_stats(_pipe(spark, d).v3(), DS.TARGET, "rend")


@query("dataset_profile", with_tables(f"""
SELECT count(*) AS filas, {len(DS.FEATURES) + 1 + len(DS.META)} AS columnas,
       count(DISTINCT cultivo) AS cultivos_unicos, count(DISTINCT cod_provincia) AS provincias_cubiertas,
       min(anio) AS periodo_min, max(anio) AS periodo_max,
       CAST({' + '.join(f'count_if({c} IS NULL)' for c in DS.FEATURES)} AS BIGINT) AS nulos_en_features,
       ({' + '.join(f'count_if({c} IS NULL)' for c in DS.FEATURES + [DS.TARGET])}) = 0 AS dataset_listo
FROM v3""", OD.v3_ctes()))
def q_dataset_profile(spark, d):
    from ..operators.quality import dataset_profile
    return dataset_profile(_pipe(spark, d).v3(), DS.FEATURES, DS.TARGET)


@query("value_counts", with_tables("""
SELECT provincia, count(*) AS n FROM v2 WHERE sin_clima GROUP BY provincia ORDER BY n DESC, provincia""",
                                   OD.v2_ctes()))
def q_value_counts(spark, d):
    v2 = _pipe(spark, d).v2()
    return (v2.filter(F.col("sin_clima")).groupBy("provincia").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "provincia"))


@query("processing_report", with_tables("""
SELECT count(*) AS filas, CAST(count_if(rendimiento < rendimiento_raw) AS BIGINT) AS rendimiento_winsorizados,
       CAST(count_if(sin_clima) AS BIGINT) AS filas_sin_clima,
       CAST(count_if(t_media_c IS NULL) AS BIGINT) AS t_media_c_nulos,
       CAST(count_if(precip_media_mm IS NULL) AS BIGINT) AS precip_media_mm_nulos,
       CAST(count_if(hr_media_pct IS NULL) AS BIGINT) AS hr_media_pct_nulos
FROM v2""", OD.v2_ctes()))
def q_processing_report(spark, d):
    v2 = _pipe(spark, d).v2()
    return v2.agg(F.count(F.lit(1)).alias("filas"),
                  F.count_if(F.col("rendimiento") < F.col("rendimiento_raw")).alias("rendimiento_winsorizados"),
                  F.count_if("sin_clima").alias("filas_sin_clima"),
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulos") for c in DS.CLIMATE_FEATURES])
