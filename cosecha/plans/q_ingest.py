"""Ingestion, landing and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import EU_NULL_TOKENS
from ..functions.text import MONTHS_ES
from ..operators import clean as CL
from ..operators import quality as QU
from ..sources import cells as CE
from ..sources import landing as LD
from ..sources.tables import Tables
from . import datasets as DS
from . import oracle_datasets as OD
from .oracle import with_tables
from .q_text import (CCAA_SQL, CLIMA_FRAG_SQL, DOC_FRAG_SQL, NAT_SQL, PRICE_SQL, _fmt, _mes, _safe_id, _z2,
                     all_fragments)
from .registry import query

YEAR_19_20 = r"((?:19|20)\d{2})"
SRT_YEAR = 2001


def _adv_cells(t: Tables):
    return t.landed_advance_cells(SRT_YEAR)


def _ingested(spark, d):
    t = Tables.get(spark, d)
    out, bad = CE.ingest_advances(_adv_cells(t))
    return out, bad


# Column names of the panel and of the weekly prices.
ADV_COLS = ["periodo_anio", "periodo_mes", "cultivo", "regimen", "nivel", "cod_provincia", "provincia", "ccaa",
            "sup_avance", "prod_avance", "anio_definitivo", "anio_provisional", "anio_avance", "mes_avance"]


def _adv_expected(where: str) -> str:
    from ..dims import PROV_TO_CCAA, values_sql
    return with_tables(f"""
SELECT a.periodo_anio, a.periodo_mes, a.cultivo, 'total' AS regimen, a.nivel, a.cod_provincia, a.provincia,
       CASE WHEN a.nivel = 'provincia' THEN COALESCE(m.ccaa_map, 'DESCONOCIDA') ELSE 'ESPAÑA' END AS ccaa,
       a.sup_avance, a.prod_avance, a.periodo_anio - 2 AS anio_definitivo, a.periodo_anio - 1 AS anio_provisional,
       a.periodo_anio AS anio_avance, a.periodo_mes AS mes_avance
FROM avances a LEFT JOIN {values_sql(PROV_TO_CCAA, 'cod', 'ccaa_map')} m ON a.cod_provincia = m.cod
WHERE a.nivel IN ('provincia', 'nacional') AND {where}""")


@query("extract_format_a", _adv_expected(f"a.periodo_anio <> {SRT_YEAR}"))
def q_extract_format_a(spark, d):
    out, _ = _ingested(spark, d)
    return out.filter(F.col("periodo_anio") != SRT_YEAR).select(*ADV_COLS)


@query("unpivot_regimen", _adv_expected(f"a.periodo_anio = {SRT_YEAR}"))
def q_unpivot_regimen(spark, d):
    out, _ = _ingested(spark, d)
    return out.filter(F.col("periodo_anio") == SRT_YEAR).select(*ADV_COLS)


# ------------------------------------------- all measures, broken sheets
MEASURES = list(CE.FORMAT_A)
FULL_COLS = [c for c in ADV_COLS if c not in ("sup_avance", "prod_avance")] + MEASURES
_MONTH_FILE = f"list_extract({list(MONTHS_ES)}, periodo_mes)"
_FILE_SQL = (f"'cuaderno_' || {_MONTH_FILE} || CAST(periodo_anio AS VARCHAR) || "
             f"CASE WHEN periodo_anio = {SRT_YEAR} THEN '.xlsm' ELSE '.xls' END")
_SHEET_SQL = f"cultivo || CASE WHEN periodo_anio = {SRT_YEAR} THEN ' S/R/T-SRT' ELSE '' END"
_BROKEN_SQL = f"""CASE WHEN (length(cultivo) + periodo_anio + periodo_mes) % 11 = 0 THEN 'sin_cabecera'
  WHEN (length(cultivo) + periodo_anio + periodo_mes) % 11 = 1 AND periodo_anio <> {SRT_YEAR} THEN 'faltan_columnas' END"""
_UNNAMED_SQL = "(periodo_anio % 5 = 3 AND periodo_mes = 2)"


def _full_expected(where: str, source: str, indices: bool) -> str:
    from ..dims import PROV_TO_CCAA, values_sql
    index = (lambda e: e) if indices else (lambda e: "CAST(NULL AS DOUBLE)")
    return with_tables(f"""
SELECT a.periodo_anio, a.periodo_mes, a.cultivo, a.regimen, a.nivel, a.cod_provincia, a.provincia,
       CASE WHEN a.nivel = 'provincia' THEN COALESCE(m.ccaa_map, 'DESCONOCIDA') ELSE 'ESPAÑA' END AS ccaa,
       a.periodo_anio - 2 AS anio_definitivo, a.periodo_anio - 1 AS anio_provisional,
       a.periodo_anio AS anio_avance, a.periodo_mes AS mes_avance,
       sup - 20.0 AS sup_definitivo, sup - 10.0 AS sup_provisional, sup AS sup_avance,
       {index("a.periodo_mes % 7 + CAST(100.5 AS DOUBLE)")} AS sup_indice,
       prod + 0.25 AS prod_definitivo, prod + 0.5 AS prod_provisional, prod AS prod_avance,
       {index("a.periodo_mes % 5 + CAST(90.0 AS DOUBLE)")} AS prod_indice
FROM ({source}) a LEFT JOIN {values_sql(PROV_TO_CCAA, 'cod', 'ccaa_map')} m ON a.cod_provincia = m.cod
WHERE a.nivel IN ('provincia', 'nacional') AND {where} AND ({_BROKEN_SQL}) IS NULL AND NOT {_UNNAMED_SQL}""")


_ONE_REGIME = "SELECT *, sup_avance AS sup, prod_avance AS prod FROM avances"
_THREE_REGIMES = """
SELECT a.* EXCLUDE (regimen), r.regimen, sup_avance * r.parte AS sup, prod_avance * r.parte AS prod
FROM avances a JOIN (VALUES ('secano', CAST(0.25 AS DOUBLE)), ('regadio', CAST(0.75 AS DOUBLE)),
                            ('total', CAST(1.0 AS DOUBLE))) r(regimen, parte)
  ON NOT (r.regimen = 'secano' AND coalesce(cod_provincia % 3, 1) = 0)"""


@query("extract_format_a_full", _full_expected(f"a.periodo_anio <> {SRT_YEAR}", _ONE_REGIME, True))
def q_extract_format_a_full(spark, d):
    rows = CE.ingest_isolated(Tables.get(spark, d).landed_full_cells(SRT_YEAR)).filter("tipo = 'registro'")
    return rows.filter(F.col("periodo_anio") != SRT_YEAR).select(*FULL_COLS)


@query("unpivot_regimen_full", _full_expected(f"a.periodo_anio = {SRT_YEAR}", _THREE_REGIMES, False))
def q_unpivot_regimen_full(spark, d):
    rows = CE.ingest_isolated(Tables.get(spark, d).landed_full_cells(SRT_YEAR)).filter("tipo = 'registro'")
    return rows.filter(F.col("periodo_anio") == SRT_YEAR).select(*FULL_COLS)


_DEF_SQL = f"""
SELECT {_safe_id("'av_nac_' || cultivo || '_' || CAST(periodo_anio AS VARCHAR) || '_' || " + _z2("periodo_mes") + " || '_' || regimen")} AS id,
  concat_ws('. ',
    'En ' || {_mes('periodo_mes')} || ' de ' || CAST(periodo_anio AS VARCHAR) || ', el avance nacional de ' || cultivo
      || CASE WHEN regimen <> 'total' THEN ' (' || regimen || ')' ELSE '' END,
    CASE WHEN sup IS NOT NULL THEN 'muestra una superficie estimada de ' || {_fmt('sup', 0)} || ' hectáreas' END,
    CASE WHEN prod IS NOT NULL THEN 'con una producción de ' || {_fmt('prod', 3)} || ' miles de toneladas' END,
    'El dato definitivo de ' || CAST(periodo_anio - 2 AS VARCHAR) || ' fue ' || {_fmt('sup - 20.0', 0)} || ' ha de superficie'
  ) || '.' AS text
FROM (@source) WHERE nivel = 'nacional' AND @where AND ({_BROKEN_SQL}) IS NULL AND NOT {_UNNAMED_SQL}"""


def _def_sql(source: str, where: str) -> str:
    return _DEF_SQL.replace("@source", source).replace("@where", where)


@query("frag_national_definitivo", with_tables(_def_sql(_ONE_REGIME, f"periodo_anio <> {SRT_YEAR}") + "\nUNION ALL"
                                               + _def_sql(_THREE_REGIMES, f"periodo_anio = {SRT_YEAR}")))
def q_frag_national_definitivo(spark, d):
    from ..operators.fragments import national_fragments
    rows = CE.ingest_isolated(Tables.get(spark, d).landed_full_cells(SRT_YEAR)).filter("tipo = 'registro'")
    return national_fragments(rows).select("id", "text")


@query("quarantine_sheets", with_tables(f"""
SELECT DISTINCT {_FILE_SQL} AS file, {_SHEET_SQL} AS sheet, {_BROKEN_SQL} AS motivo FROM avances
WHERE ({_BROKEN_SQL}) IS NOT NULL AND NOT {_UNNAMED_SQL}"""))
def q_quarantine_sheets(spark, d):
    t = Tables.get(spark, d)
    store, _ = LD.write_isolated(CE.ingest_isolated(t.landed_full_cells(SRT_YEAR)), t.scratch("isolated"))
    return store.filter("tipo = 'hoja' and motivo is not null").select("file", "sheet", "motivo")


@query("ingest_summary", with_tables(f"""
SELECT (SELECT count(DISTINCT {_FILE_SQL}) FROM avances WHERE NOT {_UNNAMED_SQL}) AS archivos_ok,
       (SELECT count(DISTINCT periodo_anio) FROM avances WHERE {_UNNAMED_SQL}) AS archivos_error,
       (SELECT count(DISTINCT ({_FILE_SQL}, {_SHEET_SQL})) FROM avances
        WHERE ({_BROKEN_SQL}) IS NULL AND NOT {_UNNAMED_SQL}) AS hojas_ok,
       (SELECT count(DISTINCT ({_FILE_SQL}, {_SHEET_SQL})) FROM avances
        WHERE ({_BROKEN_SQL}) IS NOT NULL AND NOT {_UNNAMED_SQL}) AS hojas_error,
       (SELECT count(*) FROM ({_ONE_REGIME}) WHERE nivel IN ('provincia', 'nacional') AND periodo_anio <> {SRT_YEAR}
        AND ({_BROKEN_SQL}) IS NULL AND NOT {_UNNAMED_SQL})
       + (SELECT count(*) FROM ({_THREE_REGIMES}) WHERE nivel IN ('provincia', 'nacional') AND periodo_anio = {SRT_YEAR}
          AND ({_BROKEN_SQL}) IS NULL AND NOT {_UNNAMED_SQL}) AS registros"""))
def q_ingest_summary(spark, d):
    t = Tables.get(spark, d)
    _, summary = LD.write_isolated(CE.ingest_isolated(t.landed_full_cells(SRT_YEAR)), t.scratch("isolated"))
    return summary


@query("cells_to_rows", with_tables(f"""
SELECT {_FILE_SQL} AS file, {_SHEET_SQL} AS sheet,
       count(*) + CASE WHEN periodo_anio = {SRT_YEAR} THEN 4 ELSE 5 END AS filas
FROM avances GROUP BY periodo_anio, periodo_mes, cultivo"""))
def q_cells_to_rows(spark, d):
    cells = CE.filter_sheets(_adv_cells(Tables.get(spark, d)))
    return CE.pivot_rows(cells).groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("filas"))


@query("sheet_filter", with_tables(f"""
SELECT DISTINCT {_FILE_SQL} AS file, {_SHEET_SQL} AS sheet, TRUE AS conservada FROM avances
UNION ALL SELECT DISTINCT {_FILE_SQL}, 'portada', FALSE FROM avances"""))
def q_sheet_filter(spark, d):
    cells = _adv_cells(Tables.get(spark, d))
    kept = CE.filter_sheets(cells).select("file", "sheet").distinct().withColumn("conservada", F.lit(True))
    allx = cells.select("file", "sheet").distinct()
    return allx.join(kept, ["file", "sheet"], "left").fillna(False, ["conservada"])


def _price_cells(t):
    return t.landed_price_cells()


PRICE_COLS = ["anio", "semana", "seccion", "categoria", "producto", "unidad", "precio_sem_anterior",
              "precio_sem_actual", "variacion_euros", "variacion_pct", "es_subtipo"]


@query("ffill_category", with_tables("""
SELECT anio, semana, seccion, categoria, producto, unidad, precio_sem_anterior, precio_sem_actual,
       variacion_euros, variacion_pct, false AS es_subtipo FROM coyuntura"""))
def q_ffill_category(spark, d):
    return CE.ingest_prices(_price_cells(Tables.get(spark, d)), YEAR_19_20).select(*PRICE_COLS)


@query("flag_subtype", with_tables("""
SELECT anio, semana, seccion, producto, starts_with(producto, '5') AS es_subtipo FROM coyuntura"""))
def q_flag_subtype(spark, d):
    p = CE.ingest_prices(_price_cells(Tables.get(spark, d)), YEAR_19_20, compat_subtype=False)
    return p.select("anio", "semana", "seccion", "producto", "es_subtipo")


@query("detect_report_meta", with_tables("""
SELECT DISTINCT 'coyuntura_' || CAST(anio AS VARCHAR) || '_S' || lpad(CAST(semana AS VARCHAR), 2, '0') || '.xlsx' AS file,
       anio, semana, CASE WHEN semana > 1 THEN semana - 1 ELSE 52 END AS semana_anterior,
       CAST(NULL AS VARCHAR) AS fecha_rango_anterior,
       'semana ' || lpad(CAST(semana AS VARCHAR), 2, '0') || ' ' || CAST(anio AS VARCHAR) AS fecha_rango_actual
FROM coyuntura"""))
def q_detect_report_meta(spark, d):
    return CE.detect_report_meta(_price_cells(Tables.get(spark, d)), YEAR_19_20)


# --------------------------------------------------------------- climate
CLIMATE_COLS = ["indicativo", "anio", "mes", "t_media", "t_max_abs", "t_min_abs", "t_max_med", "t_min_med",
                "precip_mm", "dias_precip", "horas_sol", "hr_media"]


@query("src_climate_json", with_tables(f"SELECT {', '.join(CLIMATE_COLS)} FROM clima_mensual"))
def q_src_climate_json(spark, d):
    t = Tables.get(spark, d)
    path = LD.land_climate_json(t.clima_mensual(), t.scratch("clima_json"))
    return LD.read_climate_json(spark, path).select(*CLIMATE_COLS)


@query("src_files")
def q_src_files(spark, d):
    t = Tables.get(spark, d)
    path = LD.land_climate_json(t.clima_mensual(), t.scratch("clima_json"))
    return LD.discover_files(spark, path, "*.txt")


@query("src_files_lines", with_tables("""
SELECT count(DISTINCT (indicativo, anio)) AS lineas, CAST(0 AS BIGINT) AS sin_archivo, TRUE AS bytes_iguales
FROM clima_mensual"""))
def q_src_files_lines(spark, d):
    t = Tables.get(spark, d)
    path = LD.land_climate_json(t.clima_mensual(), t.scratch("clima_json_lineas"))
    files = LD.discover_files(spark, path, "*.txt").select("path", "length")
    # Every line is in one listed file, and the listed lengths are those of the lines.
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.octet_length("value").alias("b"))
             .groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") + 1).alias("b")))
    j = lines.join(files, "path", "left")
    return j.agg(F.sum("n").alias("lineas"), F.count_if(F.col("length").isNull()).alias("sin_archivo"),
                 (F.sum("b") == F.sum("length")).alias("bytes_iguales"))


@query("roundtrip_parquet", with_tables(f"SELECT {', '.join(DS.FEATURES + [DS.TARGET] + DS.META)} FROM v2",
                                        OD.v2_ctes()))
def q_roundtrip_parquet(spark, d):
    t = Tables.get(spark, d)
    path = t.scratch("dataset_v2")
    DS.DatasetBuilder(t).v2().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------ replacement
_AV_KEYS = ["periodo_anio", "periodo_mes", "cultivo", "nivel", "ccaa", "cod_provincia", "sup_avance", "prod_avance"]


@query("upsert_period", with_tables("""
SELECT periodo_anio, periodo_mes, cultivo, nivel, ccaa, cod_provincia, sup_avance, prod_avance FROM avances
WHERE periodo_anio <> 2000
UNION ALL
SELECT periodo_anio, periodo_mes, cultivo, nivel, ccaa, cod_provincia, sup_avance * 2, prod_avance FROM avances
WHERE periodo_anio = 2000"""))
def q_upsert_period(spark, d):
    t = Tables.get(spark, d)
    path = t.scratch("avances_store")
    keys = ["periodo_anio", "periodo_mes"]
    LD.replace_partitions(spark, t.avances(), path, keys)
    delivery = t.avances().filter(F.col("periodo_anio") == 2000).withColumn("sup_avance", F.col("sup_avance") * 2)
    LD.replace_partitions(spark, delivery, path, keys)
    # re-delivery of the same period is idempotent
    out = LD.replace_partitions(spark, delivery, path, keys)
    return out.select(*_AV_KEYS)


@query("upsert_week", with_tables("""
SELECT anio, semana, seccion, producto, precio_sem_actual FROM coyuntura WHERE anio <> 1999
UNION ALL
SELECT anio, semana, seccion, producto, precio_sem_actual + 1.0 FROM coyuntura WHERE anio = 1999"""))
def q_upsert_week(spark, d):
    t = Tables.get(spark, d)
    path = t.scratch("coyuntura_store")
    keys = ["anio", "semana"]
    LD.replace_partitions(spark, t.coyuntura(), path, keys)
    delivery = t.coyuntura().filter(F.col("anio") == 1999) \
        .withColumn("precio_sem_actual", F.col("precio_sem_actual") + 1.0)
    out = LD.replace_partitions(spark, delivery, path, keys)
    return out.select("anio", "semana", "seccion", "producto", "precio_sem_actual")


@query("upsert_station_year", with_tables("""
SELECT indicativo, anio, mes, t_media FROM clima_mensual
WHERE (indicativo, anio) NOT IN (SELECT DISTINCT indicativo, anio FROM clima_mensual WHERE anio = 2000 AND mes <= 6)
UNION ALL
SELECT indicativo, anio, mes, t_media + 1.0 FROM clima_mensual WHERE anio = 2000 AND mes <= 6"""))
def q_upsert_station_year(spark, d):
    t = Tables.get(spark, d)
    cm = t.clima_mensual().select("indicativo", "anio", "mes", "t_media")
    path = t.scratch("clima_store")
    LD.write_bucketed(cm, path, ["indicativo", "anio"])
    delivery = cm.filter((F.col("anio") == 2000) & (F.col("mes") <= 6)).withColumn("t_media", F.col("t_media") + 1.0)
    store = LD.upsert_bucketed(spark, path, delivery, ["indicativo", "anio"], ["indicativo", "anio", "mes"])
    return store.drop("_cubo")


@query("refresh_stations", with_tables("SELECT * FROM estaciones"))
def q_refresh_stations(spark, d):
    t = Tables.get(spark, d)
    return LD.write_versioned(t.estaciones(), t.scratch("estaciones_store"))


@query("fragments_replace", with_tables(f"""
SELECT fuente, count(*) AS n_fragmentos FROM (
  SELECT id, fuente FROM ({NAT_SQL}) UNION ALL SELECT id, fuente FROM ({CCAA_SQL})
  UNION ALL SELECT id, fuente FROM ({CLIMA_FRAG_SQL}) UNION ALL SELECT id, fuente FROM ({DOC_FRAG_SQL})
  UNION ALL SELECT DISTINCT id, fuente FROM ({PRICE_SQL})) GROUP BY fuente"""))
def q_fragments_replace(spark, d):
    from ..operators.fragments import dedup_fragments, price_fragments
    t = Tables.get(spark, d)
    path = t.scratch("fragment_store")
    LD.replace_partitions(spark, all_fragments(t), path, ["fuente"])
    fresh = dedup_fragments(price_fragments(t.coyuntura())).select("id", "text", "fuente", "metadata")
    store = LD.replace_partitions(spark, fresh, path, ["fuente"])
    return store.groupBy("fuente").agg(F.count(F.lit(1)).alias("n_fragmentos"))


# ------------------------------------------------------------- reports
def _quality_row(t: Tables):
    a, c, cm = t.avances(), t.coyuntura(), t.clima_mensual()
    ra = a.agg(F.count(F.lit(1)).alias("filas_avances"), F.count_if(F.col("sup_avance") < 0).alias("sup_negativas"),
               F.count_if(F.col("prod_avance").isNull()).alias("prod_nulas"))
    rc = c.agg(F.count(F.lit(1)).alias("filas_coyuntura"),
               F.count_if(F.col("precio_sem_actual") <= 0).alias("precios_no_positivos"))
    rm = cm.agg(F.count(F.lit(1)).alias("filas_clima"), F.count_if(F.col("t_media").isNull()).alias("t_media_nulas"))
    # three one-row aggregates side by side: an equi-join on a constant key
    k = F.lit(1).alias("_k")
    return ra.select("*", k).join(rc.select("*", k), "_k").join(rm.select("*", k), "_k").drop("_k")


@query("report_json", with_tables("""
SELECT json_object('filas_avances', (SELECT count(*) FROM avances),
                   'sup_negativas', (SELECT count_if(sup_avance < 0) FROM avances),
                   'prod_nulas', (SELECT count_if(prod_avance IS NULL) FROM avances),
                   'filas_coyuntura', (SELECT count(*) FROM coyuntura),
                   'precios_no_positivos', (SELECT count_if(precio_sem_actual <= 0) FROM coyuntura),
                   'filas_clima', (SELECT count(*) FROM clima_mensual),
                   't_media_nulas', (SELECT count_if(t_media IS NULL) FROM clima_mensual))::VARCHAR AS json"""))
def q_report_json(spark, d):
    return LD.report_json(_quality_row(Tables.get(spark, d)))


@query("quality_report", with_tables("""
SELECT tabla, metrica, CAST(valor AS BIGINT) AS valor FROM (
SELECT 'avances' AS tabla, 'filas' AS metrica, count(*) AS valor FROM avances
UNION ALL SELECT 'avances', 'sup_negativas', count_if(sup_avance < 0) FROM avances
UNION ALL SELECT 'avances', 'prod_nulas', count_if(prod_avance IS NULL) FROM avances
UNION ALL SELECT 'avances', 'meses_invalidos', count_if(periodo_mes NOT BETWEEN 1 AND 12) FROM avances
UNION ALL SELECT 'avances', 'cultivos', count(DISTINCT cultivo) FROM avances
UNION ALL SELECT 'coyuntura', 'filas', count(*) FROM coyuntura
UNION ALL SELECT 'coyuntura', 'precios_no_positivos', count_if(precio_sem_actual <= 0) FROM coyuntura
UNION ALL SELECT 'coyuntura', 'variaciones_extremas', count_if(abs(variacion_pct) > 50) FROM coyuntura
UNION ALL SELECT 'coyuntura', 'semanas_invalidas', count_if(semana NOT BETWEEN 1 AND 53) FROM coyuntura
UNION ALL SELECT 'clima_mensual', 'filas', count(*) FROM clima_mensual
UNION ALL SELECT 'clima_mensual', 'estaciones', count(DISTINCT indicativo) FROM clima_mensual
UNION ALL SELECT 'clima_mensual', 't_media_nulas', count_if(t_media IS NULL) FROM clima_mensual
UNION ALL SELECT 'clima_mensual', 'fuera_de_rango', count_if(t_media NOT BETWEEN -20.0 AND 45.0)
                                                  + count_if(precip_mm NOT BETWEEN 0.0 AND 1000.0) FROM clima_mensual)"""))
def q_quality_report(spark, d):
    t = Tables.get(spark, d)
    return QU.quality_report(t.avances(), t.coyuntura(), t.clima_mensual())


@query("verify_checks", with_tables("""
SELECT chequeo, CAST(valor AS BIGINT) AS valor, minimo, ok FROM (
SELECT 'avances_min_filas' AS chequeo, count(*) AS valor, 1000 AS minimo, count(*) >= 1000 AS ok FROM avances
UNION ALL SELECT 'coyuntura_min_filas', count(*), 100, count(*) >= 100 FROM coyuntura
UNION ALL SELECT 'estaciones_min_filas', count(*), 7, count(*) >= 7 FROM estaciones
UNION ALL SELECT 'clima_min_filas', count(*), 60, count(*) >= 60 FROM clima_mensual
UNION ALL SELECT 'avances_claves_nulas', count_if(periodo_anio IS NULL OR cultivo IS NULL OR nivel IS NULL), 0,
                 count_if(periodo_anio IS NULL OR cultivo IS NULL OR nivel IS NULL) = 0 FROM avances)"""))
def q_verify_checks(spark, d):
    t = Tables.get(spark, d)
    return QU.verify_checks(t.avances(), t.coyuntura(), t.estaciones(), t.clima_mensual())


@query("quarantine", with_tables(f"""
SELECT motivo, count(*) AS n FROM (
  SELECT CASE WHEN s IN ({", ".join("'" + x + "'" for x in EU_NULL_TOKENS)}) THEN 'token_nulo'
              WHEN v IS NULL AND contains(s, '.') THEN 'separador_miles'
              WHEN v IS NULL THEN 'no_numerico' END AS motivo
  FROM (SELECT s, {__import__('cosecha.plans.q_clean', fromlist=['pyfloat_sql']).pyfloat_sql("replace(s, ',', '.')")} AS v
        FROM (SELECT regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM raw_numbers)))
WHERE motivo IS NOT NULL GROUP BY motivo"""))
def q_quarantine(spark, d):
    from ..sources.tables import raw_numbers
    q = LD.quarantine_numbers(raw_numbers(Tables.get(spark, d)), "raw", EU_NULL_TOKENS)
    return q.filter(F.col("motivo").isNotNull()).groupBy("motivo").agg(F.count(F.lit(1)).alias("n"))


def _quarantine_files_sql() -> str:
    from .q_clean import _PERIOD_SQL
    return f"SELECT archivo, error FROM ({_PERIOD_SQL}) WHERE error IS NOT NULL"


@query("quarantine_files", _quarantine_files_sql())
def q_quarantine_files(spark, d):
    from ..functions.parse import parse_period
    from ..dims import months_df
    from ..sources.tables import raw_filenames
    f = parse_period(raw_filenames(Tables.get(spark, d)), "archivo", months_df(spark))
    return f.filter(F.col("error").isNotNull()).select("archivo", "error")


def _export_sql() -> str:
    from .q_aggregates import CLOSES_SQL
    return with_tables("""
SELECT 'rendimientos' AS nombre, count(*) AS filas FROM (
  SELECT cultivo, periodo_anio FROM closes GROUP BY cultivo, periodo_anio)""", CLOSES_SQL)


@query("export_result", _export_sql())
def q_export_result(spark, d):
    t = Tables.get(spark, d)
    from .q_aggregates import _closes
    from ..operators.panel import weighted_yield
    frames = {"rendimientos": weighted_yield(_closes(spark, d), ["cultivo", "periodo_anio"]),
              "vacio": t.coyuntura().filter(F.lit(False))}
    return LD.export_frames(frames, t.scratch("export"), {"origen": d})


@query("assert_ready", with_tables("SELECT anio, count(*) AS filas FROM v3 GROUP BY anio", OD.v3_ctes()))
def q_assert_ready(spark, d):
    v3 = DS.DatasetBuilder(Tables.get(spark, d)).v3()
    CL.assert_ready(v3, DS.FEATURES + [DS.TARGET], DS.FEATURES + [DS.TARGET])
    return v3.groupBy("anio").agg(F.count(F.lit(1)).alias("filas"))


@query("stream_redelivery", with_tables("""
SELECT periodo_anio, periodo_mes, cultivo, nivel, ccaa, cod_provincia, sup_avance, prod_avance FROM avances
WHERE periodo_anio <> 2000
UNION ALL
SELECT periodo_anio, periodo_mes, cultivo, nivel, ccaa, cod_provincia, sup_avance * 2, prod_avance FROM avances
WHERE periodo_anio = 2000"""))
def q_stream_redelivery(spark, d):
    import uuid
    from ..streaming.redelivery import deliver, period_deliveries, run_redelivery_stream
    t = Tables.get(spark, d)
    run = t.scratch(f"stream_{uuid.uuid4().hex[:8]}")
    av = t.avances()
    for version, part in period_deliveries(av, 2000):
        deliver(part, f"{run}/landing", version)
    out = run_redelivery_stream(spark, f"{run}/landing", f"{run}/store", f"{run}/_checkpoint",
                                ["periodo_anio", "periodo_mes"], av.schema)
    return out.select(*_AV_KEYS)
