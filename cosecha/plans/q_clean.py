"""Parsing, cleaning and scalar-function queries (I1-I8, I13, I16-I19,
C1-C4, C6, X-s*, X-m*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import parse as PZ
from ..functions import text as TX
from ..functions.numeric import round_half_up
from ..operators import clean as CL
from ..operators.climate import (apply_physical_limits, drop_sparse_columns, physical_limit_counts,
                                 sparse_columns)
from ..sources import tables as TB
from ..sources.tables import Tables
from .oracle import R, fold_sql, with_tables
from .registry import query


def ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def pyfloat_sql(x: str) -> str:
    s = ws(x)
    return (f"CASE WHEN regexp_matches({s}, '{PZ.PY_FLOAT_RE}') OR regexp_matches(lower({s}), "
            f"'{PZ.PY_SPECIAL_RE}') THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) END")


def _tokens(tokens) -> str:
    return ", ".join("'" + t + "'" for t in tokens)


def _nums(spark, d):
    return TB.raw_numbers(Tables.get(spark, d))


# ----------------------------------------------------------------- numbers
@query("safe_float", with_tables(f"SELECT l_orderkey, l_linenumber, raw, {pyfloat_sql('raw')} AS valor FROM raw_numbers"))
def q_safe_float(spark, d):
    return _nums(spark, d).select("l_orderkey", "l_linenumber", "raw", PZ.py_float("raw").alias("valor"))


@query("safe_int", with_tables(
    f"SELECT l_orderkey, l_linenumber, raw, TRY_CAST(trunc({pyfloat_sql('raw')}) AS BIGINT) AS valor FROM raw_numbers"))
def q_safe_int(spark, d):
    return _nums(spark, d).select("l_orderkey", "l_linenumber", "raw", PZ.py_int("raw").alias("valor"))


def _comma_sql(x: str) -> str:
    return f"replace({ws(x)}, ',', '.')"


@query("safe_float_eu", with_tables(
    f"SELECT l_orderkey, l_linenumber, raw, CASE WHEN {ws('raw')} NOT IN ({_tokens(PZ.EU_NULL_TOKENS)}) "
    f"THEN {pyfloat_sql(_comma_sql('raw'))} END AS valor FROM raw_numbers"))
def q_safe_float_eu(spark, d):
    return _nums(spark, d).select("l_orderkey", "l_linenumber", "raw", PZ.float_eu("raw").alias("valor"))


@query("parse_float_climate", with_tables(
    f"SELECT l_orderkey, l_linenumber, raw, CASE WHEN {ws('raw')} NOT IN ({_tokens(PZ.CLIMATE_NULL_TOKENS)}) "
    f"THEN {pyfloat_sql(_comma_sql('raw'))} END AS valor FROM raw_numbers"))
def q_parse_float_climate(spark, d):
    return _nums(spark, d).select("l_orderkey", "l_linenumber", "raw", PZ.float_climate("raw").alias("valor"))


@query("coerce_numeric", with_tables(
    f"SELECT indicativo, {pyfloat_sql('CAST(altitud AS VARCHAR)')} AS altitud FROM estaciones"))
def q_coerce_numeric(spark, d):
    st = Tables.get(spark, d).estaciones()
    return st.select("indicativo", PZ.coerce_numeric(F.col("altitud").cast("string")).alias("altitud"))


# ------------------------------------------------------------------- labels
_PERIOD_SQL = with_tables(f"""
SELECT archivo, mes, CASE WHEN mes IS NOT NULL THEN anio END AS anio,
       CASE WHEN mes IS NOT NULL THEN mes_str END AS mes_nombre,
       CASE WHEN NOT matched THEN 'nombre no reconocido' WHEN mes IS NULL THEN 'mes no reconocido' END AS error
FROM (
  SELECT archivo, matched, mes_str, anio, m.mes
  FROM (
    SELECT archivo, regexp_matches(stem, '{PZ.FILENAME_RE}') AS matched,
           CASE WHEN regexp_matches(stem, '{PZ.FILENAME_RE}') THEN regexp_extract(stem, '{PZ.FILENAME_RE}', 1) END AS mes_str,
           CASE WHEN regexp_matches(stem, '{PZ.FILENAME_RE}') THEN TRY_CAST(regexp_extract(stem, '{PZ.FILENAME_RE}', 2) AS INTEGER) END AS anio
    FROM (SELECT archivo, lower(regexp_replace(string_split(archivo, '/')[-1], '\\.[^.]*$', '')) AS stem FROM raw_filenames))
  LEFT JOIN {dims.values_sql(dims.MONTHS, 'mes_nombre', 'mes')} m ON mes_str = m.mes_nombre)""")


@query("parse_period", _PERIOD_SQL)
def q_parse_period(spark, d):
    return PZ.parse_period(TB.raw_filenames(Tables.get(spark, d)), "archivo", dims.months_df(spark)) \
        .select("archivo", "mes", "anio", "mes_nombre", "error")


def _classify_sql() -> str:
    uni = ", ".join(str(c) for c in sorted(dims.UNIPROV_CODES))
    names = ", ".join("'" + n + "'" for n in sorted(dims.CCAA_NAMES))
    s = ws("celda")
    code_re = PZ.CODE_NAME_RE
    return with_tables(f"""
SELECT c_custkey, celda, tipo,
       CASE WHEN tipo IN ('uniprov', 'provincia') THEN code END AS cod,
       CASE WHEN tipo = 'total' THEN 'ESPAÑA'
            WHEN tipo IN ('uniprov', 'provincia') THEN {ws(f"regexp_extract(s, '{code_re}', 2)")}
            WHEN tipo = 'ccaa' THEN s END AS nombre
FROM (
  SELECT *, CASE
      WHEN celda IS NULL OR s = '' OR starts_with(s, '(') OR starts_with(s, '*') THEN 'skip'
      WHEN contains(upper(s), 'ESPAÑA') THEN 'total'
      WHEN contains(upper(s), 'SUMA PROV') THEN 'skip'
      WHEN regexp_matches(s, '{code_re}') AND code IN ({uni}) THEN 'uniprov'
      WHEN regexp_matches(s, '{code_re}') THEN 'provincia'
      WHEN {ws('upper(s)')} IN ({names}) THEN 'ccaa'
      ELSE 'skip' END AS tipo
  FROM (SELECT c_custkey, celda, {s} AS s,
               TRY_CAST(regexp_extract({s}, '{code_re}', 1) AS INTEGER) AS code
        FROM raw_row_labels))""")


@query("classify_row", _classify_sql())
def q_classify_row(spark, d):
    df = TB.raw_row_labels(Tables.get(spark, d))
    return df.select("c_custkey", "celda", PZ.classify_row("celda").alias("r")) \
        .select("c_custkey", "celda", "r.tipo", "r.cod", "r.nombre")


@query("lookup_ccaa", with_tables(f"""
SELECT DISTINCT a.cod_provincia, COALESCE(m.ccaa_map, 'DESCONOCIDA') AS ccaa_ine
FROM avances a LEFT JOIN {dims.values_sql(dims.PROV_TO_CCAA, 'cod', 'ccaa_map')} m ON a.cod_provincia = m.cod
WHERE a.nivel = 'provincia'"""))
def q_lookup_ccaa(spark, d):
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "provincia")
    return CL.lookup_ccaa(a.select("cod_provincia").distinct(), "cod_provincia", dims.prov_ccaa_df(spark))


@query("split_product_unit", with_tables(f"""
SELECT p_partkey, raw,
  CASE WHEN regexp_matches(r, '{PZ.PRODUCT_UNIT_RE}')
       THEN {ws(f"regexp_replace({ws(f'regexp_replace(r, {chr(39)}{PZ.PRODUCT_UNIT_RE}{chr(39)}, {chr(39)}{chr(39)})')}, '\\*+$', '')")}
       ELSE r END AS nombre,
  CASE WHEN regexp_matches(r, '{PZ.PRODUCT_UNIT_RE}')
       THEN {ws(f"regexp_extract(r, '{PZ.PRODUCT_UNIT_RE}', 1)")} ELSE '' END AS unidad
FROM (SELECT p_partkey, raw, {ws('raw')} AS r FROM raw_products)"""))
def q_split_product_unit(spark, d):
    df = TB.raw_products(Tables.get(spark, d))
    return df.select("p_partkey", "raw", PZ.split_product_unit("raw").alias("u")) \
        .select("p_partkey", "raw", "u.nombre", "u.unidad")


@query("normalise_climate", with_tables("""
SELECT indicativo, fecha, CAST(string_split(fecha, '-')[1] AS INTEGER) AS anio,
       CAST(string_split(fecha, '-')[2] AS INTEGER) AS mes
FROM raw_climate_dates
WHERE len(string_split(fecha, '-')) = 2
  AND regexp_matches(string_split(fecha, '-')[1], '^\\s*[+-]?\\d+\\s*$')
  AND regexp_matches(string_split(fecha, '-')[2], '^\\s*[+-]?\\d+\\s*$')"""))
def q_normalise_climate(spark, d):
    return PZ.normalise_climate(TB.raw_climate_dates(Tables.get(spark, d))) \
        .select("indicativo", "fecha", "anio", "mes")


@query("map_station_province", with_tables(f"""
SELECT e.indicativo, e.provincia, d.cod AS cod_mapeado
FROM estaciones e JOIN (
  SELECT k, min(cod) AS cod FROM (
    SELECT upper(trim(nombre)) AS k, cod FROM {dims.values_sql(dims.PROV_AEMET_TO_INE, 'nombre', 'cod')}
    UNION ALL SELECT upper(trim(n_name)), n_nationkey FROM nation WHERE n_nationkey % 5 <> 0) GROUP BY k) d
  ON upper(trim(e.provincia)) = d.k"""))
def q_map_station_province(spark, d):
    t = Tables.get(spark, d)
    # the fixed weather-service dictionary plus the names the data uses
    dictionary = dims.aemet_province_df(spark).unionByName(
        t.dim("nation", "n_name", "n_nationkey").filter(F.pmod("n_nationkey", F.lit(5)) != 0)
        .select(F.col("n_name").alias("nombre"), F.col("n_nationkey").cast("int").alias("cod")))
    out = CL.map_to_code(t.estaciones(), "provincia", dictionary, "cod_mapeado")
    return out.filter(F.col("cod_mapeado").isNotNull()).select("indicativo", "provincia", "cod_mapeado")


@query("limit_stations", with_tables("""
SELECT indicativo, nombre, cod_provincia FROM estaciones WHERE cod_provincia IS NOT NULL
ORDER BY cod_provincia, indicativo LIMIT 10"""))
def q_limit_stations(spark, d):
    st = Tables.get(spark, d).estaciones()
    return CL.first_n_stations(st, 10).select("indicativo", "nombre", "cod_provincia")


@query("coverage_grid", with_tables("""
SELECT e.indicativo, CAST(y.anio AS INTEGER) AS anio
FROM estaciones e, (SELECT range AS anio FROM range(1994, 2003)) y
WHERE e.cod_provincia IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM clima_mensual c WHERE c.indicativo = e.indicativo AND c.anio = y.anio)"""))
def q_coverage_grid(spark, d):
    t = Tables.get(spark, d)
    st = t.estaciones().filter(F.col("cod_provincia").isNotNull())
    return CL.missing_coverage(st, t.clima_mensual(), 1994, 2002)


# ---------------------------------------------------------------- cleaning
@query("null_negatives", with_tables("""
SELECT periodo_anio, periodo_mes, cultivo, nivel, ccaa, cod_provincia,
       CASE WHEN sup_avance < 0 THEN NULL ELSE sup_avance END AS sup_avance,
       CASE WHEN prod_avance < 0 THEN NULL ELSE prod_avance END AS prod_avance
FROM avances"""))
def q_null_negatives(spark, d):
    a = Tables.get(spark, d).avances()
    return CL.null_negatives(a, ["sup_avance", "prod_avance"]).select(
        "periodo_anio", "periodo_mes", "cultivo", "nivel", "ccaa", "cod_provincia", "sup_avance", "prod_avance")


@query("null_negatives_count", with_tables("""
SELECT CAST(count_if(sup_avance < 0) AS BIGINT) AS sup_avance_negativos,
       CAST(count_if(prod_avance < 0) AS BIGINT) AS prod_avance_negativos
FROM avances"""))
def q_null_negatives_count(spark, d):
    return CL.negative_counts(Tables.get(spark, d).avances(), ["sup_avance", "prod_avance"])


_PRICE_CLEAN = f"""
SELECT anio, semana, producto, seccion, precio_sem_anterior, precio_sem_actual,
       CASE WHEN precio_sem_actual IS NOT NULL AND precio_sem_anterior IS NOT NULL
            THEN {R("(precio_sem_actual - precio_sem_anterior) / NULLIF(precio_sem_anterior, 0) * 100", 2)}
            ELSE variacion_pct END AS variacion_pct
FROM (SELECT anio, semana, producto, seccion, precio_sem_anterior, variacion_pct,
             CASE WHEN precio_sem_actual <= 0 THEN NULL ELSE precio_sem_actual END AS precio_sem_actual
      FROM coyuntura)"""


@query("null_bad_price", with_tables("""
SELECT anio, semana, producto, seccion,
       CASE WHEN precio_sem_actual <= 0 THEN NULL ELSE precio_sem_actual END AS precio_sem_actual
FROM coyuntura"""))
def q_null_bad_price(spark, d):
    c = Tables.get(spark, d).coyuntura()
    return CL.null_bad_price(c).select("anio", "semana", "producto", "seccion", "precio_sem_actual")


@query("recompute_variation", with_tables(_PRICE_CLEAN))
def q_recompute_variation(spark, d):
    c = CL.recompute_variation(CL.null_bad_price(Tables.get(spark, d).coyuntura()))
    return c.select("anio", "semana", "producto", "seccion", "precio_sem_anterior",
                    "precio_sem_actual", "variacion_pct")


def _limits_sql() -> str:
    from ..operators.climate import PHYSICAL_LIMITS as L
    cols = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in L.items())
    return with_tables(f"SELECT indicativo, anio, mes, {cols} FROM clima_mensual")


@query("physical_limits", _limits_sql())
def q_physical_limits(spark, d):
    cm = Tables.get(spark, d).clima_mensual()
    from ..operators.climate import PHYSICAL_LIMITS as L
    return apply_physical_limits(cm.select("indicativo", "anio", "mes", *L))


def _limit_counts_sql() -> str:
    from ..operators.climate import PHYSICAL_LIMITS as L
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(count_if({c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi})) AS BIGINT) AS n_fuera_rango "
        f"FROM clima_mensual" for c, (lo, hi) in L.items())
    return with_tables(parts)


@query("physical_limit_counts", _limit_counts_sql())
def q_physical_limit_counts(spark, d):
    return physical_limit_counts(Tables.get(spark, d).clima_mensual())


def _title_sql(x):
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


SPARSE_COLS = ["t_media", "t_max_abs", "t_min_abs", "t_max_med", "t_min_med", "precip_mm",
               "dias_precip", "horas_sol", "hr_media"]


@query("drop_sparse_cols", with_tables(" UNION ALL ".join(
    f"SELECT '{c}' AS columna, {R(f'count_if({c} IS NULL) / count(*)', 6)} AS ratio_nulos, "
    f"count_if({c} IS NULL) / count(*) > 0.85 AS descartar FROM clima_mensual" for c in SPARSE_COLS)))
def q_drop_sparse_cols(spark, d):
    s = sparse_columns(Tables.get(spark, d).clima_mensual(), SPARSE_COLS)
    return s.select("columna", round_half_up("ratio_nulos", 6).alias("ratio_nulos"), "descartar")


@query("drop_sparse_table", with_tables("""
SELECT indicativo, anio, mes, t_media, t_max_med, t_min_med, precip_mm, hr_media FROM clima_mensual"""))
def q_drop_sparse_table(spark, d):
    """The table without its sparse columns: which these are is found in the data."""
    cm = Tables.get(spark, d).clima_mensual().select("indicativo", "anio", "mes", *SPARSE_COLS)
    return drop_sparse_columns(cm, SPARSE_COLS)


_MIXED = "p_type || '-' || upper(p_brand) || '/' || p_name || ' ÁLAVA o''neil'"


@query("str_title", f"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower({_MIXED}), '[a-záéíóúüñ]+|[^a-záéíóúüñ]+'),
         lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS titulo,
       {_title_sql("p_name")} AS nombre_titulo FROM part""")
def q_str_title(spark, d):
    p = Tables.get(spark, d).raw("part", "p_partkey", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", TX.title_case(F.expr(_MIXED.replace("''", "\\'"))).alias("titulo"),
                    TX.title_case("p_name").alias("nombre_titulo"))


# ------------------------------------------------------------------ scalars
@query("str_case", """
SELECT conv_id, turn, upper(role) AS rol_upper, lower(role) AS rol_lower,
       regexp_replace(role, '^\\s+|\\s+$', '', 'g') AS rol_strip, CAST(length(text) AS INTEGER) AS n_chars
FROM conversations""")
def q_str_case(spark, d):
    c = Tables.get(spark, d).raw("conversations", "conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", F.upper("role").alias("rol_upper"), F.lower("role").alias("rol_lower"),
                    PZ.strip_ws("role").alias("rol_strip"), F.length("text").alias("n_chars"))


@query("fold_accents", f"""
SELECT conv_id, turn, md5({fold_sql('text')}) AS texto_plegado_md5,
       CAST(length({fold_sql('text')}) AS INTEGER) AS n_chars
FROM conversations""")
def q_fold_accents(spark, d):
    c = Tables.get(spark, d).raw("conversations", "conv_id", "turn", "text")
    f = TX.fold_accents("text")
    return c.select("conv_id", "turn", F.md5(f).alias("texto_plegado_md5"), F.length(f).alias("n_chars"))


@query("extract_years", """
SELECT doc_id,
       list_min(list_transform(regexp_extract_all(text, '(1[89]\\d{2}|20\\d{2})'), lambda x: CAST(x AS INTEGER))) AS anio_min,
       list_max(list_transform(regexp_extract_all(text, '(1[89]\\d{2}|20\\d{2})'), lambda x: CAST(x AS INTEGER))) AS anio_max,
       CAST(len(regexp_extract_all(text, '(1[89]\\d{2}|20\\d{2})')) AS INTEGER) AS n_anios
FROM documents""")
def q_extract_years(spark, d):
    docs = Tables.get(spark, d).raw("documents", "doc_id", "text")
    return docs.select("doc_id", *TX.year_range("text", r"(1[89]\d{2}|20\d{2})"))


@query("zfill", """
SELECT n_nationkey, CASE WHEN length(CAST(n_nationkey AS VARCHAR)) >= 2 THEN CAST(n_nationkey AS VARCHAR)
                         ELSE lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS cod2,
       CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN CAST(c_custkey AS VARCHAR)
            ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '0') END AS cust3
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_zfill(spark, d):
    t = Tables.get(spark, d)
    c = t.raw("customer", "c_custkey", "c_nationkey").join(
        t.dim("nation", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("n_nationkey", TX.zfill("n_nationkey", 2).alias("cod2"), TX.zfill("c_custkey", 3).alias("cust3"))


_ABBR = "[" + ",".join("'" + m + "'" for m in TX.MONTHS_ABBR) + "]"


@query("period_label", with_tables(f"""
SELECT DISTINCT periodo_anio, periodo_mes,
       CAST(periodo_anio AS VARCHAR) || '-' || {_ABBR}[periodo_mes] AS periodo
FROM avances"""))
def q_period_label(spark, d):
    a = Tables.get(spark, d).avances().select("periodo_anio", "periodo_mes").distinct()
    return a.select("periodo_anio", "periodo_mes", TX.period_label_month("periodo_anio", "periodo_mes").alias("periodo"))


@query("period_label_week", with_tables("""
SELECT DISTINCT anio, semana, CAST(anio AS VARCHAR) || '-S' || lpad(CAST(semana AS VARCHAR), 2, '0') AS periodo
FROM coyuntura"""))
def q_period_label_week(spark, d):
    c = Tables.get(spark, d).coyuntura().select("anio", "semana").distinct()
    return c.select("anio", "semana", TX.period_label_week("anio", "semana").alias("periodo"))


@query("fmt_es", with_tables("""
SELECT nivel, cultivo, periodo_anio, periodo_mes, replace(format('{:,.0f}', s), ',', '.') AS sup_txt,
       replace(format('{:,.3f}', p), ',', '.') AS prod_txt
FROM (SELECT nivel, cultivo, periodo_anio, periodo_mes, CAST(SUM(CAST(sup_avance AS DECIMAL(30,9))) AS DOUBLE) AS s,
             CAST(SUM(CAST(prod_avance AS DECIMAL(30,9))) AS DOUBLE) AS p FROM avances GROUP BY ALL)"""))
def q_fmt_es(spark, d):
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("double")
    keys = ["nivel", "cultivo", "periodo_anio", "periodo_mes"]
    a = (Tables.get(spark, d).avances().groupBy(*keys)
         .agg(exact("sup_avance").alias("s"), exact("prod_avance").alias("p")))
    return a.select(*keys, TX.fmt_thousands("s", 0).alias("sup_txt"),
                    TX.fmt_thousands("p", 3).alias("prod_txt"))


@query("safe_id", with_tables("""
SELECT DISTINCT cultivo, nivel, ccaa,
  replace(replace(trim('avance_' || cultivo || '_' || ccaa), '/', '-'), ' ', '_') || '_' ||
  substr(md5('avance_' || cultivo || '_' || ccaa), 1, 8) AS id
FROM avances WHERE nivel = 'ccaa'"""))
def q_safe_id(spark, d):
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "ccaa").select("cultivo", "nivel", "ccaa").distinct()
    base = F.concat(F.lit("avance_"), F.col("cultivo"), F.lit("_"), F.col("ccaa"))
    return a.select("cultivo", "nivel", "ccaa", TX.safe_id(base).alias("id"))


@query("keyword", with_tables("""
SELECT DISTINCT ccaa,
  string_split(replace(replace(replace(replace(replace(ccaa, 'Comunitat ', ''), 'Comunidad de ', ''),
                'Región de ', ''), 'Islas ', ''), 'La ', ''), ' ')[1] AS palabra
FROM avances WHERE nivel = 'ccaa'"""))
def q_keyword(spark, d):
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "ccaa").select("ccaa").distinct()
    return a.select("ccaa", TX.community_keyword("ccaa").alias("palabra"))


@query("yield_expr", with_tables(f"""
SELECT periodo_anio, periodo_mes, cultivo, cod_provincia,
       {R("prod_avance / NULLIF(sup_avance, 0) * 1000000.0", 3)} AS rend_kg_ha,
       {R("prod_avance / NULLIF(sup_avance, 0)", 9)} AS rendimiento,
       abs(sup_avance) AS sup_abs
FROM avances WHERE nivel = 'provincia'"""))
def q_yield_expr(spark, d):
    from ..functions.numeric import safe_div, yield_kg_ha
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "provincia")
    return a.select("periodo_anio", "periodo_mes", "cultivo", "cod_provincia",
                    round_half_up(yield_kg_ha("prod_avance", "sup_avance"), 3).alias("rend_kg_ha"),
                    round_half_up(safe_div("prod_avance", "sup_avance"), 9).alias("rendimiento"),
                    F.abs("sup_avance").alias("sup_abs"))


@query("computed_cols", with_tables(f"""
SELECT periodo_anio, periodo_mes, cultivo, cod_provincia,
       CASE WHEN UPPER(cultivo) LIKE '%TOTAL%' THEN 1 ELSE 0 END AS es_total,
       {R("sup_avance", 0)} AS sup_redondeada, 'provincial' AS zona
FROM avances WHERE nivel = 'provincia'"""))
def q_computed_cols(spark, d):
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "provincia")
    return a.select(
        "periodo_anio", "periodo_mes", "cultivo", "cod_provincia",
        F.when(F.upper("cultivo").contains("TOTAL"), 1).otherwise(0).alias("es_total"),
        round_half_up("sup_avance", 0).alias("sup_redondeada"), F.lit("provincial").alias("zona"))


@query("rename_present", with_tables("""
SELECT periodo_anio AS "Año", periodo_mes AS "Mes", cultivo AS "Cultivo", provincia AS "Provincia"
FROM avances WHERE nivel = 'provincia'"""))
def q_rename_present(spark, d):
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "provincia")
    mapping = {"periodo_anio": "Año", "periodo_mes": "Mes", "cultivo": "Cultivo",
               "provincia": "Provincia", "no_existe": "Nada"}
    return CL.rename_present(a, mapping)


@query("usable_columns", with_tables("""
SELECT 't_media_c' AS columna, bool_or(t_media_c IS NOT NULL) AS tiene_datos FROM clima_provincial
UNION ALL SELECT 't_max_abs_c', bool_or(t_max_abs_c IS NOT NULL) FROM clima_provincial
UNION ALL SELECT 'precip_media_mm', bool_or(precip_media_mm IS NOT NULL) FROM clima_provincial
UNION ALL SELECT 'horas_sol_med', bool_or(horas_sol_med IS NOT NULL) FROM clima_provincial
UNION ALL SELECT 'hr_media_pct', bool_or(hr_media_pct IS NOT NULL) FROM clima_provincial"""))
def q_usable_columns(spark, d):
    cp = Tables.get(spark, d).clima_provincial()
    return CL.usable_columns(cp, ["t_media_c", "t_max_abs_c", "precip_media_mm", "horas_sol_med", "hr_media_pct"])


# ------------------------------------------------------- request parameters
def _requests(spark, d):
    a = Tables.get(spark, d).avances().filter(F.col("nivel") == "provincia").select("cultivo", "provincia").distinct()
    k = F.pmod(F.length("cultivo") + F.length("provincia") + F.ascii(F.substring("provincia", -1, 1)), F.lit(3))
    req = (F.when(k == 0, F.concat(F.lit('{"cultivo": "'), F.lower("cultivo"), F.lit('", "provincia": "'),
                                    F.lower("provincia"), F.lit('", "anio_ini": 1996, "anio_fin": 2000}')))
           .when(k == 1, F.concat(F.lit("cultivo: "), F.col("cultivo"), F.lit(" provincia="), F.col("provincia")))
           .otherwise(F.concat(F.lit('{"cultivo": "'), F.col("cultivo"))))
    return a.select("cultivo", "provincia", req.alias("peticion"))


def _parse_params_sql():
    k = "(length(cultivo) + length(provincia) + ascii(substr(provincia, -1, 1))) % 3"
    req = (f"CASE WHEN {k} = 0 THEN '{{\"cultivo\": \"' || lower(cultivo) || '\", \"provincia\": \"' || "
           f"lower(provincia) || '\", \"anio_ini\": 1996, \"anio_fin\": 2000}}' "
           f"WHEN {k} = 1 THEN 'cultivo: ' || cultivo || ' provincia=' || provincia "
           f"ELSE '{{\"cultivo\": \"' || cultivo END")

    def loose(f):
        v = ws(f"regexp_extract(peticion, '(?i){f}[\"\\s:=]+([A-ZÁÉÍÓÚÜÑ\\s]+)', 1)")
        return f"CASE WHEN {v} <> '' THEN {v} END"
    cult = f"CASE WHEN j THEN json_extract_string(peticion, '$.cultivo') ELSE upper({loose('cultivo')}) END"
    prov = f"CASE WHEN j THEN json_extract_string(peticion, '$.provincia') ELSE {_title_sql(loose('provincia'))} END"
    return with_tables(f"""
SELECT cultivo_src AS cultivo, provincia_src AS provincia, peticion,
       upper({ws(f"COALESCE({cult}, '')")}) AS p_cultivo,
       {_title_sql(ws(f"COALESCE({prov}, '')"))} AS p_provincia,
       COALESCE(CASE WHEN j THEN TRY_CAST(json_extract(peticion, '$.anio_ini') AS INTEGER) END, 2014) AS p_anio_ini,
       COALESCE(CASE WHEN j THEN TRY_CAST(json_extract(peticion, '$.anio_fin') AS INTEGER) END, 2025) AS p_anio_fin,
       COALESCE(CASE WHEN j THEN json_extract_string(peticion, '$.metodo') END, 'ambos') AS p_metodo
FROM (SELECT cultivo AS cultivo_src, provincia AS provincia_src, peticion, json_valid(peticion) AS j
      FROM (SELECT DISTINCT cultivo, provincia, {req} AS peticion FROM avances WHERE nivel = 'provincia'))""")


@query("parse_params", _parse_params_sql())
def q_parse_params(spark, d):
    r = _requests(spark, d)
    p = PZ.parse_params("peticion")
    return r.select("cultivo", "provincia", "peticion", p["cultivo"].alias("p_cultivo"),
                    p["provincia"].alias("p_provincia"), p["anio_ini"].alias("p_anio_ini"),
                    p["anio_fin"].alias("p_anio_fin"), p["metodo"].alias("p_metodo"))
