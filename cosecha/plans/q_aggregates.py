"""Aggregation, join, window, top-k, set and composite queries
(A1-A13, A16, J1-J9, W1, W7, T1-T5, U1, X2-X7, X14, F1-F10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, safe_div
from ..operators import analysis as AN
from ..operators import panel as P
from ..operators import quality as QU
from ..operators import requests as RQ
from ..operators.outliers import detect_anomalies, zscore
from ..operators.quantiles import join_groups, quantiles
from ..sources.tables import Tables
from .oracle import R, fold_sql, with_tables, yield_sql
from .q_panel import X1_DEFAULT, _x1_sql
from .registry import query


def _t(spark, d) -> Tables:
    return Tables.get(spark, d)


RY = R("prod_avance / NULLIF(sup_avance, 0)", 6)

CLOSES_SQL = """
closes AS (
  SELECT cod_provincia, unnest(ultimo) FROM (
    SELECT cod_provincia, max_by({'provincia': provincia, 'ccaa': ccaa, 'cultivo': cultivo,
             'periodo_anio': periodo_anio, 'periodo_mes': periodo_mes, 'sup_avance': sup_avance,
             'prod_avance': prod_avance}, periodo_mes) AS ultimo
    FROM avances WHERE nivel = 'provincia' AND regimen = 'total' AND sup_avance > 0 AND prod_avance IS NOT NULL
    GROUP BY cod_provincia, cultivo, periodo_anio))"""


def _closes(spark, d):
    return P.season_closes(_t(spark, d).avances())


# ----------------------------------------------------------- aggregates
@query("climate_rollup", with_tables("SELECT * FROM clima_provincial"))
def q_climate_rollup(spark, d):
    return _t(spark, d).clima_provincial()


@query("table_summary", with_tables("""
SELECT count(*) AS filas, count(DISTINCT indicativo) AS distintos_indicativo,
       count(DISTINCT cod_provincia) AS distintos_cod_provincia, min(anio) AS min_anio, max(anio) AS max_anio
FROM clima_mensual"""))
def q_table_summary(spark, d):
    return QU.table_summary(_t(spark, d).clima_mensual(), ["indicativo", "cod_provincia"], "anio", "anio")


@query("distinct_weeks", with_tables("""
SELECT count(*) AS filas, count(DISTINCT CAST(anio AS VARCHAR) || '-S' || CAST(semana AS VARCHAR)) AS n_semanas,
       count(DISTINCT producto) AS n_productos FROM coyuntura"""))
def q_distinct_weeks(spark, d):
    c = _t(spark, d).coyuntura()
    return c.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("anio", "semana").alias("n_semanas"),
                 F.count_distinct("producto").alias("n_productos"))


@query("count_by_group", with_tables("SELECT nivel, count(*) AS n FROM avances GROUP BY nivel ORDER BY n DESC, nivel"))
def q_count_by_group(spark, d):
    return AN.count_by(_t(spark, d).avances(), ["nivel"])


@query("count_by_section", with_tables("""
SELECT seccion, count(*) AS n, count(DISTINCT producto) AS n_producto FROM coyuntura
GROUP BY seccion ORDER BY n DESC, seccion"""))
def q_count_by_section(spark, d):
    return AN.count_by(_t(spark, d).coyuntura(), ["seccion"], distinct="producto")


def _null_profile_sql() -> str:
    cols = ["indicativo", "anio", "mes", "t_media", "t_max_abs", "t_min_abs", "t_max_med", "t_min_med",
            "precip_mm", "dias_precip", "horas_sol", "hr_media", "cod_provincia"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS columna, CAST(count_if({c} IS NULL) AS BIGINT) AS nulos, {R(f'count_if({c} IS NULL) * 100.0 / count(*)', 4)} AS pct "
        f"FROM clima_mensual" for c in cols)
    return with_tables(f"SELECT * FROM ({parts}) WHERE nulos > 0")


@query("null_profile", _null_profile_sql())
def q_null_profile(spark, d):
    return QU.null_profile(_t(spark, d).clima_mensual())


@query("group_quantiles", with_tables(f"""
SELECT cultivo, {R("quantile_cont(r, 0.25)", 6)} AS p25, {R("median(r)", 6)} AS p50,
       {R("quantile_cont(r, 0.75)", 6)} AS p75, {R("quantile_cont(r, 0.99)", 6)} AS p99, count(*) AS n
FROM (SELECT cultivo, {RY} AS r FROM closes) GROUP BY cultivo""", CLOSES_SQL))
def q_group_quantiles(spark, d):
    c = _closes(spark, d).withColumn("r", round_half_up(safe_div("prod_avance", "sup_avance"), 6))
    q = quantiles(c, {"p25": ("r", 0.25), "p50": ("r", 0.5), "p75": ("r", 0.75), "p99": ("r", 0.99)}, ["cultivo"])
    n = c.groupBy("cultivo").agg(F.count(F.lit(1)).alias("n"))
    return join_groups(n, q, ["cultivo"]).select(
        "cultivo", *[round_half_up(x, 6).alias(x) for x in ("p25", "p50", "p75", "p99")], "n")


@query("weighted_yield", with_tables(f"""
SELECT cultivo, periodo_anio, {R("sum(sup_avance)", 1)} AS sup_total, {R("sum(prod_avance)", 4)} AS prod_total,
       {R(yield_sql("sum(prod_avance)", "sum(sup_avance)"), 1)} AS rend_kg_ha
FROM closes GROUP BY cultivo, periodo_anio""", CLOSES_SQL))
def q_weighted_yield(spark, d):
    return P.weighted_yield(_closes(spark, d), ["cultivo", "periodo_anio"])


@query("ccaa_rollup", with_tables(f"""
SELECT ccaa, cultivo, periodo_anio, {R("sum(sup_avance)", 1)} AS sup_total, {R("sum(prod_avance)", 4)} AS prod_total,
       count(*) AS n_prov
FROM closes GROUP BY ccaa, cultivo, periodo_anio""", CLOSES_SQL))
def q_ccaa_rollup(spark, d):
    r = AN.ccaa_rollup(_closes(spark, d))
    return r.select("ccaa", "cultivo", "periodo_anio", round_half_up("sup_total", 1).alias("sup_total"),
                    round_half_up("prod_total", 4).alias("prod_total"), "n_prov")


@query("string_agg", with_tables("""
SELECT ccaa, len(list_distinct(list(cod_provincia))) AS n_cod_provincia,
       array_to_string(list_sort(list_distinct(list(provincia))), ', ') AS provincia_lista
FROM avances WHERE nivel = 'provincia' AND periodo_anio = 2000 GROUP BY ccaa"""))
def q_string_agg(spark, d):
    a = _t(spark, d).avances().filter((F.col("nivel") == "provincia") & (F.col("periodo_anio") == 2000))
    return AN.string_agg_distinct(a, "ccaa", "provincia", "cod_provincia")


@query("topk_producers", with_tables("""
SELECT provincia, ccaa, best AS produccion_kt FROM (
  SELECT provincia, ccaa, max(prod_avance) AS best FROM (
    SELECT *, max(periodo_mes) OVER () AS last_month FROM avances WHERE periodo_anio = 2000)
  WHERE nivel = 'provincia' AND contains(cultivo, 'M') AND periodo_mes = last_month
  GROUP BY ALL)
QUALIFY row_number() OVER (ORDER BY best DESC NULLS LAST, provincia) <= 10"""))
def q_topk_producers(spark, d):
    return AN.topk_producers(_t(spark, d).avances(), "M", 2000, 10)


@query("unmatched_count", f"""
SELECT CAST(count_if(temp_media_c IS NULL) AS BIGINT) AS sin_dato, count(*) AS total FROM ({_x1_sql(X1_DEFAULT)})""")
def q_unmatched_count(spark, d):
    t = _t(spark, d)
    return AN.unmatched_count(P.territorial_yield(t.avances(), t.clima_provincial(), X1_DEFAULT), "temp_media_c")


@query("price_kpis", with_tables("""
SELECT producto, seccion, max_by(precio_sem_actual, (anio, semana)) AS ultimo_precio,
       max_by(variacion_pct, (anio, semana)) AS ultima_variacion,
       min(precio_sem_actual) AS precio_min, max(precio_sem_actual) AS precio_max, count(*) AS n_semanas
FROM coyuntura GROUP BY producto, seccion"""))
def q_price_kpis(spark, d):
    return AN.price_kpis(_t(spark, d).coyuntura(), ["producto", "seccion"])


@query("distinct_list", with_tables("SELECT DISTINCT cultivo FROM avances WHERE cultivo IS NOT NULL ORDER BY cultivo"))
def q_distinct_list(spark, d):
    return AN.distinct_sorted(_t(spark, d).avances(), ["cultivo"])


@query("distinct_ccaa", with_tables("""
SELECT DISTINCT ccaa FROM avances WHERE nivel = 'ccaa' AND upper(cultivo) = upper('medium') AND ccaa IS NOT NULL
ORDER BY ccaa"""))
def q_distinct_ccaa(spark, d):
    a = _t(spark, d).avances()
    return AN.distinct_sorted(a, ["ccaa"], (F.col("nivel") == "ccaa") & (F.upper("cultivo") == "MEDIUM"))


@query("level_reconcile", with_tables("""
SELECT p.ccaa, p.cultivo, p.periodo_anio, p.periodo_mes, p.sup_prov, c.sup_avance AS sup_ccaa,
       c.sup_avance - p.sup_prov AS diferencia
FROM (SELECT ccaa, cultivo, periodo_anio, periodo_mes, sum(sup_avance) AS sup_prov FROM avances
      WHERE nivel = 'provincia' GROUP BY ALL) p
JOIN (SELECT * FROM avances WHERE nivel = 'ccaa') c
  ON p.ccaa = c.ccaa AND p.cultivo = c.cultivo AND p.periodo_anio = c.periodo_anio AND p.periodo_mes = c.periodo_mes
WHERE c.sup_avance <> p.sup_prov"""))
def q_level_reconcile(spark, d):
    a = _t(spark, d).avances()
    keys = ["ccaa", "cultivo", "periodo_anio", "periodo_mes"]
    prov = a.filter(F.col("nivel") == "provincia").groupBy(*keys).agg(F.sum("sup_avance").alias("sup_prov"))
    cc = a.filter(F.col("nivel") == "ccaa").select(*keys, F.col("sup_avance").alias("sup_ccaa"))
    return (prov.join(cc, keys).filter(F.col("sup_ccaa") != F.col("sup_prov"))
            .withColumn("diferencia", F.col("sup_ccaa") - F.col("sup_prov")))


# ---------------------------------------------------------------- joins
_J1 = """
SELECT a.cod_provincia, a.cultivo, a.periodo_anio, a.periodo_mes, cp.t_media_c, cp.precip_media_mm,
       cp.cod_provincia IS NULL AS sin_clima
FROM avances a LEFT JOIN clima_provincial cp
  ON a.cod_provincia = cp.cod_provincia AND a.periodo_anio = cp.anio AND a.periodo_mes = cp.mes
WHERE a.nivel = 'provincia'"""


def _j1(spark, d):
    t = _t(spark, d)
    a = t.avances().filter(F.col("nivel") == "provincia")
    cp = t.clima_provincial().select(F.col("cod_provincia").alias("cp_cod"), F.col("anio").alias("cp_anio"),
                                     F.col("mes").alias("cp_mes"), "t_media_c", "precip_media_mm")
    j = a.join(cp, (F.col("cod_provincia") == F.col("cp_cod")) & (F.col("periodo_anio") == F.col("cp_anio"))
               & (F.col("periodo_mes") == F.col("cp_mes")), "left")
    return j.select("cod_provincia", "cultivo", "periodo_anio", "periodo_mes", "t_media_c", "precip_media_mm",
                    F.col("cp_cod").isNull().alias("sin_clima"))


@query("join_yield_climate", with_tables(_J1))
def q_join_yield_climate(spark, d):
    return _j1(spark, d)


@query("join_flag_unmatched", with_tables(f"SELECT sin_clima, count(*) AS n FROM ({_J1}) GROUP BY sin_clima"))
def q_join_flag_unmatched(spark, d):
    return _j1(spark, d).groupBy("sin_clima").agg(F.count(F.lit(1)).alias("n"))


@query("provinces_without_climate", with_tables("""
SELECT DISTINCT cod_provincia FROM avances
WHERE nivel = 'provincia' AND cod_provincia IS NOT NULL
  AND cod_provincia NOT IN (SELECT DISTINCT cod_provincia FROM clima_mensual WHERE cod_provincia IS NOT NULL)"""))
def q_provinces_without_climate(spark, d):
    t = _t(spark, d)
    return AN.provinces_without_climate(t.avances(), t.clima_mensual())


@query("latest_week_movers", with_tables("""
SELECT producto, seccion, precio_sem_actual, variacion_pct, unidad FROM (
  SELECT *, max({'y': anio, 'w': semana}) OVER () AS newest FROM coyuntura)
WHERE {'y': anio, 'w': semana} = newest AND variacion_pct IS NOT NULL
QUALIFY row_number() OVER (ORDER BY variacion_pct DESC, producto, seccion) <= 10"""))
def q_latest_week_movers(spark, d):
    return AN.latest_week_movers(_t(spark, d).coyuntura(), 10)


@query("join_month_week", with_tables("""
SELECT n.y AS periodo_anio, n.m AS periodo_mes, n.area AS sup_ha, n.output AS prod_kt, p.price AS precio
FROM (SELECT periodo_anio AS y, periodo_mes AS m, sup_avance AS area, prod_avance AS output FROM avances
      WHERE nivel = 'nacional' AND cultivo = 'TOTAL CULTIVOS' AND periodo_anio > 1997) n
LEFT JOIN (SELECT anio AS y, semana // 4 AS m, precio_sem_actual AS price FROM coyuntura
           WHERE semana % 4 = 0 AND starts_with(producto, '1-')) p USING (y, m)"""))
def q_join_month_week(spark, d):
    t = _t(spark, d)
    return AN.join_month_week(t.avances(), t.coyuntura(), "TOTAL CULTIVOS", "1-", "nacional", 1998)


@query("dim_lookup_default", with_tables("""
SELECT cp.cod_provincia, cp.anio, cp.mes, COALESCE(d.provincia, 'Provincia ' || CAST(cp.cod_provincia AS VARCHAR)) AS nombre
FROM (SELECT cod_provincia, anio, mes FROM clima_provincial
      UNION ALL SELECT cod_provincia + 100, anio, mes FROM clima_provincial WHERE mes = 1) cp LEFT JOIN (
  SELECT cod_provincia, max_by(provincia, (periodo_anio, periodo_mes, cultivo)) AS provincia FROM avances
  WHERE nivel = 'provincia' GROUP BY cod_provincia) d
  ON cp.cod_provincia = d.cod_provincia"""))
def q_dim_lookup_default(spark, d):
    t = _t(spark, d)
    dim = (t.avances().filter(F.col("nivel") == "provincia")
           .select("cod_provincia", "provincia", F.struct("periodo_anio", "periodo_mes", "cultivo").alias("_o")))
    cp = t.clima_provincial().select("cod_provincia", "anio", "mes")
    # codes without a name, so that the default shows
    cp = cp.unionByName(cp.filter(F.col("mes") == 1).withColumn("cod_provincia", F.col("cod_provincia") + 100))
    return AN.dim_lookup_default(cp, "cod_provincia", dim, "provincia", "nombre", "_o")


@query("semi_join", with_tables("""
SELECT cod_provincia, cultivo, periodo_anio, periodo_mes FROM avances a
WHERE nivel = 'provincia' AND cod_provincia IN (SELECT cod_provincia FROM estaciones WHERE cod_provincia IS NOT NULL)"""))
def q_semi_join(spark, d):
    t = _t(spark, d)
    a = t.avances().filter(F.col("nivel") == "provincia")
    st = t.estaciones().filter(F.col("cod_provincia").isNotNull()).select("cod_provincia")
    return a.join(st, "cod_provincia", "left_semi").select("cod_provincia", "cultivo", "periodo_anio", "periodo_mes")


# -------------------------------------------------------------- windows
@query("close_of_season", with_tables("SELECT * FROM closes", CLOSES_SQL))
def q_close_of_season(spark, d):
    return _closes(spark, d)


@query("zscore", with_tables(f"""
SELECT cultivo, cod_provincia, periodo_anio, r AS rendimiento,
       {R("CASE WHEN s > 0 THEN (r - m) / s END", 6)} AS z
FROM (SELECT cultivo, cod_provincia, periodo_anio, {RY} AS r FROM closes) x
JOIN (SELECT cultivo, cod_provincia, avg({RY}) AS m, stddev_samp({RY}) AS s FROM closes GROUP BY ALL) g
USING (cultivo, cod_provincia)""", CLOSES_SQL))
def q_zscore(spark, d):
    c = _closes(spark, d).select("cultivo", "cod_provincia", "periodo_anio",
                                 round_half_up(safe_div("prod_avance", "sup_avance"), 6).alias("rendimiento"))
    return zscore(c, "rendimiento", ["cultivo", "cod_provincia"])


# --------------------------------------------------------------- top-k
@query("top5_highlight", f"""
SELECT * FROM ({_x1_sql(X1_DEFAULT)}) WHERE rend_kg_ha IS NOT NULL ORDER BY rend_kg_ha DESC, cod_provincia LIMIT 5""")
def q_top5(spark, d):
    t = _t(spark, d)
    return AN.top_highlight(P.territorial_yield(t.avances(), t.clima_provincial(), X1_DEFAULT),
                            "rend_kg_ha", "cod_provincia", 5)


_ABBR = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"


@query("series_query", with_tables(f"""
SELECT periodo_anio, periodo_mes, prod_avance, ccaa AS zona,
       CAST(periodo_anio AS VARCHAR) || '-' || {_ABBR}[periodo_mes] AS periodo
FROM avances WHERE upper(cultivo) = upper('medium') AND nivel = 'ccaa' AND regimen = 'total'
  AND periodo_anio BETWEEN 1996 AND 2000 AND prod_avance IS NOT NULL AND upper(ccaa) = upper('europe')
ORDER BY zona, periodo_anio, periodo_mes"""))
def q_series_query(spark, d):
    return AN.series_query(_t(spark, d).avances(), "medium", "ccaa", "prod_avance", 1996, 2000, ccaa="europe")


@query("series_provinces", with_tables(f"""
SELECT periodo_anio, periodo_mes, sup_avance, provincia AS zona,
       CAST(periodo_anio AS VARCHAR) || '-' || {_ABBR}[periodo_mes] AS periodo
FROM avances WHERE upper(cultivo) = upper('SMALL') AND nivel = 'provincia' AND regimen = 'total'
  AND periodo_anio BETWEEN 1995 AND 2001 AND sup_avance IS NOT NULL AND provincia IN ('NATION_1', 'NATION_6', 'NATION_11')
ORDER BY zona, periodo_anio, periodo_mes"""))
def q_series_provinces(spark, d):
    return AN.series_query(_t(spark, d).avances(), "SMALL", "provincia", "sup_avance", 1995, 2001,
                           provincias=["NATION_1", "NATION_6", "NATION_11"])


@query("sample_rows", with_tables("""
SELECT periodo_anio, periodo_mes, cultivo, nivel, ccaa, cod_provincia, sup_avance, prod_avance FROM avances
WHERE sup_avance IS NOT NULL AND prod_avance IS NOT NULL
ORDER BY periodo_anio DESC, periodo_mes DESC, cultivo, nivel, ccaa, cod_provincia LIMIT 20"""))
def q_sample_rows(spark, d):
    a = _t(spark, d).avances().filter(F.col("sup_avance").isNotNull() & F.col("prod_avance").isNotNull())
    return (a.select("periodo_anio", "periodo_mes", "cultivo", "nivel", "ccaa", "cod_provincia", "sup_avance",
                     "prod_avance")
            .orderBy(F.col("periodo_anio").desc(), F.col("periodo_mes").desc(), "cultivo", "nivel",
                     F.col("ccaa").asc_nulls_first(), F.col("cod_provincia").asc_nulls_first()).limit(20))


# ------------------------------------------------------------------ sets
@query("union_summary", with_tables("""
SELECT 'AVANCES' AS tabla, count(*) AS total, count(DISTINCT cultivo) AS cultivos,
       count(DISTINCT cod_provincia) AS provincias, count(DISTINCT ccaa) AS ccaa,
       min(periodo_anio) AS desde, max(periodo_anio) AS hasta FROM avances
UNION ALL
SELECT 'COYUNTURA', count(*), count(DISTINCT producto), NULL, NULL, min(anio), max(anio) FROM coyuntura"""))
def q_union_summary(spark, d):
    t = _t(spark, d)
    return AN.union_summary(t.avances(), t.coyuntura())


# ------------------------------------------------------------ composites
@query("expand_region", with_tables("""
SELECT ccaa, cod_provincia, provincia, count(*) AS n_filas, cod_provincia = 7 AS es_objetivo
FROM avances
WHERE nivel = 'provincia' AND ccaa IS NOT NULL AND periodo_anio = 2000
  AND ccaa = (SELECT min_by(ccaa, (periodo_anio, periodo_mes, cultivo)) FROM avances
              WHERE nivel = 'provincia' AND ccaa IS NOT NULL AND cod_provincia = 7)
GROUP BY ccaa, cod_provincia, provincia"""))
def q_expand_region(spark, d):
    return AN.expand_region(_t(spark, d).avances(), 7, 2000)


@query("price_series", with_tables("""
SELECT anio, semana, producto, seccion, unidad, precio_sem_anterior, precio_sem_actual, variacion_pct,
       CAST(anio AS VARCHAR) || '-S' || lpad(CAST(semana AS VARCHAR), 2, '0') AS periodo
FROM coyuntura WHERE producto = '3-MEDIUM' AND anio BETWEEN 1996 AND 1999 ORDER BY anio, semana, seccion"""))
def q_price_series(spark, d):
    return AN.price_series(_t(spark, d).coyuntura(), "3-MEDIUM", 1996, 1999)


_ANOM_BASE = f"""
SELECT cultivo, provincia, periodo_anio AS anio, periodo_mes AS mes, {RY} AS rendimiento
FROM avances WHERE nivel = 'provincia' AND regimen = 'total' AND sup_avance > 0 AND prod_avance IS NOT NULL
  AND periodo_anio BETWEEN {{a0}} AND {{a1}} {{extra}}"""


def _anom_sql(a0, a1, extra, min_obs, keep_all, base=None, ctes=""):
    base = base or _ANOM_BASE.format(a0=a0, a1=a1, extra=extra)
    flt = "" if keep_all else "WHERE anomalia"
    return with_tables(f"""
SELECT cultivo, provincia, anio, mes, rendimiento, {R("q1", 9)} AS q1, {R("q3", 9)} AS q3,
       {R("z", 6)} AS z, {R("q1 - 2.0 * (q3 - q1)", 9)} AS lim_inf, {R("q3 + 2.0 * (q3 - q1)", 9)} AS lim_sup,
       anomalia, CASE WHEN COALESCE(z, 0.0) > 0 THEN 'alto' ELSE 'bajo' END AS tipo
FROM (
  SELECT b.*, g.media, g.std, g.q1, g.q3,
         CASE WHEN g.std > 0 THEN (b.rendimiento - g.media) / g.std END AS z,
         COALESCE(g.std > 0 AND abs((b.rendimiento - g.media) / g.std) > 2.5, false)
           OR ((g.q3 - g.q1) > 0 AND (b.rendimiento < g.q1 - 2.0 * (g.q3 - g.q1)
                                       OR b.rendimiento > g.q3 + 2.0 * (g.q3 - g.q1))) AS anomalia
  FROM (SELECT * FROM ({base}) WHERE rendimiento IS NOT NULL) b
  JOIN (SELECT cultivo, provincia, count(*) AS n, avg(rendimiento) AS media, stddev_samp(rendimiento) AS std,
               quantile_cont(rendimiento, 0.25) AS q1, quantile_cont(rendimiento, 0.75) AS q3
        FROM ({base}) WHERE rendimiento IS NOT NULL GROUP BY cultivo, provincia HAVING count(*) >= {min_obs}) g
  USING (cultivo, provincia)) {flt}""", ctes)


def _anom_base(spark, d, a0, a1, cultivo=None, provincia=None):
    a = _t(spark, d).avances()
    preds = [F.col("nivel") == "provincia", F.col("regimen") == "total", F.col("sup_avance") > 0,
             F.col("prod_avance").isNotNull(), F.col("periodo_anio").between(a0, a1)]
    if cultivo:
        preds.append(F.upper("cultivo") == cultivo.upper())
    if provincia:
        preds.append(F.lower("provincia") == provincia.lower())
    return a.filter(P.all_of(preds)).select(
        "cultivo", "provincia", F.col("periodo_anio").alias("anio"), F.col("periodo_mes").alias("mes"),
        round_half_up(safe_div("prod_avance", "sup_avance"), 6).alias("rendimiento"))


ANOM_COLS = ["cultivo", "provincia", "anio", "mes", "rendimiento", "q1", "q3", "z",
             "lim_inf", "lim_sup", "anomalia", "tipo"]


@query("anomalies_all", _anom_sql(1995, 2001, "", 5, False))
def q_anomalies_all(spark, d):
    b = _anom_base(spark, d, 1995, 2001)
    return detect_anomalies(b, "rendimiento", ["cultivo", "provincia"], "ambos", min_obs=5).select(*ANOM_COLS)


@query("anomalies_series", _anom_sql(1995, 2001, "AND upper(cultivo) = upper('economy') AND lower(provincia) = lower('NATION_3')", 0, True))
def q_anomalies_series(spark, d):
    b = _anom_base(spark, d, 1995, 2001, "economy", "NATION_3")
    return detect_anomalies(b, "rendimiento", ["cultivo", "provincia"], "ambos", min_obs=0,
                            keep_all=True).select(*ANOM_COLS)


# Requests made of the panel's own names: a part of each crop's name, in turn with a part of a province's name, with
# each method; and one for everything.
_ANOM_REQ_SQL = """
SELECT cultivo AS req_id, substr(cultivo, 1, 1 + length(cultivo) % 4) AS c,
       CASE WHEN length(cultivo) % 2 = 0 THEN substr(max(provincia), 3, 6) ELSE '' END AS p,
       1994 + length(cultivo) % 3 AS a0, 2001 AS a1,
       CASE length(cultivo) % 3 WHEN 0 THEN 'zscore' WHEN 1 THEN 'iqr' ELSE 'ambos' END AS m
FROM avances WHERE nivel = 'provincia' GROUP BY cultivo
UNION ALL SELECT '*', '', '', 1995, 2001, 'iqr'"""


@query("anomaly_requests", with_tables(f"""
SELECT req_id, m AS metodo, cultivo, provincia, anio, mes, y AS rendimiento,
       {R("CASE WHEN sd > 0 THEN (y - mu) / sd END", 6)} AS z, {R("mu", 4)} AS media, {R("sd", 4)} AS std,
       CASE WHEN sd > 0 AND y > mu THEN 'alto' ELSE 'bajo' END AS tipo,
       (SELECT count(*) FROM base b WHERE b.req_id = base.req_id) AS n_filas
FROM base JOIN g USING (req_id, cultivo, provincia)
WHERE (m <> 'iqr' AND sd > 0 AND abs(y - mu) / sd > 2.5)
   OR (m <> 'zscore' AND hi > lo AND (y < lo - 2 * (hi - lo) OR y > hi + 2 * (hi - lo)))""", f"""
req AS ({_ANOM_REQ_SQL}),
base AS (
  SELECT r.req_id, r.m, a.cultivo, a.provincia, a.periodo_anio AS anio, a.periodo_mes AS mes, {RY} AS y
  FROM avances a JOIN req r ON a.periodo_anio BETWEEN r.a0 AND r.a1
    AND contains(upper(a.cultivo), upper(r.c)) AND contains(lower(a.provincia), lower(r.p))
  WHERE nivel = 'provincia' AND regimen = 'total' AND sup_avance > 0 AND prod_avance IS NOT NULL),
g AS (
  SELECT req_id, cultivo, provincia, avg(y) AS mu, stddev_samp(y) AS sd, quantile_cont(y, 0.25) AS lo,
         quantile_cont(y, 0.75) AS hi
  FROM base GROUP BY ALL HAVING count(y) >= 5)"""))
def q_anomaly_requests(spark, d):
    a = _t(spark, d).avances()
    n = F.length("cultivo")
    req = a.where("nivel = 'provincia'").groupBy("cultivo").agg(F.max("provincia").alias("p")).select(
        F.col("cultivo").alias("req_id"), F.col("cultivo").substr(F.lit(1), 1 + n % 4).alias("cultivo"),
        F.when(n % 2 == 0, F.substring("p", 3, 6)).otherwise("").alias("provincia"),
        (1994 + n % 3).alias("anio_ini"), F.lit(2001).alias("anio_fin"),
        F.element_at(F.array(F.lit("zscore"), F.lit("iqr"), F.lit("ambos")), n % 3 + 1).alias("metodo"))
    req = req.unionByName(spark.createDataFrame([("*", "", "", 1995, 2001, "iqr")], req.schema))
    return RQ.anomaly_requests(a, req)


# One map for each province: its own region, a part of a crop's name, a period that turns the year for some.
_REGION_REQ_SQL = """
SELECT cod_provincia AS req_id, lower(substr(max(cultivo), 1, 1 + cod_provincia % 3)) AS c, 1995 + cod_provincia % 3 AS a0,
       1999 AS a1, CASE WHEN cod_provincia % 4 = 0 THEN 9 ELSE 1 END AS m0,
       CASE WHEN cod_provincia % 4 = 0 THEN 4 ELSE 12 END AS m1,
       CASE WHEN cod_provincia % 5 = 1 THEN max(ccaa) END AS named, cod_provincia AS target
FROM avances WHERE nivel = 'provincia' GROUP BY cod_provincia
UNION ALL SELECT -1, 'small', 1996, 1998, 1, 12, NULL, NULL"""


@query("expand_region_x1", with_tables(f"""
SELECT area.req_id, provincia, area.cod_provincia, n_cultivos, n_periodos, {R("s", 0)} AS sup_total_ha,
       {R(yield_sql("p", "s"), 1)} AS rend_kg_ha, {R("t", 1)} AS temp_media_c, {R("w", 1)} AS precip_media_mm,
       {R("h", 1)} AS hr_media_pct, coalesce(area.cod_provincia = target, FALSE) AS es_objetivo
FROM area LEFT JOIN clima ON clima.req_id = area.req_id AND clima.cod_provincia = area.cod_provincia""", f"""
req AS (
  SELECT r.*, CASE WHEN m0 > m1 AND a0 < a1 THEN 12 * a0 + m0 END AS x0, 12 * a1 + m1 AS x1,
         coalesce(named, (SELECT min_by(ccaa, (periodo_anio, periodo_mes, cultivo)) FROM avances h
                          WHERE h.nivel = 'provincia' AND h.ccaa IS NOT NULL AND h.cod_provincia = r.target)) AS home
  FROM ({_REGION_REQ_SQL}) r),
seen AS (
  SELECT r.req_id, r.target, a.*, contains(upper(cultivo), 'TOTAL') AS total
  FROM avances a JOIN req r ON contains({fold_sql("cultivo")}, {fold_sql("r.c")})
   AND (home IS NULL OR contains(upper(ccaa), upper(string_split(replace(home, 'La ', ''), ' ')[1])))
   AND CASE WHEN x0 IS NULL THEN periodo_anio BETWEEN a0 AND a1 AND periodo_mes BETWEEN m0 AND m1
            ELSE 12 * periodo_anio + periodo_mes BETWEEN x0 AND x1 END
  WHERE nivel = 'provincia' AND cod_provincia IS NOT NULL AND sup_avance > 0 AND prod_avance IS NOT NULL),
last AS (
  SELECT req_id, target, cod_provincia, cultivo, periodo_anio,
         max_by({{'provincia': provincia, 's': sup_avance, 'p': prod_avance}}, periodo_mes) AS x
  FROM seen WHERE total = (SELECT bool_or(total) FROM seen o WHERE o.req_id = seen.req_id) GROUP BY ALL),
area AS (
  SELECT req_id, target, cod_provincia, x.provincia AS provincia, count(DISTINCT cultivo) AS n_cultivos,
         count(DISTINCT periodo_anio) AS n_periodos, sum(x.s) AS s, sum(x.p) AS p FROM last GROUP BY ALL),
clima AS (
  SELECT r.req_id, k.cod_provincia, avg(t_media_c) AS t, avg(precip_media_mm) AS w, avg(hr_media_pct) AS h
  FROM clima_provincial k JOIN req r ON k.mes BETWEEN 1 AND 12 AND
    CASE WHEN x0 IS NULL THEN anio BETWEEN a0 AND a1 AND mes BETWEEN m0 AND m1 ELSE 12 * anio + mes BETWEEN x0 AND x1 END
  GROUP BY ALL)"""))
def q_expand_region_x1(spark, d):
    t = _t(spark, d)
    k = F.col("cod_provincia")
    turn = k % 4 == 0
    req = t.avances().where("nivel = 'provincia'").groupBy("cod_provincia").agg(
        F.max("cultivo").alias("c"), F.max("ccaa").alias("named")).select(
        k.alias("req_id"), F.lower(F.col("c").substr(F.lit(1), 1 + k % 3)).alias("cultivo"),
        (1995 + k % 3).alias("anio_ini"), F.lit(1999).alias("anio_fin"), F.when(turn, 9).otherwise(1).alias("mes_ini"),
        F.when(turn, 4).otherwise(12).alias("mes_fin"), F.when(k % 5 == 1, F.col("named")).alias("ccaa"),
        k.alias("cod_provincia"))
    req = req.unionByName(spark.createDataFrame([(-1, "small", 1996, 1998, 1, 12, None, None)], req.schema))
    return RQ.region_requests(t.avances(), t.clima_provincial(), req)


@query("cumulative_overcount", with_tables(f"""
SELECT cod_provincia, cultivo, periodo_anio, count(*) AS n_meses, sum(sup_avance) AS sup_sum_meses,
       max_by(sup_avance, periodo_mes) AS sup_cierre,
       {R("sum(sup_avance) / NULLIF(max_by(sup_avance, periodo_mes), 0)", 6)} AS ratio,
       {R("sum(sup_avance) / NULLIF(max_by(sup_avance, periodo_mes), 0)", 6)} > 1.0 AS sobreconteo
FROM avances WHERE nivel = 'provincia' AND sup_avance IS NOT NULL AND sup_avance > 0
GROUP BY cod_provincia, cultivo, periodo_anio"""))
def q_cumulative_overcount(spark, d):
    return P.cumulative_overcount(_t(spark, d).avances())


# --------------------------------------------------------------- filters
@query("filter_eq", with_tables("""
SELECT cultivo, periodo_mes, sup_avance, prod_avance FROM avances
WHERE nivel = 'nacional' AND regimen = 'total' AND periodo_anio = 2000"""))
def q_filter_eq(spark, d):
    a = _t(spark, d).avances()
    return a.filter((F.col("nivel") == "nacional") & (F.col("regimen") == "total") & (F.col("periodo_anio") == 2000)) \
        .select("cultivo", "periodo_mes", "sup_avance", "prod_avance")


@query("filter_between", with_tables("""
SELECT cultivo, cod_provincia, periodo_anio, periodo_mes FROM avances
WHERE periodo_anio BETWEEN 1997 AND 1998 AND periodo_mes BETWEEN 4 AND 9 AND nivel = 'provincia'"""))
def q_filter_between(spark, d):
    a = _t(spark, d).avances()
    return a.filter(F.col("periodo_anio").between(1997, 1998) & F.col("periodo_mes").between(4, 9)
                    & (F.col("nivel") == "provincia")).select("cultivo", "cod_provincia", "periodo_anio", "periodo_mes")


@query("filter_ci", with_tables("""
SELECT DISTINCT provincia FROM avances WHERE nivel = 'provincia' AND upper(ccaa) = upper('Europe')
  AND lower(cultivo) = lower('Promo')"""))
def q_filter_ci(spark, d):
    a = _t(spark, d).avances()
    return a.filter((F.col("nivel") == "provincia") & (F.upper("ccaa") == "EUROPE")
                    & (F.lower("cultivo") == "promo")).select("provincia").distinct()


@query("filter_like", with_tables("""
SELECT DISTINCT cultivo FROM avances WHERE upper(cultivo) LIKE '%AL%'
  AND upper(cultivo) NOT LIKE '%POR VARIEDADES%' AND upper(cultivo) NOT LIKE '%RESUMEN GENERAL%'
  AND cultivo NOT LIKE '%(*)%' AND cultivo LIKE 'S%'"""))
def q_filter_like(spark, d):
    a = _t(spark, d).avances()
    c = F.upper("cultivo")
    return a.filter(c.contains("AL") & ~c.contains("POR VARIEDADES") & ~c.contains("RESUMEN GENERAL")
                    & ~F.col("cultivo").contains("(*)") & F.col("cultivo").startswith("S")).select("cultivo").distinct()


@query("filter_in", with_tables("""
SELECT provincia, periodo_anio, count(*) AS n FROM avances
WHERE provincia IN ('NATION_2', 'NATION_4', 'NATION_8') GROUP BY provincia, periodo_anio"""))
def q_filter_in(spark, d):
    a = _t(spark, d).avances()
    return a.filter(F.col("provincia").isin("NATION_2", "NATION_4", "NATION_8")) \
        .groupBy("provincia", "periodo_anio").agg(F.count(F.lit(1)).alias("n"))


@query("filter_notnull", with_tables("""
SELECT cod_provincia, cultivo, periodo_anio, periodo_mes, sup_avance FROM avances
WHERE prod_avance IS NULL AND sup_avance IS NOT NULL"""))
def q_filter_notnull(spark, d):
    a = _t(spark, d).avances()
    return a.filter(F.col("prod_avance").isNull() & F.col("sup_avance").isNotNull()) \
        .select("cod_provincia", "cultivo", "periodo_anio", "periodo_mes", "sup_avance")


@query("validity_counts", with_tables("""
SELECT regla, CAST(n AS BIGINT) AS n FROM (
SELECT 'meses_invalidos' AS regla, count_if(periodo_mes NOT BETWEEN 1 AND 12) AS n FROM avances
UNION ALL SELECT 'anios_invalidos', count_if(periodo_anio NOT BETWEEN 1995 AND 2001) FROM avances
UNION ALL SELECT 'semanas_invalidas', count_if(semana NOT BETWEEN 1 AND 53) FROM coyuntura
UNION ALL SELECT 'variaciones_extremas', count_if(abs(variacion_pct) > 50) FROM coyuntura)"""))
def q_validity_counts(spark, d):
    t = _t(spark, d)
    a = QU.validity_counts(t.avances(), {"meses_invalidos": ~F.col("periodo_mes").between(1, 12),
                                         "anios_invalidos": ~F.col("periodo_anio").between(1995, 2001)})
    c = QU.validity_counts(t.coyuntura(), {"semanas_invalidas": ~F.col("semana").between(1, 53),
                                           "variaciones_extremas": F.abs("variacion_pct") > 50})
    return (a.unpivot([], a.columns, "regla", "n")
            .unionByName(c.unpivot([], c.columns, "regla", "n")))


@query("latest_month_filter", with_tables("""
SELECT cod_provincia, cultivo, periodo_mes, prod_avance FROM avances
WHERE nivel = 'provincia' AND periodo_anio = 2000
  AND periodo_mes = (SELECT max(periodo_mes) FROM avances WHERE periodo_anio = 2000)"""))
def q_latest_month_filter(spark, d):
    a = _t(spark, d).avances()
    latest = a.filter(F.col("periodo_anio") == 2000).agg(F.max("periodo_mes")).scalar()
    return a.filter((F.col("nivel") == "provincia") & (F.col("periodo_anio") == 2000)
                    & (F.col("periodo_mes") == latest)).select("cod_provincia", "cultivo", "periodo_mes", "prod_avance")


@query("series_column", with_tables("""
SELECT count(DISTINCT provincia) AS provincia, count(DISTINCT ccaa) AS ccaa, count(DISTINCT nivel) AS nivel,
       CASE WHEN count(DISTINCT provincia) > 1 THEN 'provincia' WHEN count(DISTINCT ccaa) > 1 THEN 'ccaa'
            WHEN count(DISTINCT nivel) > 1 THEN 'nivel' END AS columna_serie
FROM avances WHERE upper(cultivo) = 'SMALL' AND nivel = 'ccaa'"""))
def q_series_column(spark, d):
    a = _t(spark, d).avances().filter((F.upper("cultivo") == "SMALL") & (F.col("nivel") == "ccaa"))
    return AN.series_column_counts(a)


@query("anomaly_kpis", f"""
SELECT cultivo, provincia, count(rendimiento) AS observaciones, CAST(count_if(anomalia) AS BIGINT) AS anomalias,
       {R("count_if(anomalia) * 100.0 / count(rendimiento)", 1)} AS pct_anomalias,
       {R("avg(rendimiento)", 9)} AS media, {R("stddev_samp(rendimiento)", 9)} AS std
FROM ({_anom_sql(1995, 2001, "AND upper(cultivo) = upper('economy') AND lower(provincia) = lower('NATION_3')", 0, True)})
GROUP BY cultivo, provincia""")
def q_anomaly_kpis(spark, d):
    from ..operators.outliers import series_kpis
    b = _anom_base(spark, d, 1995, 2001, "economy", "NATION_3")
    a = detect_anomalies(b, "rendimiento", ["cultivo", "provincia"], "ambos", min_obs=0, keep_all=True)
    return series_kpis(a, "rendimiento", ["cultivo", "provincia"]).withColumns(
        {c: round_half_up(c, 9) for c in ("media", "std")})


_CLOSE_BASE = f"""
SELECT cultivo, provincia, periodo_anio AS anio, periodo_mes AS mes, {RY} AS rendimiento FROM closes"""


@query("anomalies_closes", _anom_sql(0, 0, "", 5, False, base=_CLOSE_BASE, ctes=CLOSES_SQL))
def q_anomalies_closes(spark, d):
    """Anomalies on season closes only (trap Q23: not on every cumulative month)."""
    c = _closes(spark, d).select("cultivo", "provincia", F.col("periodo_anio").alias("anio"),
                                 F.col("periodo_mes").alias("mes"),
                                 round_half_up(safe_div("prod_avance", "sup_avance"), 6).alias("rendimiento"))
    return detect_anomalies(c, "rendimiento", ["cultivo", "provincia"], "ambos", min_obs=5).select(*ANOM_COLS)
