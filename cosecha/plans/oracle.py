"""DuckDB SQL for the correctness oracle.

The driver registers the raw tables as views; the domain tables the queries
talk about (avances, coyuntura, estaciones, clima_mensual, clima_provincial)
are rebuilt here as CTEs with exactly the definitions of
``cosecha.sources.tables``.  ``with_tables(body)`` prepends the CTEs a query
body mentions, in dependency order.
"""

from __future__ import annotations

import re


def R(expr: str, digits: int) -> str:
    """SQL twin of ``round_half_up``: the decimal value to about 15 digits, rounded half away from zero."""
    rounded = lambda scale: f"CAST(ROUND(CAST(v AS DECIMAL(38,{scale})), {digits}) AS DOUBLE)"
    sizes = " ".join(f"WHEN abs(v) < {size} THEN {rounded(scale)}" for size, scale in
                     ((1, 15), (10, 14), (100, 13), (1000, 12)))
    return f"list_transform([CAST({expr} AS DOUBLE)], lambda v: CASE {sizes} ELSE {rounded(9)} END)[1]"


def fold_sql(expr: str) -> str:
    """SQL twin of ``fold_accents``."""
    return f"lower(translate({expr}, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunaeiouun'))"


def yield_sql(prod: str, sup: str) -> str:
    return f"({prod} / NULLIF({sup}, 0) * 1000000.0)"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}

CTES["avances"] = ("""
_av_monthly AS (
  SELECT c.c_nationkey AS nk, p.p_type,
         CAST(year(l.l_shipdate) AS INTEGER) AS periodo_anio,
         CAST(month(l.l_shipdate) AS INTEGER) AS periodo_mes,
         SUM(CAST(ROUND(l.l_quantity) AS BIGINT)) AS qty,
         SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS price_cents
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY ALL),
_av_geo AS (
  SELECT m.*, n.n_nationkey, n.n_name, r.r_name
  FROM _av_monthly m JOIN nation n ON m.nk = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
_av_gs AS (
  SELECT r_name, n_nationkey, n_name, p_type, periodo_anio, periodo_mes,
         SUM(qty) AS qty, SUM(price_cents) AS price_cents,
         GROUPING(n_nationkey) AS g_n, GROUPING(r_name) AS g_r
  FROM _av_geo
  GROUP BY GROUPING SETS (
    (r_name, n_nationkey, n_name, p_type, periodo_anio, periodo_mes),
    (r_name, n_nationkey, n_name, periodo_anio, periodo_mes),
    (r_name, p_type, periodo_anio, periodo_mes),
    (r_name, periodo_anio, periodo_mes),
    (p_type, periodo_anio, periodo_mes),
    (periodo_anio, periodo_mes))),
_av_cum AS (
  SELECT periodo_anio, periodo_mes,
         COALESCE(p_type, 'TOTAL CULTIVOS') AS cultivo, 'total' AS regimen,
         CASE WHEN g_n = 0 THEN 'provincia' WHEN g_r = 0 THEN 'ccaa' ELSE 'nacional' END AS nivel,
         CAST(n_nationkey AS INTEGER) AS cod_provincia, n_name AS provincia,
         COALESCE(r_name, 'ESPAÑA') AS ccaa,
         SUM(qty) OVER w AS qty_cum, SUM(price_cents) OVER w AS cents_cum
  FROM _av_gs
  WINDOW w AS (PARTITION BY g_n, g_r, r_name, n_nationkey, p_type, periodo_anio
               ORDER BY periodo_mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
avances AS (
  SELECT periodo_anio, periodo_mes, cultivo, regimen, nivel, cod_provincia, provincia, ccaa,
         CASE WHEN nivel = 'provincia' AND (cod_provincia * 31 + periodo_mes + periodo_anio) % 17 = 1
              THEN -(CAST(qty_cum AS DOUBLE) * 10.0) ELSE CAST(qty_cum AS DOUBLE) * 10.0 END AS sup_avance,
         CASE WHEN nivel = 'provincia' AND (cod_provincia * 31 + periodo_mes + periodo_anio) % 17 = 0
              THEN NULL ELSE CAST(cents_cum AS DOUBLE) / 100000.0 END AS prod_avance,
         periodo_mes AS mes_avance, periodo_anio AS anio_avance
  FROM _av_cum)""", ())

CTES["coyuntura"] = (f"""
_cy_wk AS (
  SELECT CAST(isoyear(o_orderdate) AS INTEGER) AS anio, CAST(week(o_orderdate) AS INTEGER) AS semana,
         o_orderpriority AS producto, o_orderstatus AS status,
         SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS c, COUNT(*) AS n
  FROM orders GROUP BY ALL),
_cy_px AS (
  SELECT *, CASE WHEN (semana * 7 + anio) % 41 = 0 THEN 0.0
                 ELSE CAST(c AS DOUBLE) / CAST(n * 100 AS DOUBLE) END AS precio_sem_actual
  FROM _cy_wk),
_cy_lag AS (
  SELECT *, LAG(precio_sem_actual) OVER (PARTITION BY producto, status ORDER BY anio, semana)
            AS precio_sem_anterior
  FROM _cy_px),
coyuntura AS (
  SELECT anio, semana,
         CASE status WHEN 'F' THEN 'agricola' WHEN 'O' THEN 'frutihort' ELSE 'ganadero' END AS seccion,
         'PRIORIDAD ' || substr(producto, 1, 1) AS categoria, producto, '€/pedido' AS unidad,
         precio_sem_anterior, precio_sem_actual,
         precio_sem_actual - precio_sem_anterior AS variacion_euros,
         {R("(precio_sem_actual - precio_sem_anterior) / NULLIF(precio_sem_anterior, 0) * 100", 2)}
           AS variacion_pct,
         false AS es_subtipo
  FROM _cy_lag)""", ())

CTES["estaciones"] = ("""
estaciones AS (
  SELECT printf('S%05d', s_suppkey) AS indicativo, s_name AS nombre, upper(n_name) AS provincia,
         CAST(CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS INTEGER) AS cod_provincia,
         s_acctbal AS altitud,
         '40.' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS latitud,
         '-3.' || lpad(CAST(s_suppkey % 997 AS VARCHAR), 3, '0') AS longitud
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)""", ())

CTES["clima_mensual"] = ("""
_cm0 AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS anio, CAST(month(l_shipdate) AS INTEGER) AS mes,
         SUM(CAST(ROUND(l_quantity) AS BIGINT)) AS q, COUNT(*) AS n,
         SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS d,
         MAX(l_quantity) AS qmax, MIN(l_quantity) AS qmin
  FROM lineitem GROUP BY ALL),
_cm1 AS (
  SELECT printf('S%05d', l_suppkey) AS indicativo, anio, mes,
         (l_suppkey * 31 + anio * 12 + mes) % 9 = 0 AS gap, q, n, d, qmax, qmin
  FROM _cm0),
clima_mensual AS (
  SELECT m.indicativo, anio, mes,
         CASE WHEN gap THEN NULL ELSE CAST(q AS DOUBLE) / CAST(n AS DOUBLE) END AS t_media,
         CAST(NULL AS DOUBLE) AS t_max_abs, CAST(NULL AS DOUBLE) AS t_min_abs,
         qmax AS t_max_med, qmin AS t_min_med,
         CASE WHEN gap THEN NULL ELSE CAST(q AS DOUBLE) END AS precip_mm,
         CASE WHEN mes % 7 = 0 THEN CAST(n AS DOUBLE) END AS dias_precip,
         CAST(NULL AS DOUBLE) AS horas_sol,
         CASE WHEN gap THEN NULL ELSE CAST(d * 10 AS DOUBLE) / CAST(n AS DOUBLE) END AS hr_media,
         e.cod_provincia
  FROM _cm1 m LEFT JOIN estaciones e ON m.indicativo = e.indicativo)""", ("estaciones",))

CTES["clima_provincial"] = (f"""
clima_provincial AS (
  SELECT cod_provincia, anio, mes,
         {R("AVG(t_media)", 1)} AS t_media_c,
         {R("MAX(t_max_abs)", 1)} AS t_max_abs_c,
         {R("MIN(t_min_abs)", 1)} AS t_min_abs_c,
         {R("AVG(precip_mm)", 1)} AS precip_media_mm,
         {R("AVG(horas_sol)", 1)} AS horas_sol_med,
         {R("AVG(hr_media)", 1)} AS hr_media_pct,
         COUNT(*) AS n_estaciones
  FROM clima_mensual WHERE cod_provincia IS NOT NULL
  GROUP BY cod_provincia, anio, mes)""", ("clima_mensual",))

CTES["raw_numbers"] = ("""
raw_numbers AS (
  SELECT l_orderkey, l_linenumber,
    CASE (l_orderkey * 7 + l_linenumber) % 12
      WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'Ip' WHEN 3 THEN 'Varias'
      WHEN 4 THEN CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR)
      WHEN 5 THEN '1.' || lpad(CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR), 3, '0') || ',5'
      WHEN 6 THEN CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR)
      WHEN 7 THEN ' ' || CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR) || ' '
      WHEN 8 THEN CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR) || 'd'
      WHEN 9 THEN CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR) || '_000'
      WHEN 10 THEN '—'
      ELSE '-' || CAST(CAST(ROUND(l_quantity) AS BIGINT) AS VARCHAR) || 'e1' END AS raw
  FROM lineitem)""", ())

_MONTHS_SQL = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"

CTES["raw_filenames"] = (f"""
_fn_ym AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m
           FROM orders),
raw_filenames AS (
  SELECT CASE (y * 12 + m) % 5
    WHEN 0 THEN 'data/cuaderno_' || {_MONTHS_SQL}[m] || CAST(y AS VARCHAR) || '.xls'
    WHEN 1 THEN 'cuaderno_' || upper({_MONTHS_SQL}[m]) || CAST(y AS VARCHAR) || '.xlsx'
    WHEN 2 THEN 'cuaderno_' || {_MONTHS_SQL}[m] || '_' || CAST(y AS VARCHAR) || '.xls'
    WHEN 3 THEN 'cuaderno_foo' || CAST(y AS VARCHAR) || '.xls'
    ELSE 'otro_' || {_MONTHS_SQL}[m] || '.xls' END AS archivo
  FROM _fn_ym)""", ())


def _prov_ccaa_sql() -> str:
    from ..dims import PROV_TO_CCAA, values_sql
    return values_sql(PROV_TO_CCAA, "cod", "ccaa_map")


CTES["raw_row_labels"] = (f"""
raw_row_labels AS (
  SELECT c_custkey,
    CASE c_custkey % 9
      WHEN 0 THEN lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || ' ' || n_name
      WHEN 1 THEN ccaa_map
      WHEN 2 THEN 'TOTAL ESPAÑA'
      WHEN 3 THEN 'SUMA PROVINCIAS'
      WHEN 4 THEN '(' || c_name
      WHEN 5 THEN '* ' || c_name
      WHEN 6 THEN NULL
      WHEN 7 THEN '   '
      ELSE c_name END AS celda
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN {_prov_ccaa_sql()} cm ON n_nationkey + 1 = cm.cod)""", ())

CTES["raw_products"] = ("""
raw_products AS (
  SELECT p_partkey,
    CASE p_partkey % 4
      WHEN 0 THEN p_name || ' (€/t)'
      WHEN 1 THEN upper(p_name) || ' (€/100 kg) *'
      WHEN 2 THEN p_name || ' € libre'
      ELSE '  ' || p_name || ' (€/docena)  ' END AS raw
  FROM part)""", ())

CTES["raw_climate_dates"] = ("""
raw_climate_dates AS (
  SELECT indicativo,
    CASE (anio * 12 + mes) % 6
      WHEN 0 THEN CAST(anio AS VARCHAR)
      WHEN 1 THEN CAST(anio AS VARCHAR) || '-xx'
      WHEN 5 THEN CAST(anio AS VARCHAR) || '-13'
      ELSE CAST(anio AS VARCHAR) || '-' || CAST(mes AS VARCHAR) END AS fecha
  FROM clima_mensual)""", ("clima_mensual",))


def _questions_sql() -> str:
    from ..dims import CHAT_CROPS, CHAT_PROVINCE_CODE, CHAT_RANKING_WORDS
    from ..functions.text import MONTHS_ES

    def arr(xs):
        return "[" + ",".join("'" + x + "'" for x in xs) + "]"
    crops, provs, ranks = arr(CHAT_CROPS), arr(list(CHAT_PROVINCE_CODE)), arr(CHAT_RANKING_WORDS)
    months = arr([m.capitalize() for m in MONTHS_ES])

    def cap(x):
        return f"(upper(substr({x}, 1, 1)) || substr({x}, 2, 1000))"
    crop = f"{crops}[o_orderkey % {len(CHAT_CROPS)} + 1]"
    prov = f"{provs}[o_custkey % {len(CHAT_PROVINCE_CODE)} + 1]"
    rank = f"{ranks}[o_orderkey % {len(CHAT_RANKING_WORDS)} + 1]"
    m0 = f"{months}[month(o_orderdate)]"
    m1 = f"{months}[(month(o_orderdate) + 10) % 12 + 1]"
    y0 = "CAST(year(o_orderdate) + 25 AS VARCHAR)"
    y1 = "CAST(year(o_orderdate) + 26 AS VARCHAR)"
    return f"""
raw_questions AS (
  SELECT o_orderkey AS q_id, CASE o_orderkey % 4
    WHEN 0 THEN 'Rendimiento de ' || {crop} || ' en ' || {cap(prov)} || ' entre ' || {m0} || ' de ' || {y0}
                || ' y ' || {m1} || ' de ' || {y1}
    WHEN 1 THEN '¿' || {cap(rank)} || ' de ' || {crop} || ' en ' || {y0} || '?'
    WHEN 2 THEN 'Producción de ' || upper({crop}) || ' por provincia en ' || {m0}
    ELSE 'Evolución del precio en ' || {cap(prov)} END AS pregunta
  FROM orders)"""


CTES["raw_questions"] = (_questions_sql(), ())


def _needed(body: str) -> list[str]:
    order: list[str] = []

    def visit(name: str):
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    return order


def with_tables(body: str, extra_ctes: str = "") -> str:
    """Prepend the domain-table CTEs that ``body`` (and ``extra_ctes``) use.

    ``body`` is a SELECT; ``extra_ctes`` are further ``name AS (...)`` items
    placed after the domain tables.
    """
    names = _needed(body + " " + extra_ctes)
    parts = [CTES[n][0].strip() for n in names]
    if extra_ctes.strip():
        parts.append(extra_ctes.strip())
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
