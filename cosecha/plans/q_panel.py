"""Queries over the crop-advance panel: X1, W1, W2, A7, X2, X5, X14, F*."""

from __future__ import annotations


from ..operators import panel as P
from ..sources.tables import Tables
from .oracle import R, fold_sql, with_tables, yield_sql
from .registry import query

EXCL = " ".join(f"AND UPPER(cultivo) NOT LIKE '%{p}%'" for p in P.EXCLUDED_CROP_PATTERNS) + \
    " AND cultivo NOT LIKE '%(*)%'"


def _in_period(q: P.TerritorialQuery, year: str, month: str) -> str:
    """SQL condition of the query's period on the given year and month columns."""
    if q.mes_ini <= q.mes_fin or q.anio_ini >= q.anio_fin:
        return f"{year} BETWEEN {q.anio_ini} AND {q.anio_fin} AND {month} BETWEEN {q.mes_ini} AND {q.mes_fin}"
    if q.compat_period:  # only the first year's end and the last year's begin
        return f"({year}, {month} >= {q.mes_ini}) = ({q.anio_ini}, true) OR " \
               f"({year}, {month} <= {q.mes_fin}) = ({q.anio_fin}, true)"
    first, last = 12 * q.anio_ini + q.mes_ini, 12 * q.anio_fin + q.mes_fin
    return f"12 * {year} + {month} >= {first} AND 12 * {year} + {month} <= {last}"


def _x1_sql(q: P.TerritorialQuery) -> str:
    """The operator's result from its specification: one observation (the latest) for each province, crop and
    year of the wanted crops, TOTAL rows alone if there are any; sums of these by province; and the mean of the
    province's climate over the same period, looked up province by province."""
    region = f"AND contains(UPPER(ccaa), '{q.ccaa.upper()}')" if q.ccaa else ""
    ctes = f"""
wanted AS (
  SELECT cod_provincia AS province, cultivo AS crop, periodo_anio AS year, contains(UPPER(cultivo), 'TOTAL') AS total,
         {{'month': periodo_mes, 'name': provincia, 'area': sup_avance, 'output': prod_avance}} AS seen
  FROM avances
  WHERE nivel = 'provincia' AND cod_provincia IS NOT NULL AND prod_avance IS NOT NULL AND sup_avance > 0
    AND ({_in_period(q, 'periodo_anio', 'periodo_mes')}) {region} {EXCL}
    AND contains({fold_sql('cultivo')}, '{P._fold_py(q.cultivo)}')),
ends AS (
  SELECT province, crop, year, max_by(seen, seen.month) AS latest FROM wanted
  WHERE total = (SELECT bool_or(total) FROM wanted) GROUP BY province, crop, year),
sums AS (
  SELECT province, latest.name AS name, count(DISTINCT crop) AS crops, count(DISTINCT year) AS years,
         sum(latest.area) AS area, sum(latest.output) AS output
  FROM ends GROUP BY province, latest.name)"""
    climate = {out: f"(SELECT avg(k.{col}) FROM clima_provincial k WHERE k.cod_provincia = sums.province "
                    f"AND k.mes BETWEEN 1 AND 12 AND ({_in_period(q, 'k.anio', 'k.mes')}))"
               for out, col in (("temp_media_c", "t_media_c"), ("precip_media_mm", "precip_media_mm"),
                                ("hr_media_pct", "hr_media_pct"))}
    body = f"""
SELECT name AS provincia, province AS cod_provincia, crops AS n_cultivos, years AS n_periodos,
       {R("area", 0)} AS sup_total_ha, {R(yield_sql("output", "area"), 1)} AS rend_kg_ha,
       {", ".join(f"{R(x, 1)} AS {out}" for out, x in climate.items())}
FROM sums"""
    return with_tables(body, ctes)


X1_DEFAULT = P.TerritorialQuery(cultivo="MEDIUM", anio_ini=1996, anio_fin=2000)
X1_CROSS = P.TerritorialQuery(cultivo="STANDARD", anio_ini=1997, anio_fin=1999, mes_ini=3, mes_fin=2)
X1_CROSS_COMPAT = P.TerritorialQuery(cultivo="STANDARD", anio_ini=1997, anio_fin=1999, mes_ini=3,
                                     mes_fin=2, compat_period=True)
X1_TOTAL = P.TerritorialQuery(cultivo="", anio_ini=1995, anio_fin=2001, ccaa="EUROPE")


def _x1(q: P.TerritorialQuery):
    def run(spark, d):
        t = Tables.get(spark, d)
        return P.territorial_yield(t.avances(), t.clima_provincial(), q)
    return run


query("territorial_yield", _x1_sql(X1_DEFAULT))(_x1(X1_DEFAULT))
query("period_cross_year", _x1_sql(X1_CROSS))(_x1(X1_CROSS))
query("period_cross_year_compat", _x1_sql(X1_CROSS_COMPAT))(_x1(X1_CROSS_COMPAT))
query("prefer_total", _x1_sql(X1_TOTAL))(_x1(X1_TOTAL))
