"""DuckDB twins of the batch pipeline (validated panel, climate, datasets)."""

from __future__ import annotations

from ..operators.climate import PHYSICAL_LIMITS
from . import datasets as DS
from .oracle import R


def av_valid_cte(k: float = 3.0) -> str:
    return f"""
_avn AS (
  SELECT * EXCLUDE (sup_avance, prod_avance),
         CASE WHEN sup_avance < 0 THEN NULL ELSE sup_avance END AS sup_avance,
         CASE WHEN prod_avance < 0 THEN NULL ELSE prod_avance END AS prod_avance
  FROM avances),
_iqr AS (
  SELECT cultivo, quantile_cont(sup_avance, 0.25) AS q1, quantile_cont(sup_avance, 0.75) AS q3
  FROM _avn WHERE nivel = 'nacional' AND regimen = 'total' AND sup_avance IS NOT NULL
  GROUP BY cultivo),
av_valid AS (
  SELECT a.*, COALESCE(a.nivel = 'nacional' AND a.regimen = 'total' AND a.sup_avance IS NOT NULL
           AND (a.sup_avance < i.q1 - {k} * (i.q3 - i.q1) OR a.sup_avance > i.q3 + {k} * (i.q3 - i.q1)),
           false) AS outlier_flag
  FROM _avn a LEFT JOIN _iqr i ON a.cultivo = i.cultivo)"""


def _limits_select(src: str) -> str:
    cols = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}"
                     for c, (lo, hi) in PHYSICAL_LIMITS.items())
    return f"SELECT indicativo, anio, mes, cod_provincia, {cols} FROM {src}"


def climate_ctes() -> str:
    """cl_lim (limits), cl_imp (limits + median fill), cp_v1 / cp_v2 rollups."""
    meds = ", ".join(f"median({c}) AS m_{c}" for c in DS.CLIMATE_IMPUTE)
    fills = ", ".join(
        (f"COALESCE(l.{c}, CASE WHEN l.cod_provincia IS NOT NULL THEN m.m_{c} END) AS {c}"
         if c in DS.CLIMATE_IMPUTE else f"l.{c}") for c in PHYSICAL_LIMITS)

    def rollup(name, src):
        return f"""
{name} AS (
  SELECT cod_provincia, anio, mes,
         {R("AVG(t_media)", 1)} AS t_media_c, {R("MAX(t_max_abs)", 1)} AS t_max_abs_c,
         {R("MIN(t_min_abs)", 1)} AS t_min_abs_c, {R("AVG(precip_mm)", 1)} AS precip_media_mm,
         {R("AVG(horas_sol)", 1)} AS horas_sol_med, {R("AVG(hr_media)", 1)} AS hr_media_pct,
         COUNT(*) AS n_estaciones
  FROM {src} WHERE cod_provincia IS NOT NULL GROUP BY cod_provincia, anio, mes)"""
    return f"""
cl_lim AS ({_limits_select('clima_mensual')}),
_cl_med AS (SELECT cod_provincia, mes, {meds} FROM cl_lim WHERE cod_provincia IS NOT NULL
            GROUP BY cod_provincia, mes),
cl_imp AS (SELECT l.indicativo, l.anio, l.mes, l.cod_provincia, {fills}
           FROM cl_lim l LEFT JOIN _cl_med m ON l.cod_provincia = m.cod_provincia AND l.mes = m.mes),
{rollup('cp_v1', 'cl_lim')},
{rollup('cp_v2', 'cl_imp')}"""


def encode_ctes(src: str, prefix: str) -> str:
    parts = []
    for c in DS.ENCODED:
        parts.append(f"""
{prefix}_{c} AS (
  SELECT clase, row_number() OVER (ORDER BY clase) - 1 AS codigo
  FROM (SELECT DISTINCT COALESCE({c}, 'DESCONOCIDO') AS clase FROM {src}))""")
    return ",".join(parts)


def encode_joins(src_alias: str, prefix: str) -> str:
    return " ".join(f"LEFT JOIN {prefix}_{c} ON COALESCE({src_alias}.{c}, 'DESCONOCIDO') = {prefix}_{c}.clase"
                    for c in DS.ENCODED)


def v1_ctes() -> str:
    return f"""{av_valid_cte()},{climate_ctes()},
_v1 AS (
  SELECT a.cod_provincia, a.provincia, a.ccaa, a.cultivo, a.periodo_anio AS anio, a.periodo_mes AS mes,
         CASE WHEN a.sup_avance > 0 AND a.prod_avance IS NOT NULL
              THEN {R("a.prod_avance / NULLIF(a.sup_avance, 0)", 6)} END AS rendimiento,
         cp.t_media_c, cp.precip_media_mm, cp.horas_sol_med, cp.hr_media_pct, cp.t_max_abs_c, cp.t_min_abs_c
  FROM av_valid a LEFT JOIN cp_v1 cp
    ON a.cod_provincia = cp.cod_provincia AND a.periodo_anio = cp.anio AND a.periodo_mes = cp.mes
  WHERE a.nivel = 'provincia' AND a.regimen = 'total' AND a.sup_avance > 0 AND NOT a.outlier_flag),
_v1r AS (SELECT * FROM _v1 WHERE rendimiento IS NOT NULL),{encode_ctes('_v1r', '_e1')},
v1 AS (
  SELECT _e1_cultivo.codigo AS cultivo_enc, _e1_provincia.codigo AS provincia_enc, _e1_ccaa.codigo AS ccaa_enc,
         anio, mes, t_media_c, precip_media_mm, horas_sol_med, hr_media_pct, t_max_abs_c, t_min_abs_c,
         rendimiento, cultivo, provincia, ccaa, cod_provincia
  FROM _v1r d {encode_joins('d', '_e1')})"""


def v2_ctes(p: DS.DatasetParams = DS.DatasetParams()) -> str:
    return f"""{av_valid_cte(p.iqr_k)},{climate_ctes()},
_v2a AS (
  SELECT a.cod_provincia, a.provincia, a.ccaa, a.cultivo, a.periodo_anio AS anio, a.periodo_mes AS mes,
         a.sup_avance, a.prod_avance,
         {R("a.prod_avance / NULLIF(a.sup_avance, 0)", 6)} AS rendimiento,
         cp.t_media_c, cp.precip_media_mm, cp.hr_media_pct, cp.cod_provincia IS NULL AS sin_clima
  FROM av_valid a LEFT JOIN cp_v2 cp
    ON a.cod_provincia = cp.cod_provincia AND a.periodo_anio = cp.anio AND a.periodo_mes = cp.mes
  WHERE a.nivel = 'provincia' AND a.regimen = 'total' AND a.sup_avance > 0 AND a.prod_avance IS NOT NULL
    AND NOT a.outlier_flag AND a.periodo_anio BETWEEN {p.anio_ini} AND {p.anio_fin}),
_v2b AS (SELECT * FROM _v2a WHERE rendimiento IS NOT NULL AND rendimiento > 0),
_v2cap AS (SELECT cultivo, {R(f"quantile_cont(rendimiento, {p.winsor_p})", 6)} AS cap
           FROM _v2b GROUP BY cultivo),
_v2w AS (
  SELECT b.* EXCLUDE (rendimiento), b.rendimiento AS rendimiento_raw,
         CASE WHEN c.cap IS NULL THEN b.rendimiento ELSE least(b.rendimiento, c.cap) END AS rendimiento
  FROM _v2b b LEFT JOIN _v2cap c ON b.cultivo = c.cultivo),{encode_ctes('_v2w', '_e2')},
v2 AS (
  SELECT _e2_cultivo.codigo AS cultivo_enc, _e2_provincia.codigo AS provincia_enc, _e2_ccaa.codigo AS ccaa_enc,
         anio, mes, t_media_c, precip_media_mm, hr_media_pct, rendimiento,
         cultivo, provincia, ccaa, cod_provincia, rendimiento_raw, sin_clima, sup_avance, prod_avance
  FROM _v2w d {encode_joins('d', '_e2')})"""


def v3_ctes() -> str:
    cols = DS.CLIMATE_FEATURES
    out = v2_ctes()
    src = "v2"
    for i, g in enumerate([["provincia_enc", "mes"], ["ccaa_enc", "mes"], ["mes"]], start=1):
        keys = ", ".join(g)
        meds = ", ".join(f"median({c}) AS m_{c}" for c in cols)
        on = " AND ".join(f"s.{k} = m.{k}" for k in g)
        fills = ", ".join(f"COALESCE(s.{c}, m.m_{c}) AS {c}" for c in cols)
        out += f""",
_h{i}m AS (SELECT {keys}, {meds} FROM {src} GROUP BY {keys}),
_h{i} AS (SELECT s.* EXCLUDE ({', '.join(cols)}), {fills} FROM {src} s LEFT JOIN _h{i}m m ON {on})"""
        src = f"_h{i}"
    return out + f""",
v3 AS (SELECT {', '.join(DS.FEATURES + [DS.TARGET] + DS.META)} FROM {src})"""
