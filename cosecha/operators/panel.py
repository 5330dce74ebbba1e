"""Crop-advance panel operators: filters (F1-F10), season close (W1),
prefer-total (W2), weighted yield (A7), the territorial yield query (X1),
region expansion (X2), evolution series (X5) and the cumulative check (X14).

Advance measures are cumulative within the year (every month repeats the
estimate to date), so a year's figure is the close-of-season row: the highest
month per (province, crop, year).  Sums over months are never taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, safe_div, yield_kg_ha
from ..functions.text import like_contains_ci

# Crop names matching these are redundant aggregates or control
# variants and are left out of the territorial query.
EXCLUDED_CROP_PATTERNS = ("POR VARIEDADES", "POR TIPOS", "POR ÉPOCAS", "POR EPOCAS",
                          "RESUMEN GENERAL")
EXCLUDED_CROP_MARK = "(*)"


def all_of(preds: list[Column]) -> Column:
    """Fold a list of predicates with AND (the dynamic WHERE builder, F9)."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def month_index(anio: Column, mes: Column) -> Column:
    return anio * 12 + mes


def period_filter(anio: str, mes: str, a0: int, a1: int, m0: int, m1: int,
                  compat: bool = False) -> Column:
    """Period predicate.

    Without a year crossing: year BETWEEN and month BETWEEN.  With a crossing
    (m0 > m1 and a0 < a1) the corrected form keeps the continuous month range
    (a0, m0) .. (a1, m1); ``compat=True`` reproduces the reference, which only
    keeps the first and the last year.
    """
    y, m = F.col(anio), F.col(mes)
    if m0 > m1 and a0 < a1:
        if compat:
            return ((y == a0) & (m >= m0)) | ((y == a1) & (m <= m1))
        return month_index(y, m).between(a0 * 12 + m0, a1 * 12 + m1)
    return y.between(a0, a1) & m.between(m0, m1)


def crop_family_filter(cultivo: Column, pattern: str, fold: bool = True) -> Column:
    """Case-insensitive contains + the fixed exclusion patterns.

    ``fold=True`` compares accent-folded forms on both sides, so a question's
    "MAIZ" finds a stored "MAÍZ" (trap Q8); ``fold=False`` is the plain
    upper-case comparison of the reference.
    """
    c = F.upper(cultivo)
    if fold:
        from ..functions.text import fold_accents
        preds = [fold_accents(cultivo).contains(_fold_py(pattern))]
    else:
        preds = [like_contains_ci(cultivo, pattern)]
    preds += [~c.contains(p) for p in EXCLUDED_CROP_PATTERNS]
    preds.append(~cultivo.contains(EXCLUDED_CROP_MARK))
    return all_of(preds)


def _fold_py(text: str) -> str:
    """Python twin of ``fold_accents`` for literal patterns."""
    from ..functions.text import ACCENTED, FOLDED
    return text.translate(str.maketrans(ACCENTED, FOLDED)).lower()


def prefer_total(df: DataFrame, flag: str = "es_total") -> DataFrame:
    """Keep only TOTAL rows if any row of the set is a TOTAL (W2, global).

    The global flag is one scalar aggregate (a scalar subquery executed once),
    not an un-partitioned window that would pull every row into one task.
    """
    any_total = df.agg(F.coalesce(F.max(flag), F.lit(0)).alias("hay_total")).scalar()
    return df.filter((F.col(flag) == 1) | (any_total == 0))


def close_of_season(df: DataFrame, keys=("cod_provincia", "cultivo", "periodo_anio"),
                    order: str = "periodo_mes") -> DataFrame:
    """One row per key: the row of the highest month.

    ``max_by`` over a struct is an ordinary aggregate, so Spark combines it
    map-side before the shuffle, unlike ``row_number`` which needs a full sort
    of every row of the partition.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


@dataclass
class TerritorialQuery:
    """Parameters of the territorial yield map query."""
    cultivo: str = "MEDIUM"
    anio_ini: int = 1996
    anio_fin: int = 2000
    mes_ini: int = 1
    mes_fin: int = 12
    ccaa: str | None = None
    compat_period: bool = False
    extra: dict = field(default_factory=dict)


def territorial_yield(avances: DataFrame, clima_prov: DataFrame, q: TerritorialQuery) -> DataFrame:
    """Yield per province at the close of season, with climate averages.

    filter → prefer TOTAL → close of season → ratio of sums → left join of the
    pre-aggregated climate → sort.  Climate is aggregated per province before
    the join, so the join cannot multiply rows.
    """
    a = avances
    preds = [crop_family_filter(F.col("cultivo"), q.cultivo),
             F.col("nivel") == "provincia",
             F.col("cod_provincia").isNotNull(),
             F.col("sup_avance") > 0,
             F.col("prod_avance").isNotNull(),
             period_filter("periodo_anio", "periodo_mes", q.anio_ini, q.anio_fin,
                           q.mes_ini, q.mes_fin, q.compat_period)]
    if q.ccaa:
        preds.append(F.upper(F.col("ccaa")).contains(q.ccaa.upper()))
    filtrado = a.filter(all_of(preds)).select(
        "provincia", "cod_provincia", "cultivo", "periodo_anio", "periodo_mes",
        "sup_avance", "prod_avance",
        F.when(F.upper("cultivo").contains("TOTAL"), 1).otherwise(0).alias("es_total"))
    cierre = close_of_season(prefer_total(filtrado))
    clima = (clima_prov
             .filter(period_filter("anio", "mes", q.anio_ini, q.anio_fin, q.mes_ini, q.mes_fin,
                                   q.compat_period) & F.col("mes").between(1, 12))
             .groupBy("cod_provincia")
             .agg(F.avg("t_media_c").alias("temp_media_c"),
                  F.avg("precip_media_mm").alias("precip_media_mm"),
                  F.avg("hr_media_pct").alias("hr_media_pct")))
    agg = (cierre.groupBy("provincia", "cod_provincia")
           .agg(F.count_distinct("cultivo").alias("n_cultivos"),
                F.count_distinct("periodo_anio").alias("n_periodos"),
                F.sum("sup_avance").alias("_sup"), F.sum("prod_avance").alias("_prod")))
    out = agg.join(clima, "cod_provincia", "left").select(
        "provincia", "cod_provincia", "n_cultivos", "n_periodos",
        round_half_up("_sup", 0).alias("sup_total_ha"),
        round_half_up(yield_kg_ha("_prod", "_sup"), 1).alias("rend_kg_ha"),
        round_half_up("temp_media_c", 1).alias("temp_media_c"),
        round_half_up("precip_media_mm", 1).alias("precip_media_mm"),
        round_half_up("hr_media_pct", 1).alias("hr_media_pct"))
    return out.orderBy(F.col("rend_kg_ha").desc_nulls_last(), "cod_provincia")


def weighted_yield(closes: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted yield: SUM(prod)/NULLIF(SUM(sup),0)*1e6."""
    return (closes.groupBy(*keys)
            .agg(F.sum("sup_avance").alias("sup_total"), F.sum("prod_avance").alias("prod_total"))
            .select(*keys, round_half_up("sup_total", 1).alias("sup_total"),
                    round_half_up("prod_total", 4).alias("prod_total"),
                    round_half_up(yield_kg_ha("prod_total", "sup_total"), 1).alias("rend_kg_ha")))


def season_closes(avances: DataFrame, nivel: str = "provincia") -> DataFrame:
    """Close-of-season rows of valid province panel rows."""
    base = avances.filter((F.col("nivel") == nivel) & (F.col("regimen") == "total")
                          & (F.col("sup_avance") > 0) & F.col("prod_avance").isNotNull())
    return close_of_season(base.select("cod_provincia", "provincia", "ccaa", "cultivo",
                                       "periodo_anio", "periodo_mes", "sup_avance", "prod_avance"))


def cumulative_overcount(avances: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Guardrail (X14): how much summing every month would overstate the year.

    Per (province, crop, year): sum over all months vs. the close value; a
    ratio above ``threshold`` means a sum over months would double count.
    """
    base = avances.filter((F.col("nivel") == "provincia") & F.col("sup_avance").isNotNull()
                          & (F.col("sup_avance") > 0))
    g = (base.groupBy("cod_provincia", "cultivo", "periodo_anio")
         .agg(F.sum("sup_avance").alias("sup_sum_meses"),
              F.max_by("sup_avance", "periodo_mes").alias("sup_cierre"),
              F.count(F.lit(1)).alias("n_meses")))
    ratio = round_half_up(safe_div("sup_sum_meses", "sup_cierre"), 6)
    return g.select("cod_provincia", "cultivo", "periodo_anio", "n_meses",
                    "sup_sum_meses", "sup_cierre", ratio.alias("ratio"),
                    (ratio > threshold).alias("sobreconteo"))
