"""Exploration and dashboard queries as DataFrame operators
(A2-A4, A8-A10, A12b, A13, A16, J3-J9, T1-T5, U1, X2, X5-X7, W6, P4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import period_label_month, period_label_week
from .panel import all_of


# ------------------------------------------------------------ summaries
def union_summary(avances: DataFrame, coyuntura: DataFrame) -> DataFrame:
    """Two table summaries stacked with NULL padding."""
    a = avances.agg(F.lit("AVANCES").alias("tabla"), F.count(F.lit(1)).alias("total"),
                    F.count_distinct("cultivo").alias("cultivos"),
                    F.count_distinct("cod_provincia").alias("provincias"),
                    F.count_distinct("ccaa").alias("ccaa"),
                    F.min("periodo_anio").alias("desde"), F.max("periodo_anio").alias("hasta"))
    c = coyuntura.agg(F.lit("COYUNTURA").alias("tabla"), F.count(F.lit(1)).alias("total"),
                      F.count_distinct("producto").alias("cultivos"),
                      F.min("anio").alias("desde"), F.max("anio").alias("hasta"))
    return a.unionByName(c, allowMissingColumns=True)


def count_by(df: DataFrame, keys: list[str], distinct: str | None = None) -> DataFrame:
    """Rows (and optionally distinct values) per group, sorted by count (A4)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct:
        aggs.append(F.count_distinct(distinct).alias(f"n_{distinct}"))
    return df.groupBy(*keys).agg(*aggs).orderBy(F.col("n").desc(), *keys)


def distinct_sorted(df: DataFrame, cols: list[str], where: Column | None = None) -> DataFrame:
    """Sorted distinct values."""
    d = df if where is None else df.filter(where)
    return d.select(*cols).filter(all_of([F.col(c).isNotNull() for c in cols])).distinct().orderBy(*cols)


def string_agg_distinct(df: DataFrame, key: str, value: str, count_col: str, sep: str = ", ") -> DataFrame:
    """STRING_AGG(DISTINCT value ORDER BY value) with a distinct count.

    ``collect_set`` holds one group's distinct values: bounded here by the
    number of provinces of a community.
    """
    return (df.groupBy(key)
            .agg(F.count_distinct(count_col).alias(f"n_{count_col}"),
                 F.array_join(F.array_sort(F.collect_set(value)), sep).alias(f"{value}_lista"))
            .orderBy(key))


def ccaa_rollup(closes: DataFrame) -> DataFrame:
    """Community sums of province rows with the number of provinces."""
    return (closes.groupBy("ccaa", "cultivo", "periodo_anio")
            .agg(F.sum("sup_avance").alias("sup_total"), F.sum("prod_avance").alias("prod_total"),
                 F.count(F.lit(1)).alias("n_prov")))


# ---------------------------------------------------------------- top-k
def topk_producers(avances: DataFrame, pattern: str, anio: int, k: int = 10) -> DataFrame:
    """Top-k provinces by production in the latest month of a year.

    The latest month is an uncorrelated scalar subquery (evaluated once).
    """
    latest = avances.filter(F.col("periodo_anio") == anio).agg(F.max("periodo_mes")).scalar()
    base = avances.filter(F.col("cultivo").contains(pattern) & (F.col("nivel") == "provincia")
                          & (F.col("periodo_anio") == anio) & (F.col("periodo_mes") == latest))
    return (base.groupBy("provincia", "ccaa").agg(F.max("prod_avance").alias("produccion_kt"))
            .orderBy(F.col("produccion_kt").desc_nulls_last(), "provincia").limit(k))


def latest_week_movers(coyuntura: DataFrame, k: int = 10) -> DataFrame:
    """Biggest weekly rises of the latest (year, week).

    The latest week is one ``max(struct(anio, semana))`` aggregate joined back
    as a one-row broadcast, instead of a sort of the whole table.
    """
    last = coyuntura.agg(F.max(F.struct("anio", "semana")).alias("u")).select("u.anio", "u.semana")
    j = coyuntura.join(F.broadcast(last), ["anio", "semana"])
    return (j.filter(F.col("variacion_pct").isNotNull())
            .select("producto", "seccion", "precio_sem_actual", "variacion_pct", "unidad")
            .orderBy(F.col("variacion_pct").desc(), "producto", "seccion").limit(k))


def top_highlight(df: DataFrame, value: str, key: str, k: int = 5) -> DataFrame:
    """nlargest(k) dropping NULLs."""
    return df.filter(F.col(value).isNotNull()).orderBy(F.col(value).desc(), key).limit(k)


# ---------------------------------------------------------------- joins
def provinces_without_climate(avances: DataFrame, clima_mensual: DataFrame) -> DataFrame:
    """Provinces with panel rows but no climate at all (J3): left_anti, not NOT IN."""
    prov = avances.filter((F.col("nivel") == "provincia") & F.col("cod_provincia").isNotNull()) \
        .select("cod_provincia").distinct()
    cov = clima_mensual.filter(F.col("cod_provincia").isNotNull()).select("cod_provincia").distinct()
    return prov.join(cov, "cod_provincia", "left_anti")


def join_month_week(avances: DataFrame, coyuntura: DataFrame, cultivo: str, producto_prefix: str,
                    nivel: str = "nacional", desde: int = 1998) -> DataFrame:
    """Crop × price cross with a computed key and a residual LIKE in ON.

    The equi part (year, week = month·4) still drives a hash / sort-merge join;
    the prefix test is a residual condition, so the left join may multiply rows
    exactly as the reference does.
    """
    a = avances.filter((F.col("cultivo") == cultivo) & (F.col("nivel") == nivel)
                       & (F.col("periodo_anio") >= desde)).alias("a")
    c = coyuntura.select("anio", "semana", "producto", "precio_sem_actual").alias("c")
    cond = ((F.col("c.anio") == F.col("a.periodo_anio")) & (F.col("c.semana") == F.col("a.periodo_mes") * 4)
            & F.col("c.producto").startswith(producto_prefix))
    return (a.join(c, cond, "left")
            .select(F.col("a.periodo_anio"), F.col("a.periodo_mes"), F.col("a.sup_avance").alias("sup_ha"),
                    F.col("a.prod_avance").alias("prod_kt"), F.col("c.precio_sem_actual").alias("precio"))
            .orderBy("periodo_anio", "periodo_mes"))


def dim_lookup_default(df: DataFrame, code_col: str, dim: DataFrame, name_col: str, out: str,
                       order_col: str) -> DataFrame:
    """Attach a name from a de-duplicated dimension, default "Provincia <cod>" (J8).

    The dimension keeps one deterministic name per code (the one of the
    latest ``order_col``, trap Q37).
    """
    d = dim.groupBy(code_col).agg(F.max_by(name_col, order_col).alias("_name"))
    j = df.join(d, code_col, "left")
    return j.withColumn(out, F.coalesce(F.col("_name"), F.concat(F.lit("Provincia "), F.col(code_col).cast("string")))) \
        .drop("_name")


def expand_region(avances: DataFrame, cod: int, year: int) -> DataFrame:
    """Province focus → whole community (X2): the province's community is
    looked up once (first hit by ordered key), then every province of that
    community is returned with an ``es_objetivo`` mark."""
    prov = avances.filter((F.col("nivel") == "provincia") & F.col("ccaa").isNotNull())
    target = (prov.filter(F.col("cod_provincia") == cod)
              .agg(F.min_by("ccaa", F.struct("periodo_anio", "periodo_mes", "cultivo")).alias("ccaa_obj")))
    region = prov.filter(F.col("periodo_anio") == year).join(
        F.broadcast(target), F.col("ccaa") == F.col("ccaa_obj"))
    return (region.groupBy("ccaa", "cod_provincia", "provincia").agg(F.count(F.lit(1)).alias("n_filas"))
            .withColumn("es_objetivo", F.col("cod_provincia") == cod))


# --------------------------------------------------------------- series
def series_query(avances: DataFrame, cultivo: str, nivel: str, metric: str, a0: int, a1: int,
                 ccaa: str | None = None, provincias: list[str] | None = None) -> DataFrame:
    """Evolution series at the chosen level (X5, P3, F4, F6, F9, T4, X-s6).

    ``metric`` is validated against the two measures before it names a
    column; every user value stays a literal, never SQL text.
    """
    if metric not in ("sup_avance", "prod_avance"):
        raise ValueError(f"metric must be sup_avance or prod_avance, not {metric!r}")
    preds = [F.upper("cultivo") == cultivo.upper(), F.col("nivel") == nivel,
             F.col("regimen") == "total", F.col("periodo_anio").between(a0, a1), F.col(metric).isNotNull()]
    zona = F.lit("Espana")
    if nivel == "ccaa":
        preds.append(F.upper("ccaa") == (ccaa or "").upper())
        zona = F.col("ccaa")
    elif nivel == "provincia":
        preds.append(F.col("provincia").isin(*(provincias or [])))
        zona = F.col("provincia")
    return (avances.filter(all_of(preds))
            .select("periodo_anio", "periodo_mes", F.col(metric), zona.alias("zona"),
                    period_label_month("periodo_anio", "periodo_mes").alias("periodo"))
            .orderBy("zona", "periodo_anio", "periodo_mes"))


def price_series(coyuntura: DataFrame, producto: str, a0: int, a1: int) -> DataFrame:
    """One product's weekly prices with labels."""
    return (coyuntura.filter((F.col("producto") == producto) & F.col("anio").between(a0, a1))
            .select("anio", "semana", "producto", "seccion", "unidad", "precio_sem_anterior",
                    "precio_sem_actual", "variacion_pct",
                    period_label_week("anio", "semana").alias("periodo"))
            .orderBy("anio", "semana", "seccion"))


def price_kpis(series: DataFrame, keys: list[str]) -> DataFrame:
    """Last price, last variation, min and max per series."""
    order = F.struct("anio", "semana")
    return series.groupBy(*keys).agg(
        F.max_by("precio_sem_actual", order).alias("ultimo_precio"),
        F.max_by("variacion_pct", order).alias("ultima_variacion"),
        F.min("precio_sem_actual").alias("precio_min"),
        F.max("precio_sem_actual").alias("precio_max"),
        F.count(F.lit(1)).alias("n_semanas"))


def series_column_counts(df: DataFrame, candidates=("provincia", "ccaa", "nivel")) -> DataFrame:
    """Distinct counts of the candidate series columns and the chosen one."""
    present = [c for c in candidates if c in df.columns]
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in present])
    choice = None
    for c in reversed(present):
        choice = F.when(F.col(c) > 1, F.lit(c)) if choice is None else F.when(F.col(c) > 1, F.lit(c)).otherwise(choice)
    return counts.withColumn("columna_serie", choice)


def series_column(df: DataFrame, candidates=("provincia", "ccaa", "nivel")) -> str | None:
    """First candidate column with more than one distinct value.

    One aggregate; only its single row of counts reaches the driver.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.count_distinct(c).alias(c) for c in present]).first()
    for c in present:
        if row[c] > 1:
            return c
    return None


# ---------------------------------------------------------------- dedup
def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row per key under a total order.

    ``min_by`` over a struct is a plain aggregate (partial aggregation before
    the shuffle); ``order`` must be a total order to make the survivor
    deterministic (trap Q14).
    """
    rest = [c for c in df.columns if c != key]
    s = F.struct(*[F.col(c) for c in order])
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), s).alias("_r")
    return df.groupBy(key).agg(picked, F.count(F.lit(1)).alias("n_copias")) \
        .select(key, *[F.col("_r")[c].alias(c) for c in rest], "n_copias")


def unmatched_count(df: DataFrame, col: str) -> DataFrame:
    """Rows whose joined value is NULL."""
    return df.agg(F.count_if(F.col(col).isNull()).alias("sin_dato"), F.count(F.lit(1)).alias("total"))
