"""Many requests at once over the panel: anomalies (X3) and region maps.

A request names crops, provinces or communities by a part of their name.  Such
parts are resolved against the distinct names of the panel, never against its
facts: every name is listed with all its substrings, so "contains" is an
equi-join of requests and names.  Facts are then met by equality on whole
names, and each request is a grouping key, so any number of requests costs one
pass over the facts they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, safe_div, yield_kg_ha
from ..functions.text import community_keyword, fold_accents
from .outliers import detect_anomalies
from .panel import EXCLUDED_CROP_MARK, EXCLUDED_CROP_PATTERNS, month_index


def substrings(text: Column) -> Column:
    """Every distinct substring of a name, the empty one included."""
    n = F.length(text)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda a: F.transform(
        F.sequence(F.lit(1), F.greatest(n - a + 1, F.lit(1))), lambda k: F.substring(text, a, k))))
    return F.array_distinct(F.concat(parts, F.array(F.lit(""))))


def containing(requests: DataFrame, part: str, names: DataFrame, name: str, shape) -> DataFrame:
    """``requests`` with each of the distinct ``names`` whose shaped form contains the request's shaped ``part``.

    ``shape`` is applied to both sides (upper case, folded accents); an empty
    or NULL part is in every name.
    """
    listed = names.select(name).where(F.col(name).isNotNull()).distinct().select(
        F.col(name), F.explode(substrings(shape(F.col(name)))).alias("_part"))
    asked = requests.withColumn("_part", F.coalesce(shape(F.col(part)), F.lit("")))
    return asked.join(listed, "_part").drop("_part")


# --------------------------------------------------------------- anomalies
def anomaly_requests(avances: DataFrame, requests: DataFrame) -> DataFrame:
    """The anomalies of many requests.

    ``requests`` has req_id, cultivo, provincia (parts of names, may be
    empty), anio_ini, anio_fin and metodo.  For each request, crop and
    province with at least five yields: the flagged rows, with z, the group's
    mean and standard deviation and the number of rows of the request.
    """
    names = avances.where("nivel = 'provincia' and regimen = 'total'").select("cultivo", "provincia").distinct()
    asked = requests.select("req_id", F.col("cultivo").alias("_c"), F.col("provincia").alias("_p"),
                            F.col("anio_ini").alias("_a0"), F.col("anio_fin").alias("_a1"), "metodo")
    asked = containing(asked, "_c", names, "cultivo", F.upper)
    asked = containing(asked, "_p", names, "provincia", F.lower).drop("_c", "_p")
    facts = avances.where("nivel = 'provincia' and regimen = 'total' and sup_avance > 0 and prod_avance is not null")
    rows = (facts.join(asked, ["cultivo", "provincia"])
            .where(F.col("periodo_anio").between(F.col("_a0"), F.col("_a1")))
            .select("req_id", "metodo", "cultivo", "provincia", F.col("periodo_anio").alias("anio"),
                    F.col("periodo_mes").alias("mes"),
                    round_half_up(safe_div("prod_avance", "sup_avance"), 6).alias("rendimiento")))
    found = detect_anomalies(rows, "rendimiento", ["req_id", "cultivo", "provincia"], F.col("metodo"))
    size = rows.groupBy(F.col("req_id").alias("_r")).agg(F.count(F.lit(1)).alias("n_filas"))
    return found.join(size, F.col("req_id").eqNullSafe(F.col("_r"))).select(
        "req_id", "metodo", "cultivo", "provincia", "anio", "mes", "rendimiento", "z",
        round_half_up("media", 4).alias("media"), round_half_up("std", 4).alias("std"), "tipo", "n_filas")


# -------------------------------------------------------------- region maps
def _period(anio: str, mes: str) -> Column:
    """A row's period is in its request's; a range over the turn of a year is continuous."""
    y, m = F.col(anio), F.col(mes)
    a0, a1, m0, m1 = (F.col(c) for c in ("_a0", "_a1", "_m0", "_m1"))
    return F.when((m0 > m1) & (a0 < a1), month_index(y, m).between(month_index(a0, m0), month_index(a1, m1))) \
        .otherwise(y.between(a0, a1) & m.between(m0, m1))


def region_requests(avances: DataFrame, clima_prov: DataFrame, requests: DataFrame) -> DataFrame:
    """The territorial yield map (X1) of each request's whole region.

    ``requests`` has req_id, cultivo (part of a name, accents folded),
    anio_ini, anio_fin, mes_ini, mes_fin, ccaa and cod_provincia.  Without a
    community that of the province is taken (its first by period and crop);
    its keyword finds all spellings of the community.  Without either the map
    is of the whole country.  ``es_objetivo`` marks the named province.
    """
    prov = avances.where("nivel = 'provincia' and cod_provincia is not null")
    home = (prov.where("ccaa is not null").groupBy(F.col("cod_provincia").alias("_cod"))
            .agg(F.min_by("ccaa", F.struct("periodo_anio", "periodo_mes", "cultivo")).alias("_home")))
    asked = requests.select("req_id", F.col("cultivo").alias("_crop"), F.col("anio_ini").alias("_a0"),
                            F.col("anio_fin").alias("_a1"), F.col("mes_ini").alias("_m0"), F.col("mes_fin").alias("_m1"),
                            F.col("ccaa").alias("_ccaa"), F.col("cod_provincia").alias("_target"))
    asked = asked.join(home, F.col("_target") == F.col("_cod"), "left").withColumn(
        "_key", community_keyword(F.coalesce(F.nullif("_ccaa", F.lit("")), F.col("_home")))).drop("_cod", "_ccaa", "_home")
    c = F.upper("cultivo")
    crops = prov.select("cultivo").distinct()
    for p in EXCLUDED_CROP_PATTERNS:
        crops = crops.where(~c.contains(p))
    crops = crops.where(~F.col("cultivo").contains(EXCLUDED_CROP_MARK))
    asked = containing(asked, "_crop", crops, "cultivo", fold_accents)
    # A province row without a community belongs to a map of the whole country only.
    regions = prov.select(F.coalesce("ccaa", F.lit("")).alias("_region")).distinct()
    asked = containing(asked, "_key", regions, "_region", F.upper)
    facts = prov.where("sup_avance > 0 and prod_avance is not null").withColumn("_region", F.coalesce("ccaa", F.lit("")))
    rows = (facts.join(asked, ["cultivo", "_region"]).where(_period("periodo_anio", "periodo_mes"))
            .withColumn("_total", F.upper("cultivo").contains("TOTAL")))
    # TOTAL rows alone where a request has any; then the close of season.
    totals = rows.groupBy(F.col("req_id").alias("_r")).agg(F.max("_total").alias("_any"))
    rows = rows.join(totals, F.col("req_id").eqNullSafe(F.col("_r"))).where(F.col("_total") == F.col("_any"))
    close = rows.groupBy("req_id", "_target", "cod_provincia", "cultivo", "periodo_anio").agg(
        F.max_by(F.struct("provincia", "sup_avance", "prod_avance"), "periodo_mes").alias("x"))
    area = close.groupBy("req_id", "_target", "cod_provincia", F.col("x.provincia").alias("provincia")).agg(
        F.count_distinct("cultivo").alias("n_cultivos"), F.count_distinct("periodo_anio").alias("n_periodos"),
        F.sum("x.sup_avance").alias("_sup"), F.sum("x.prod_avance").alias("_prod"))
    wanted = close.select("req_id", "cod_provincia").distinct().join(
        requests.select("req_id", F.col("anio_ini").alias("_a0"), F.col("anio_fin").alias("_a1"),
                        F.col("mes_ini").alias("_m0"), F.col("mes_fin").alias("_m1")), "req_id")
    clima = (wanted.join(clima_prov, "cod_provincia").where(_period("anio", "mes") & F.col("mes").between(1, 12))
             .groupBy("req_id", "cod_provincia").agg(*[F.avg(x).alias(y) for x, y in (
                 ("t_media_c", "temp_media_c"), ("precip_media_mm", "precip_media_mm"), ("hr_media_pct", "hr_media_pct"))]))
    return area.join(clima, ["req_id", "cod_provincia"], "left").select(
        "req_id", "provincia", "cod_provincia", "n_cultivos", "n_periodos",
        round_half_up("_sup", 0).alias("sup_total_ha"), round_half_up(yield_kg_ha("_prod", "_sup"), 1).alias("rend_kg_ha"),
        *[round_half_up(x, 1).alias(x) for x in ("temp_media_c", "precip_media_mm", "hr_media_pct")],
        F.coalesce(F.col("cod_provincia") == F.col("_target"), F.lit(False)).alias("es_objetivo"))
