"""Many anomaly and region requests at once give what each gives alone; broken sheets cost only themselves."""

import uuid

import pytest
from pyspark.sql import functions as F

from cosecha.functions.numeric import round_half_up, safe_div
from cosecha.operators import panel as P
from cosecha.operators import requests as RQ
from cosecha.operators.outliers import detect_anomalies
from cosecha.session import scratch_path
from cosecha.sources import cells as CE
from cosecha.sources import landing as LD
from cosecha.sources.tables import Tables

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return Tables.get(spark, SF_SMALL)


def test_containing_is_contains(spark):
    names = spark.createDataFrame([("TRIGO BLANDO",), ("MAÍZ",), ("",), (None,), ("TRIGO",), ("TRIGO",)], "n string")
    asked = spark.createDataFrame([(1, "trigo"), (2, "IGO B"), (3, ""), (4, None), (5, "xx"), (6, "aí")], "i int, p string")
    got = {(r.i, r.n) for r in RQ.containing(asked, "p", names, "n", F.upper).collect()}
    listed = ["TRIGO BLANDO", "MAÍZ", "", "TRIGO"]
    assert got == {(i, n) for i, p in [(1, "TRIGO"), (2, "IGO B"), (3, ""), (4, ""), (5, "XX"), (6, "AÍ")]
                   for n in listed if p in n}


def test_anomaly_requests_equal_each_alone(spark, tables):
    a = tables.avances()
    asked = [(1, "econ", "", 1995, 2001, "ambos"), (2, "ECONOMY", "nation_1", 1996, 2000, "zscore"),
             (3, "", "NATION_3", 1995, 2001, "iqr"), (4, "no such crop", "", 1995, 2001, "ambos"),
             (5, "", "", 1900, 1901, "ambos"), (6, "o", "1", 1994, 2003, "iqr")]
    req = spark.createDataFrame(asked, "req_id int, cultivo string, provincia string, anio_ini int, anio_fin int, metodo string")
    found = RQ.anomaly_requests(a, req)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.req_id, r.cultivo, r.provincia, r.anio, r.mes, r.z, r.tipo, r.n_filas) for r in found.collect())
    want = []
    for i, crop, prov, a0, a1, method in asked:
        rows = a.where((F.col("nivel") == "provincia") & (F.col("regimen") == "total") & (F.col("sup_avance") > 0)
                       & F.col("prod_avance").isNotNull() & F.col("periodo_anio").between(a0, a1)
                       & F.upper("cultivo").contains(crop.upper()) & F.lower("provincia").contains(prov.lower())).select(
            "cultivo", "provincia", F.col("periodo_anio").alias("anio"), F.col("periodo_mes").alias("mes"),
            round_half_up(safe_div("prod_avance", "sup_avance"), 6).alias("y"))
        n = rows.count()
        want += [(i, r.cultivo, r.provincia, r.anio, r.mes, r.z, r.tipo, n)
                 for r in detect_anomalies(rows, "y", ["cultivo", "provincia"], method).collect()]
    assert got == sorted(want) and {1, 3} <= {r[0] for r in got} and not {4, 5} & {r[0] for r in got}


def test_region_requests_equal_each_alone(spark, tables):
    a, c = tables.avances(), tables.clima_provincial()
    home = {r.cod_provincia: r.ccaa for r in a.where("nivel = 'provincia'").select("cod_provincia", "ccaa").distinct().collect()}
    asked = [(1, "medium", 1996, 2000, 1, 12, None, 7), (2, "STANDARD", 1997, 1999, 3, 2, "EUROPE", None),
             (3, "", 1995, 2001, 1, 12, "", None), (4, "total", 1996, 1998, 2, 6, None, 3), (5, "zzz", 1996, 1998, 1, 12, None, 3)]
    req = spark.createDataFrame(asked, "req_id int, cultivo string, anio_ini int, anio_fin int, mes_ini int, mes_fin int, "
                                       "ccaa string, cod_provincia int")
    found = RQ.region_requests(a, c, req)
    got = {}
    for r in found.collect():
        row = r.asDict()
        got.setdefault(row.pop("req_id"), {})[row.pop("cod_provincia")] = row
    for i, crop, a0, a1, m0, m1, ccaa, cod in asked:
        region = (ccaa or home.get(cod) or None)
        q = P.TerritorialQuery(crop, a0, a1, m0, m1, ccaa=region.split()[0] if region else None)
        want = {}
        for r in P.territorial_yield(a, c, q).collect():
            row = r.asDict() | {"es_objetivo": r.cod_provincia == cod}
            want[row.pop("cod_provincia")] = row
        assert got.get(i, {}) == want, i
    assert len(got[1]) > 1 and got[1][7]["es_objetivo"] and 5 not in got and len(got[3]) > len(got[1])


def test_a_broken_sheet_costs_only_itself(spark):
    def sheet(file, name, cells):
        return [(file, name, r, c, v) for (r, c), v in cells.items()]

    head = {(1, 0): "TRIGO", (5, 2): "2021", (5, 3): "2022", (5, 4): "2023", (6, 4): "5"}
    row = {(8, 0): "09 BURGOS", (8, 2): "1", (8, 4): "3", (8, 9): "7", (8, 10): "99"}
    book = "cuaderno_mayo2023.xls"
    cells = sheet(book, "bien", head | row) + sheet(book, "sin filas", {(1, 0): "X", (4, 9): "x"})
    cells += sheet(book, "sin columnas", head | {(8, 0): "09 BURGOS", (8, 2): "1"}) + sheet(book, "sin datos", head)
    cells += sheet(book, "portada", {(0, 0): "x"}) + sheet("cuaderno_foo2023.xls", "bien", head | row)
    cells += sheet("cuaderno_mayo2024.xlsm", "M-SRT", {(1, 0): "MAÍZ S/R/T", (5, 3): "2024", (8, 0): "TOTAL ESPAÑA", (8, 1): "4"})
    cells += sheet("cuaderno_mayo2024.xlsm", "corta-SRT", {(1, 0): "X", (5, 2): "1"})
    df = spark.createDataFrame(cells, CE.CELL_SCHEMA)
    store, summary = LD.write_isolated(CE.ingest_isolated(df), scratch_path(spark, "isolated", uuid.uuid4().hex[:8]))
    assert summary.first().asDict() == {"archivos_ok": 2, "archivos_error": 1, "hojas_ok": 3, "hojas_error": 3, "registros": 2}
    bad = {(r.sheet, r.motivo) for r in store.where("tipo = 'hoja' and motivo is not null").collect()}
    assert bad == {("sin filas", "sin_cabecera"), ("sin columnas", "faltan_columnas"), ("corta-SRT", "sin_cabecera")}
    got = sorted((r.cultivo, r.regimen, r.sup_definitivo, r.sup_avance, r.prod_avance, r.prod_indice)
                 for r in store.where("tipo = 'registro'").collect())
    assert got == [("MAÍZ", "secano", 4.0, None, None, None), ("TRIGO", "total", 1.0, 3.0, 7.0, 99.0)]
    none = CE.ingest_isolated(df.limit(0))
    _, empty = LD.write_isolated(none, scratch_path(spark, "isolated", uuid.uuid4().hex[:8]))
    assert sum(empty.first()) == 0


def test_title_case():
    import pyspark.sql
    from cosecha.functions.text import title_case
    spark = pyspark.sql.SparkSession.active()
    words = ["santa cruz DE tenerife", "ARABA/ÁLAVA", "castellón-de la plana", "o'neil", "a1b", "", "ñandú ÉL"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    assert [r[0] for r in df.select(title_case("w")).collect()] == [w.title() for w in words] + [None]
