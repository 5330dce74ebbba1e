"""Linear attributions, split determinism, idempotent replacement, round trips."""

import math

import pytest
from pyspark.sql import functions as F

from cosecha.operators import model as M
from cosecha.sources import cells as CE
from cosecha.sources import landing as LD
from cosecha.sources.tables import Tables

from conftest import SF_SMALL


def test_linear_attribution_is_exact(spark):
    rows = [(float(i), float(i % 3), 2.0 * i - 5.0 * (i % 3) + 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    m = M.fit_ols(df, ["x1", "x2"], "y")
    assert math.isclose(m.coef[0], 2.0, abs_tol=1e-9) and math.isclose(m.coef[1], -5.0, abs_tol=1e-9)
    a = M.linear_attribution(df, m).agg(F.sum("shap_x1").alias("s1")).first()
    assert abs(a.s1) < 1e-6   # contributions are centred on the mean


def test_hash_split_deterministic(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    s1 = {r.k: r.split for r in M.hash_split(df, ["k"]).collect()}
    s2 = {r.k: r.split for r in M.hash_split(df, ["k"]).collect()}
    assert s1 == s2
    share = sum(1 for v in s1.values() if v == "train") / len(s1)
    assert 0.65 < share < 0.75


def test_replace_partitions_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    base = spark.createDataFrame([(2023, m, float(m)) for m in range(1, 4)], "anio int, mes int, v double")
    LD.replace_partitions(spark, base, path, ["anio", "mes"])
    delivery = spark.createDataFrame([(2023, 2, 20.0)], "anio int, mes int, v double")
    once = sorted(tuple(r) for r in LD.replace_partitions(spark, delivery, path, ["anio", "mes"])
                  .select("anio", "mes", "v").collect())
    twice = sorted(tuple(r) for r in LD.replace_partitions(spark, delivery, path, ["anio", "mes"])
                   .select("anio", "mes", "v").collect())
    assert once == twice == [(2023, 1, 1.0), (2023, 2, 20.0), (2023, 3, 3.0)]


def test_replace_by_key_unique(spark):
    ex = spark.createDataFrame([("S1", 2020, m, 1.0) for m in range(1, 13)], "indicativo string, anio int, mes int, t double")
    dl = spark.createDataFrame([("S1", 2020, 1, 9.0)], "indicativo string, anio int, mes int, t double")
    out = LD.assert_unique(LD.replace_by_key(ex, dl, ["indicativo", "anio"], ["indicativo", "anio", "mes"]),
                           ["indicativo", "anio", "mes"])
    assert [tuple(r) for r in out.collect()] == [("S1", 2020, 1, 9.0)]
    twice = LD.replace_by_key(ex, dl.unionByName(dl), ["indicativo", "anio"], ["indicativo", "anio", "mes"])
    with pytest.raises(Exception, match="duplicada"):
        twice.select("t").collect()


def test_export_leaves_no_empty_result(spark, tmp_path):
    frames = {"some": spark.range(7), "none": spark.range(0), "filtered": spark.range(7).where("id < 0")}
    got = LD.export_frames(frames, str(tmp_path), {"origen": "x"})
    assert [tuple(r) for r in got.collect()] == [("some", 7)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_info", "some"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/some").count() == 7


def test_spread_starts_no_job(spark):
    from cosecha.session import spread
    small = spark.range(1000).groupBy("id").count()
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    spread(small)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_advance_workbook_round_trip(spark):
    t = Tables(spark, SF_SMALL, materialized=False)
    av = t.avances()
    out, bad = CE.ingest_advances(CE.render_advances(av, last_year_srt=2001))
    assert bad.count() == 0
    want = av.filter(F.col("nivel").isin("provincia", "nacional")).select(
        "periodo_anio", "periodo_mes", "cultivo", "nivel", "cod_provincia", "sup_avance", "prod_avance")
    got = out.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_climate_json_round_trip(spark):
    t = Tables(spark, SF_SMALL, materialized=False)
    cm = t.clima_mensual().select("indicativo", "anio", "mes", "t_media", "precip_mm", "hr_media")
    path = LD.land_climate_json(t.clima_mensual(), t.scratch("test_json"))
    back = LD.read_climate_json(spark, path).select(*cm.columns)
    assert back.exceptAll(cm).count() == 0 and cm.exceptAll(back).count() == 0
