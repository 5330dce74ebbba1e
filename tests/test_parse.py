"""Parsers against the reference's Python semantics (inline fixtures + properties)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cosecha.dims import months_df
from cosecha.functions import parse as PZ


def py_float_ref(v):
    if v is None:
        return None
    try:
        return float(str(v))
    except (ValueError, TypeError):
        return None


def eu_ref(v):
    if v is None:
        return None
    s = str(v).strip()
    if s in ("-", "—", "–", ""):
        return None
    try:
        return float(s.replace(",", "."))
    except ValueError:
        return None


def climate_ref(v):
    if v is None or str(v).strip() in ("", "Ip", "Varias", "Acum"):
        return None
    try:
        return float(str(v).strip().replace(",", "."))
    except ValueError:
        return None


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


CASES = ["12.5", " 12.5 ", "1_000", "1d", "1e3", "-4", "+.5", "5.", "", "abc", "1,5", "1.234,5", "-", "—",
         "–", "Ip", "Varias", "Acum", "12,3", "0x10", "1__0", None, "3 4"]


def test_py_float_matches_python(spark):
    assert _eval(spark, CASES, PZ.py_float) == [py_float_ref(v) for v in CASES]


def test_float_eu_matches_reference(spark):
    assert _eval(spark, CASES, PZ.float_eu) == [eu_ref(v) for v in CASES]


def test_float_climate_matches_reference(spark):
    assert _eval(spark, CASES, PZ.float_climate) == [climate_ref(v) for v in CASES]


def test_py_int_truncates(spark):
    vals = ["2.7", "-2.7", "10", "x"]
    assert _eval(spark, vals, PZ.py_int) == [2, -2, 10, None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,_-+eE d", min_size=0, max_size=8), min_size=1, max_size=30))
def test_py_float_property(spark, values):
    got = _eval(spark, values, PZ.py_float)
    want = [py_float_ref(v) for v in values]
    assert got == want


def test_classify_row_fixture(spark):
    cells = ["41 Sevilla", "28 Madrid", "51 Ceuta", "CASTILLA Y LEÓN", "TOTAL ESPAÑA", "SUMA PROVINCIAS",
             "(1) nota", "* nota", "", None, "texto"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cells)], "i int, v string")
    rows = df.orderBy("i").select(PZ.classify_row("v").alias("r")).select("r.*").collect()
    got = [(r.tipo, r.cod, r.nombre) for r in rows]
    assert got[0] == ("provincia", 41, "Sevilla")
    assert got[1] == ("uniprov", 28, "Madrid")
    assert got[2] == ("provincia", 51, "Ceuta")
    assert got[3] == ("ccaa", None, "CASTILLA Y LEÓN")
    assert got[4] == ("total", None, "ESPAÑA")
    assert [g[0] for g in got[5:]] == ["skip"] * 6


def test_parse_period(spark):
    names = ["data/cuaderno_abril2025.xls", "cuaderno_abril_2025.xls", "cuaderno_foo2025.xls", "CUADERNO_MAYO2024.xlsx"]
    df = spark.createDataFrame([(n,) for n in names], "archivo string")
    out = {r.archivo: (r.mes, r.anio, r.error) for r in PZ.parse_period(df, "archivo", months_df(spark)).collect()}
    assert out["data/cuaderno_abril2025.xls"] == (4, 2025, None)
    assert out["cuaderno_abril_2025.xls"][2] == "mes no reconocido"
    assert out["cuaderno_foo2025.xls"][2] == "mes no reconocido"
    assert out["CUADERNO_MAYO2024.xlsx"][:2] == (5, 2024)


def test_split_product_unit(spark):
    vals = ["Limón (€/100 kg)", "Huevos (€/docena) *", "Precio € libre", "  Trigo blando panificable (€/t)  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [(r.nombre, r.unidad) for r in df.orderBy("i").select(PZ.split_product_unit("v").alias("u"))
           .select("u.*").collect()]
    assert got == [("Limón", "€/100 kg"), ("Huevos", "€/docena"), ("Precio € libre", ""),
                   ("Trigo blando panificable", "€/t")]


def test_normalise_climate(spark):
    vals = ["2020-7", "2020", "2020-xx", "2020-13", " 2021 - 3 "]
    df = spark.createDataFrame([(v,) for v in vals], "fecha string")
    got = sorted((r.fecha, r.anio, r.mes) for r in PZ.normalise_climate(df).collect())
    assert got == sorted([("2020-7", 2020, 7), ("2020-13", 2020, 13), (" 2021 - 3 ", 2021, 3)])


def test_trace_as_zero(spark):
    vals = ["Ip", "12,3", "", "Acum"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(PZ.float_climate("v", trace_as_zero=True)).collect()]
    assert got == [0.0, 12.3, None, None]


def test_parse_params(spark):
    reqs = ['{"cultivo": "trigo blando", "provincia": "toledo", "anio_ini": 2018}',
            "cultivo: cebada provincia=ciudad real", '{"cultivo": "MAIZ"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reqs)], "i int, r string")
    rows = [r.p for r in df.orderBy("i").select(PZ.parse_params("r").alias("p")).collect()]
    assert (rows[0].cultivo, rows[0].provincia, rows[0].anio_ini, rows[0].anio_fin, rows[0].metodo) == \
        ("TRIGO BLANDO", "Toledo", 2018, 2025, "ambos")
    assert (rows[1].cultivo, rows[1].provincia, rows[1].anio_ini) == ("CEBADA PROVINCIA", "Ciudad Real", 2014)
    assert rows[2].cultivo == "MAIZ"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.decimals(min_value=-10**6, max_value=10**6, places=4, allow_nan=False), min_size=1, max_size=40),
       st.integers(min_value=0, max_value=3))
def test_round_half_up_matches_decimal(spark, values, digits):
    """round_half_up rounds the decimal value half away from zero, as a person would."""
    from decimal import ROUND_HALF_UP, Decimal
    from cosecha.functions.numeric import round_half_up
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(round_half_up("x", digits)).collect()]
    want = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
            for v in values]
    assert got == want
