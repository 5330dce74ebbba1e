"""Worksheet ingestion on hand-made cell grids (FIXTURES.md §2)."""

from cosecha.sources import cells as CE


def _cells(spark, rows):
    return spark.createDataFrame(rows, CE.CELL_SCHEMA)


def test_format_a_and_b(spark):
    f_a, f_b = "cuaderno_abril2025.xls", "cuaderno_mayo2026.xlsm"
    rows = [(f_a, "portada", 0, 0, "Avances"),
            (f_a, "CEBADA", 1, 0, "CEBADA TOTAL"), (f_a, "CEBADA", 5, 2, "2023"), (f_a, "CEBADA", 5, 3, "2024"),
            (f_a, "CEBADA", 5, 4, "2025"), (f_a, "CEBADA", 6, 4, "0"),
            (f_a, "CEBADA", 8, 0, "(1) nota"), (f_a, "CEBADA", 9, 0, "09 Burgos"), (f_a, "CEBADA", 9, 4, "310000"),
            (f_a, "CEBADA", 9, 9, "1085.5"), (f_a, "CEBADA", 10, 0, "CASTILLA Y LEÓN"),
            (f_a, "CEBADA", 11, 0, "28 Madrid"), (f_a, "CEBADA", 12, 0, "TOTAL ESPAÑA"), (f_a, "CEBADA", 12, 4, "1,5"),
            (f_b, "TRIGO S/R/T-SRT", 1, 0, "TRIGO S/R/T"), (f_b, "TRIGO S/R/T-SRT", 5, 3, "2026"),
            (f_b, "TRIGO S/R/T-SRT", 9, 0, "41 Sevilla"), (f_b, "TRIGO S/R/T-SRT", 9, 3, "100"),
            (f_b, "TRIGO S/R/T-SRT", 9, 9, "300"), (f_b, "TRIGO S/R/T-SRT", 9, 19, "2.5"),
            (f_b, "Otra", 9, 0, "41 Sevilla"), (f_b, "Otra", 9, 4, "7"),
            ("cuaderno_foo2025.xls", "X", 9, 0, "41 Sevilla")]
    out, bad = CE.ingest_advances(_cells(spark, rows))
    got = sorted((r.periodo_anio, r.periodo_mes, r.cultivo, r.regimen, r.nivel, r.cod_provincia, r.ccaa,
                  r.sup_avance, r.prod_avance, r.mes_avance) for r in out.collect())
    assert got == sorted([
        (2025, 4, "CEBADA TOTAL", "total", "provincia", 9, "CASTILLA Y LEÓN", 310000.0, 1085.5, 4),
        (2025, 4, "CEBADA TOTAL", "total", "ccaa", None, "CASTILLA Y LEÓN", None, None, 4),
        (2025, 4, "CEBADA TOTAL", "total", "provincia", 28, "MADRID", None, None, 4),
        (2025, 4, "CEBADA TOTAL", "total", "nacional", None, "ESPAÑA", None, None, 4),  # "1,5" is not a float
        (2026, 5, "TRIGO", "secano", "provincia", 41, "ANDALUCÍA", 100.0, None, 5),
        (2026, 5, "TRIGO", "total", "provincia", 41, "ANDALUCÍA", 300.0, 2.5, 5)])
    assert [(r.file, r.motivo) for r in bad.collect()] == [("cuaderno_foo2025.xls", "mes no reconocido")]


def test_price_page(spark):
    f = "coyuntura_2024_S07.xlsx"
    p4, p5 = "Pág. 4", "Pág. 5"
    rows = [(f, p4, 6, 3, "Semana 6"), (f, p4, 6, 4, "Semana 7"), (f, p4, 7, 3, "(especificaciones)"),
            (f, p4, 7, 4, "12-18/02"), (f, p4, 8, 4, "2024"),
            (f, p4, 9, 2, "Cereales"), (f, p4, 10, 2, "Trigo blando panificable (€/t)"), (f, p4, 10, 3, "250,5"),
            (f, p4, 10, 4, "251,0"), (f, p4, 10, 6, "0,2"),
            (f, p4, 11, 1, "(1)"), (f, p4, 11, 2, "     Trigo duro (€/t) *"), (f, p4, 11, 4, "-"),
            (f, p4, 12, 2, "Aceites"), (f, p4, 13, 2, "Aceite de oliva virgen extra (€/100 kg)"),
            (f, p4, 13, 4, "1.234,5"),
            (f, p5, 7, 2, "Frutas"), (f, p5, 8, 2, "Limón (€/100 kg)"), (f, p5, 8, 4, "80"),
            (f, "Pág. 1", 0, 0, "Índice")]
    cells = _cells(spark, rows)
    meta = CE.detect_report_meta(cells).first()
    assert (meta.anio, meta.semana, meta.semana_anterior, meta.fecha_rango_anterior, meta.fecha_rango_actual) == \
        (2024, 7, 6, None, "12-18/02")
    got = sorted((r.seccion, r.categoria, r.producto, r.unidad, r.precio_sem_anterior, r.precio_sem_actual,
                  r.variacion_pct, r.es_subtipo) for r in CE.ingest_prices(cells).collect())
    assert got == sorted([
        ("agricola", "CEREALES", "Trigo blando panificable", "€/t", 250.5, 251.0, 0.2, False),
        ("agricola", "CEREALES", "Trigo duro", "€/t", None, None, None, False),
        ("agricola", "ACEITES", "Aceite de oliva virgen extra", "€/100 kg", None, None, None, False),
        ("frutihort", "FRUTAS", "Limón", "€/100 kg", None, 80.0, None, False)])
    fixed = {r.producto: r.es_subtipo for r in CE.ingest_prices(cells, compat_subtype=False).collect()}
    assert fixed["Trigo duro"] is True and fixed["Limón"] is False


def test_report_meta_strict(spark):
    import pytest
    rows = [("a.xlsx", "Pág. 4", 6, 4, "Semana 3"), ("a.xlsx", "Pág. 4", 8, 4, "2023"),
            ("b.xlsx", "Pág. 4", 6, 4, "sin semana"), ("b.xlsx", "Pág. 4", 8, 4, "2023")]
    cells = _cells(spark, rows)
    assert CE.detect_report_meta(cells).count() == 2
    with pytest.raises(ValueError, match="b.xlsx"):
        CE.detect_report_meta(cells, strict=True)
