"""Cell-grid ingestion of worksheets.

A worksheet arrives as a long table of cells ``(file, sheet, row, col, value)``
(0-based, values as text), the shape any spreadsheet reader can land in
Parquet.  Ingestion is a Spark job over that table: file names give the
period, sheets are filtered by name, rows are pivoted on a fixed list of
columns, header cells become per-sheet aggregates joined back to the rows,
and the row classifier / number parsers are Column expressions.

``render_*`` functions do the inverse: they lay a domain table out as the
cells of the workbooks it came from, so the ingestion can be exercised at the
scale of the driver's data and checked by a round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import SKIP_SHEETS, months_df, prov_ccaa_df
from ..dims import UNKNOWN_CCAA
from ..functions.parse import classify_row, float_eu, parse_period, py_float, py_int, split_product_unit, strip_ws
from ..functions.text import MONTHS_ES, zfill

CELL_SCHEMA = "file string, sheet string, row int, col int, value string"
PIVOT_COLS = list(range(20))

# Price pages and their market section.
PRICE_SHEETS = {"Pág. 4": "agricola", "Pág. 5": "frutihort", "Pág. 7": "ganadero"}
WEEK_RE = r"Semana\s+(\d+)"
YEAR_RE = r"(20\d{2})"
SUBTYPE_RE = r"^ {5}"


def _cell(file: Column, sheet: Column, row, col, value: Column) -> Column:
    return F.struct(file.alias("file"), sheet.alias("sheet"), F.lit(row).cast("int").alias("row") if isinstance(row, int)
                    else row.cast("int").alias("row"), F.lit(col).cast("int").alias("col"),
                    value.cast("string").alias("value"))


# ------------------------------------------------------------------ pivot
def pivot_rows(cells: DataFrame, first_row: int = 0) -> DataFrame:
    """One row per (file, sheet, row) with columns c0..c19.

    The pivot values are fixed, so Spark does not scan for distinct columns.
    """
    return (cells.filter(F.col("row") >= first_row)
            .groupBy("file", "sheet", "row").pivot("col", PIVOT_COLS).agg(F.first("value"))
            .select("file", "sheet", "row", *[F.col(str(c)).alias(f"c{c}") for c in PIVOT_COLS]))


def sheet_headers(cells: DataFrame, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """Named header cells per (file, sheet) as one aggregate."""
    aggs = [F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col("value"))).alias(n)
            for n, (r, c) in wanted.items()]
    rc = F.lit(False)
    for r, c in wanted.values():
        rc = rc | ((F.col("row") == r) & (F.col("col") == c))
    return cells.filter(rc).groupBy("file", "sheet").agg(*aggs)


def filter_sheets(cells: DataFrame) -> DataFrame:
    """Drop cover/index sheets; in .xlsm books keep only ``-SRT`` sheets (S3).

    The layout is chosen by sheet content (``-SRT`` in the name), not by the
    extension (trap Q29).
    """
    s = F.trim("sheet")
    xlsm = F.lower("file").endswith(".xlsm")
    keep = ~s.isin(*sorted(SKIP_SHEETS)) & ~F.col("sheet").isin(*sorted(SKIP_SHEETS))
    keep = keep & (~xlsm | F.col("sheet").contains("-SRT"))
    return cells.filter(keep)


# ---------------------------------------------------------------- isolation
def sheet_errors(cells: DataFrame) -> DataFrame:
    """(file, sheet, motivo) of every kept sheet; motivo is NULL for one that can be read.

    A sheet is broken if the cells that its format addresses lie outside its
    used range: the years and month of the header (Format A: row 6, column 4;
    Format B: row 5, column 3), or, in Format A with data rows, column 9.
    """
    b = F.col("sheet").contains("-SRT")
    data = (F.col("row") >= 8) & (F.col("col") == 0) & (classify_row("value")["tipo"] != "skip")
    used = cells.groupBy("file", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"),
                                              F.count_if(data).alias("data"))
    short = F.when(b, (F.col("rows") < 5) | (F.col("cols") < 3)).otherwise((F.col("rows") < 6) | (F.col("cols") < 4))
    motivo = F.when(short, "sin_cabecera").when(~b & (F.col("data") > 0) & (F.col("cols") < 9), "faltan_columnas")
    return used.select("file", "sheet", motivo.alias("motivo"))


def ingest_isolated(cells: DataFrame) -> DataFrame:
    """Every advance row, sheet and file in one table: a broken sheet costs only itself.

    ``tipo`` is ``registro`` (a row of the panel), ``hoja`` (a kept sheet of a
    readable file, with its error if it has one) or ``archivo`` (likewise).
    """
    files = parse_period(cells.select("file").distinct(), "file", months_df(cells.sparkSession))
    readable = files.filter(F.col("error").isNull()).select("file")
    sheets = sheet_errors(filter_sheets(cells).join(readable, "file", "left_semi"))
    good = sheets.filter(F.col("motivo").isNull()).select("file", "sheet")
    # Covers and index sheets go anyway; broken sheets go before anything reads them.
    rows, _ = ingest_advances(cells.join(good, ["file", "sheet"], "left_semi"))
    out = rows.withColumn("tipo", F.lit("registro"))
    out = out.unionByName(sheets.withColumn("tipo", F.lit("hoja")), allowMissingColumns=True)
    return out.unionByName(files.select("file", F.col("error").alias("motivo"), F.lit("archivo").alias("tipo")),
                           allowMissingColumns=True)


# ---------------------------------------------------------------- advances
def ingest_advances(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Advance workbooks → (avances rows, quarantine).

    Format A (I9): crop at (1,0), years at (5,2..4), month at (6,4) (falsy →
    file month), data from row 8 with 8 measures at cols 2-5 / 7-10.
    Format B (I10, ``-SRT`` sheets): crop at (1,0) without the "S/R/T"
    suffix, years at (5,1..3), three regimes per row, a regime is dropped when
    all its measures are NULL.  The quarantine lists files whose name gives no
    period, with the reason.
    """
    spark = cells.sparkSession
    files = parse_period(cells.select("file").distinct(), "file", months_df(spark))
    bad = files.filter(F.col("error").isNotNull()).select("file", F.col("error").alias("motivo"))
    good = files.filter(F.col("error").isNull()).select("file", F.col("anio").alias("f_anio"),
                                                         F.col("mes").alias("f_mes"))
    c = filter_sheets(cells).join(good.select("file"), "file", "left_semi")
    fmt_b = F.col("sheet").contains("-SRT")
    hdr = sheet_headers(c, {"h_cultivo": (1, 0), "a5_1": (5, 1), "a5_2": (5, 2), "a5_3": (5, 3),
                            "a5_4": (5, 4), "m6_4": (6, 4)})
    rows = pivot_rows(c, first_row=8).join(hdr, ["file", "sheet"], "left").join(good, "file")
    rc = classify_row("c0")
    rows = rows.withColumn("_rc", rc).filter(F.col("_rc.tipo") != "skip").withColumn("_b", fmt_b)
    cultivo_raw = F.coalesce(strip_ws("h_cultivo"), F.lit("DESCONOCIDO"))
    cultivo_b = strip_ws(F.regexp_replace(cultivo_raw, r"(?i)\s+S/R/T\s*$", ""))

    def meas(cols):
        return [py_float(f"c{i}") if i is not None else F.lit(None).cast("double") for i in cols]

    a_vals = meas([2, 3, 4, 5, 7, 8, 9, 10])
    regimes = {"secano": ([1, 2, 3], [11, 12, 13]), "regadio": ([4, 5, 6], [14, 15, 16]),
               "total": ([7, 8, 9], [17, 18, 19])}
    names = ["sup_definitivo", "sup_provisional", "sup_avance", "sup_indice",
             "prod_definitivo", "prod_provisional", "prod_avance", "prod_indice"]
    a_struct = F.struct(F.lit("total").alias("regimen"), *[v.alias(n) for v, n in zip(a_vals, names)])
    b_structs = []
    for reg, (sc, pc) in regimes.items():
        v = meas(sc) + [F.lit(None).cast("double")] + meas(pc) + [F.lit(None).cast("double")]
        order = [v[0], v[1], v[2], v[3], v[4], v[5], v[6], v[7]]
        b_structs.append(F.struct(F.lit(reg).alias("regimen"), *[x.alias(n) for x, n in zip(order, names)]))
    variants = F.when(F.col("_b"), F.array(*b_structs)).otherwise(F.array(a_struct))
    ex = rows.select("*", F.explode(variants).alias("_v"))
    any_val = F.lit(False)
    for n in names:
        any_val = any_val | F.col(f"_v.{n}").isNotNull()
    ex = ex.filter(~F.col("_b") | any_val)
    tipo, cod, nombre = F.col("_rc.tipo"), F.col("_rc.cod"), F.col("_rc.nombre")
    is_prov = tipo.isin("provincia", "uniprov")
    nivel = F.when(is_prov, "provincia").when(tipo == "ccaa", "ccaa").otherwise("nacional")
    pm = prov_ccaa_df(spark)
    ex = ex.join(pm.withColumnRenamed("cod", "_pm_cod"), cod == F.col("_pm_cod"), "left")
    ccaa = (F.when(is_prov, F.coalesce(F.col("ccaa_map"), F.lit(UNKNOWN_CCAA)))
            .when(tipo == "ccaa", nombre).otherwise(F.lit("ESPAÑA")))
    mes_av_a = F.coalesce(F.nullif(py_int("m6_4"), F.lit(0)).cast("int"), F.col("f_mes"))
    out = ex.select(
        F.col("f_anio").cast("int").alias("periodo_anio"), F.col("f_mes").cast("int").alias("periodo_mes"),
        F.when(F.col("_b"), cultivo_b).otherwise(cultivo_raw).alias("cultivo"),
        F.col("_v.regimen").alias("regimen"), nivel.alias("nivel"),
        F.when(is_prov, cod).cast("int").alias("cod_provincia"),
        F.when(is_prov, nombre).alias("provincia"), ccaa.alias("ccaa"),
        *[F.col(f"_v.{n}").alias(n) for n in names],
        py_int(F.when(F.col("_b"), F.col("a5_1")).otherwise(F.col("a5_2"))).cast("int").alias("anio_definitivo"),
        py_int(F.when(F.col("_b"), F.col("a5_2")).otherwise(F.col("a5_3"))).cast("int").alias("anio_provisional"),
        py_int(F.when(F.col("_b"), F.col("a5_3")).otherwise(F.col("a5_4"))).cast("int").alias("anio_avance"),
        F.when(F.col("_b"), F.col("f_mes")).otherwise(mes_av_a).cast("int").alias("mes_avance"),
        F.current_timestamp().alias("fecha_carga"))
    return out, bad


def render_advances(avances: DataFrame, last_year_srt: int | None = None) -> DataFrame:
    """Lay the panel out as monthly workbooks, one sheet per crop.

    Format A for every year, except ``last_year_srt`` which gets the Format B
    (``-SRT``) layout in a ``.xlsm`` book.  Each sheet has the header cells,
    a junk note row, the community rows, the province rows (``NN NAME``) and
    the national total; values are written as text.
    """
    a = avances
    names = F.array(*[F.lit(m) for m in MONTHS_ES])
    b = (F.col("periodo_anio") == F.lit(last_year_srt)) if last_year_srt else F.lit(False)
    ext = F.when(b, F.lit(".xlsm")).otherwise(F.lit(".xls"))
    file = F.concat(F.lit("cuaderno_"), F.element_at(names, F.col("periodo_mes")),
                    F.col("periodo_anio").cast("string"), ext)
    sheet = F.when(b, F.concat(F.col("cultivo"), F.lit(" S/R/T-SRT"))).otherwise(F.col("cultivo"))
    head = F.when(b, F.concat(F.col("cultivo"), F.lit(" S/R/T"))).otherwise(F.col("cultivo"))
    label = (F.when(F.col("nivel") == "provincia",
                    F.concat(zfill("cod_provincia", 2), F.lit(" "), F.col("provincia")))
             .when(F.col("nivel") == "ccaa", F.col("ccaa")).otherwise(F.lit("TOTAL ESPAÑA")))
    # stable row number inside the sheet: communities, provinces, national
    order = (F.when(F.col("nivel") == "ccaa", 0).when(F.col("nivel") == "provincia", 1).otherwise(2))
    w = Window.partitionBy("periodo_anio", "periodo_mes", "cultivo").orderBy(order, "ccaa", "cod_provincia")
    base = a.withColumn("_file", file).withColumn("_sheet", sheet).withColumn("_b", b) \
        .withColumn("_row", F.row_number().over(w) + 9)
    f, s = F.col("_file"), F.col("_sheet")
    sup, prod = F.col("sup_avance").cast("string"), F.col("prod_avance").cast("string")
    data = [_cell(f, s, F.col("_row"), 0, label)]
    data += [F.when(~F.col("_b"), _cell(f, s, F.col("_row"), 4, sup)),
             F.when(~F.col("_b"), _cell(f, s, F.col("_row"), 9, prod)),
             F.when(F.col("_b"), _cell(f, s, F.col("_row"), 9, sup)),
             F.when(F.col("_b"), _cell(f, s, F.col("_row"), 19, prod))]
    data_cells = base.select(F.explode(F.array(*data)).alias("c")).filter(F.col("c").isNotNull()) \
        .select("c.*").filter(F.col("value").isNotNull())
    # header cells once per sheet
    sheets = base.groupBy("_file", "_sheet", "_b", "periodo_anio", "periodo_mes") \
        .agg(F.first(head).alias("_head"))
    y = F.col("periodo_anio")
    mes_txt = F.when(F.pmod(F.col("periodo_mes"), F.lit(3)) == 0, F.lit("")) \
        .otherwise(F.col("periodo_mes").cast("string"))
    hdr = [_cell(f, s, 1, 0, F.col("_head")),
           F.when(~F.col("_b"), _cell(f, s, 5, 2, (y - 2).cast("string"))),
           F.when(~F.col("_b"), _cell(f, s, 5, 3, (y - 1).cast("string"))),
           F.when(~F.col("_b"), _cell(f, s, 5, 4, y.cast("string"))),
           F.when(~F.col("_b"), _cell(f, s, 6, 4, mes_txt)),
           F.when(F.col("_b"), _cell(f, s, 5, 1, (y - 2).cast("string"))),
           F.when(F.col("_b"), _cell(f, s, 5, 2, (y - 1).cast("string"))),
           F.when(F.col("_b"), _cell(f, s, 5, 3, y.cast("string"))),
           _cell(f, s, 8, 0, F.lit("(1) Datos provisionales")),
           _cell(f, s, 9, 0, F.lit("SUMA PROVINCIAS"))]
    hdr_cells = sheets.select(F.explode(F.array(*hdr)).alias("c")).filter(F.col("c").isNotNull()).select("c.*")
    cover = sheets.select("_file").distinct().select(
        _cell(F.col("_file"), F.lit("portada"), 0, 0, F.lit("Avances de superficies y producciones")).alias("c")) \
        .select("c.*")
    return data_cells.unionByName(hdr_cells).unionByName(cover)


# Where the eight measures of Format A and the regimes of Format B stand.
FORMAT_A = {"sup_definitivo": 2, "sup_provisional": 3, "sup_avance": 4, "sup_indice": 5,
            "prod_definitivo": 7, "prod_provisional": 8, "prod_avance": 9, "prod_indice": 10}
FORMAT_B = {"secano": (1, 11), "regadio": (4, 14), "total": (7, 17)}  # first area and first production column
SHARES = {"secano": 0.25, "regadio": 0.75, "total": 1.0}


def full_measures(sup: Column, prod: Column, mes: Column) -> dict[str, Column]:
    """All eight measures of a row from its advance area and production."""
    return {"sup_definitivo": sup - 20.0, "sup_provisional": sup - 10.0, "sup_avance": sup,
            "sup_indice": F.pmod(mes, F.lit(7)) + 100.5, "prod_definitivo": prod + 0.25,
            "prod_provisional": prod + 0.5, "prod_avance": prod, "prod_indice": F.pmod(mes, F.lit(5)) + 90.0}


def render_full(avances: DataFrame, srt_year: int) -> DataFrame:
    """``render_advances`` with every measure and regime, and with sheets that arrive broken.

    Format A sheets have all eight measures.  Format B sheets have three
    regimes (rain-fed is empty for provinces whose code is divisible by
    three).  By length of crop name plus year plus month modulo 11, sheets
    with 0 end before their header does, and Format A sheets with 1 have lost
    the columns from 7 on.  Books of February in years that leave 3 modulo 5
    have a name without a month.
    """
    plain = render_advances(avances, srt_year)
    a = avances
    names = F.array(*[F.lit(m) for m in MONTHS_ES])
    b = F.col("periodo_anio") == srt_year
    year, month = F.col("periodo_anio"), F.col("periodo_mes")
    file = F.concat(F.lit("cuaderno_"), F.element_at(names, month), year.cast("string"),
                    F.when(b, ".xlsm").otherwise(".xls"))
    sheet = F.when(b, F.concat(F.col("cultivo"), F.lit(" S/R/T-SRT"))).otherwise(F.col("cultivo"))
    order = F.when(F.col("nivel") == "ccaa", 0).when(F.col("nivel") == "provincia", 1).otherwise(2)
    w = Window.partitionBy("periodo_anio", "periodo_mes", "cultivo").orderBy(order, "ccaa", "cod_provincia")
    base = a.select("*", file.alias("_file"), sheet.alias("_sheet"), (F.row_number().over(w) + 9).alias("_row"))
    f, s, r = F.col("_file"), F.col("_sheet"), F.col("_row")
    cells = []
    for name, value in full_measures(F.col("sup_avance"), F.col("prod_avance"), month).items():
        cells.append(F.when(~b, _cell(f, s, r, FORMAT_A[name], value)))
    for regimen, (sup_col, prod_col) in FORMAT_B.items():
        dry = (F.lit(regimen) == "secano") & (F.coalesce(F.pmod("cod_provincia", F.lit(3)), F.lit(1)) == 0)
        own = full_measures(F.col("sup_avance") * SHARES[regimen], F.col("prod_avance") * SHARES[regimen], month)
        for i, kind in enumerate(("definitivo", "provisional", "avance")):
            cells.append(F.when(b & ~dry, _cell(f, s, r, sup_col + i, own[f"sup_{kind}"])))
            cells.append(F.when(b & ~dry, _cell(f, s, r, prod_col + i, own[f"prod_{kind}"])))
    measures = (base.select(F.explode(F.array(*cells)).alias("c")).filter(F.col("c").isNotNull()).select("c.*")
                .filter(F.col("value").isNotNull()))
    everything = plain.filter((F.col("row") < 10) | (F.col("col") == 0)).unionByName(measures)
    key = base.select(
        F.col("_file").alias("file"), F.col("_sheet").alias("sheet"), b.alias("b"),
        F.pmod(F.length("cultivo") + year + month, F.lit(11)).alias("k")).distinct()
    books = base.select(F.col("_file").alias("file"), year.cast("string").alias("y"),
                        ((F.pmod(year, F.lit(5)) == 3) & (month == 2)).alias("unnamed")).distinct()
    j = everything.join(key, ["file", "sheet"], "left").join(books, "file")  # covers have no key
    kept = F.coalesce(~((F.col("k") == 0) & (F.col("row") >= 5)) & ~((F.col("k") == 1) & ~F.col("b") & (F.col("col") >= 7)),
                      F.lit(True))
    named = F.when(F.col("unnamed"), F.concat(F.lit("cuaderno_foo"), F.col("y"), F.lit(".xls"))).otherwise(F.col("file"))
    return j.filter(kept).select(named.alias("file"), "sheet", "row", "col", "value")


# ------------------------------------------------------------------- prices
def detect_report_meta(cells: DataFrame, year_re: str = YEAR_RE, strict: bool = False) -> DataFrame:
    """Week, previous week, year and date ranges per price workbook.

    Reads the header cells of "Pág. 4": week from (6,4) then (6,3) ("Semana
    NN"); year from the first match in (8,4), (8,3), (7,4), (7,3); date ranges
    (7,3) / (7,4) unless they mention "especificaciones".
    """
    p4 = cells.filter(F.col("sheet") == "Pág. 4")
    h = sheet_headers(p4, {"w4": (6, 4), "w3": (6, 3), "r8c4": (8, 4), "r8c3": (8, 3),
                           "r7c4": (7, 4), "r7c3": (7, 3)})

    def wk(c):
        return F.when(F.col(c).rlike(WEEK_RE), F.regexp_extract(c, WEEK_RE, 1).cast("int"))

    def yr(c):
        return F.when(strip_ws(c).rlike(year_re), F.regexp_extract(strip_ws(c), year_re, 1).cast("int"))
    week = F.coalesce(wk("w4"), wk("w3"))
    prev = F.when(wk("w4").isNotNull(), wk("w3"))

    def rng(c):
        s = strip_ws(c)
        return F.when(~F.lower(s).contains("especificaciones"), s)
    out = h.select("file", F.coalesce(yr("r8c4"), yr("r8c3"), yr("r7c4"), yr("r7c3")).alias("anio"),
                   week.alias("semana"), prev.alias("semana_anterior"),
                   rng("r7c3").alias("fecha_rango_anterior"), rng("r7c4").alias("fecha_rango_actual"))
    if strict:
        # the renaming tool's variant: a book without week or year is an error
        bad = out.filter(F.col("anio").isNull() | F.col("semana").isNull()).select("file").limit(5).collect()
        if bad:
            raise ValueError(f"semana o año no detectados en: {[r.file for r in bad]}")
    return out


def ingest_prices(cells: DataFrame, year_re: str = YEAR_RE, compat_subtype: bool = True) -> DataFrame:
    """Price workbooks → weekly price rows.

    Rows from 9 (agricola) or 7 (other pages); a row whose text has no "€"
    and no "(n)" note is a category and sets the running, upper-cased
    category for the next products (forward fill with ``last(ignorenulls)``
    over the row order of the sheet, I14); product rows split name and unit
    (I13) and parse the four numbers with decimal commas (I4).
    ``compat_subtype=True`` reproduces the reference's always-FALSE subtype
    flag (trap Q3); otherwise indentation of the raw cell sets it (I15).
    """
    spark = cells.sparkSession
    meta = detect_report_meta(cells, year_re)
    pages = spark.createDataFrame(list(PRICE_SHEETS.items()), "sheet string, seccion string")
    c = cells.join(F.broadcast(pages), "sheet")
    rows = pivot_rows(c).join(F.broadcast(pages), "sheet")
    start = F.when(F.col("seccion") == "agricola", 9).otherwise(7)
    rows = rows.filter((F.col("row") >= start) & F.col("c2").isNotNull() & (strip_ws("c2") != ""))
    c2 = strip_ws("c2")
    note = strip_ws(F.coalesce(F.col("c1"), F.lit(""))).rlike(r"^\(\d+\)")
    is_cat = ~note & ~c2.contains("€")
    w = (Window.partitionBy("file", "sheet").orderBy("row")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("categoria", F.coalesce(
        F.last(F.when(is_cat, F.upper(c2)), ignorenulls=True).over(w), F.lit("")))
    prod = rows.filter(c2.contains("€")).withColumn("_pu", split_product_unit(c2))
    sub = F.lit(False) if compat_subtype else F.col("c2").rlike(SUBTYPE_RE)
    out = prod.join(meta, "file", "left").select(
        F.col("anio").cast("int").alias("anio"), F.col("semana").cast("int").alias("semana"), "seccion",
        "categoria", strip_ws(F.col("_pu.nombre")).alias("producto"), F.col("_pu.unidad").alias("unidad"),
        float_eu("c3").alias("precio_sem_anterior"), float_eu("c4").alias("precio_sem_actual"),
        float_eu("c5").alias("variacion_euros"), float_eu("c6").alias("variacion_pct"),
        sub.alias("es_subtipo"))
    return out


def render_prices(coyuntura: DataFrame) -> DataFrame:
    """Lay weekly prices out as report workbooks: one book per (year, week),
    the three price pages, a category row before each product, European
    number text, indented sub-type products (priority 5)."""
    spark = coyuntura.sparkSession
    sec = spark.createDataFrame([(v, k) for k, v in PRICE_SHEETS.items()], "seccion string, sheet string")
    c = coyuntura.join(F.broadcast(sec), "seccion")
    file = F.concat(F.lit("coyuntura_"), F.col("anio").cast("string"), F.lit("_S"), zfill("semana", 2),
                    F.lit(".xlsx"))
    c = c.withColumn("_file", file)
    start = F.when(F.col("seccion") == "agricola", 9).otherwise(7)
    w = Window.partitionBy("_file", "sheet").orderBy("producto")
    c = c.withColumn("_k", F.row_number().over(w)).withColumn("_row", start + (F.col("_k") - 1) * 2)
    f, s = F.col("_file"), F.col("sheet")

    def eu(x):
        return F.coalesce(F.replace(F.col(x).cast("string"), F.lit("."), F.lit(",")), F.lit("-"))
    indent = F.when(F.col("producto").startswith("5"), F.lit("     ")).otherwise(F.lit(""))
    text = F.concat(indent, F.col("producto"), F.lit(" ("), F.col("unidad"), F.lit(")"),
                    F.when(F.col("producto").startswith("2"), F.lit(" *")).otherwise(F.lit("")))
    cells = [_cell(f, s, F.col("_row"), 2, F.initcap(F.col("categoria"))),
             _cell(f, s, F.col("_row") + 1, 2, text),
             _cell(f, s, F.col("_row") + 1, 1, F.when(F.col("producto").startswith("3"), F.lit("(1)"))),
             _cell(f, s, F.col("_row") + 1, 3, eu("precio_sem_anterior")),
             _cell(f, s, F.col("_row") + 1, 4, eu("precio_sem_actual")),
             _cell(f, s, F.col("_row") + 1, 5, eu("variacion_euros")),
             _cell(f, s, F.col("_row") + 1, 6, eu("variacion_pct"))]
    data = c.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("value").isNotNull())
    books = c.select("_file", "anio", "semana").distinct()
    p4 = F.lit("Pág. 4")
    hdr = [_cell(f, p4, 6, 3, F.concat(F.lit("Semana "), F.when(F.col("semana") > 1, F.col("semana") - 1)
                                       .otherwise(F.lit(52)).cast("string"))),
           _cell(f, p4, 6, 4, F.concat(F.lit("Semana "), F.col("semana").cast("string"))),
           _cell(f, p4, 7, 3, F.lit("(especificaciones)")),
           _cell(f, p4, 7, 4, F.concat(F.lit("semana "), zfill("semana", 2), F.lit(" "),
                                       F.col("anio").cast("string"))),
           _cell(f, F.lit("Pág. 1"), 0, 0, F.lit("Índice"))]
    hdr_cells = books.select(F.explode(F.array(*hdr)).alias("c")).select("c.*")
    return data.unionByName(hdr_cells)
