"""Text fragments for retrieval (D1-D4, D6) and the fragment store.

Fragments are built row by row with ``concat_ws`` (it skips the NULL optional
clauses), number formatting with ``format_number`` and month names from a
fixed array; no Python runs per row.  A fragment is
``(id, text, fuente, metadata map<string,string>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col_
from ..functions.text import MONTHS_ES, fmt_fixed, fmt_thousands, safe_id, zfill
from ..session import spread
from .analysis import dedup_first

# Python's str.split() separators (Unicode whitespace), as a Java regex.
WS_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085\u001c-\u001f"
WS_RE = "[" + WS_CLASS + "]+"
WS_CHARS = " \t\n\r\x0b\x0c\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b)) + \
    "\u2028\u2029\u202f\u205f\u3000\u0085\x1c\x1d\x1e\x1f"


def month_name(mes) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS_ES])
    return F.coalesce(F.element_at(names, col_(mes).cast("int")), col_(mes).cast("string"))


def meta(**kv) -> Column:
    """metadata map; NULL values become "" (the store only takes scalars)."""
    pairs = []
    for k, v in kv.items():
        pairs += [F.lit(k), F.coalesce(col_(v).cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def _frame(df: DataFrame, base: Column, text: Column, fuente: str, metadata: Column,
           order: list[str]) -> DataFrame:
    out = df.select(safe_id(base).alias("id"), text.alias("text"), F.lit(fuente).alias("fuente"),
                    metadata.alias("metadata"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    return out


# The wording of the sentences below is that of the fragments users have.
def national_fragments(avances: DataFrame) -> DataFrame:
    """One sentence per national row (D1); optional clauses skipped when NULL."""
    a = avances.filter(F.col("nivel") == "nacional")
    reg = F.when(F.col("regimen").isNotNull() & (F.col("regimen") != "total"),
                 F.concat(F.lit(" ("), F.col("regimen"), F.lit(")"))).otherwise(F.lit(""))
    head = F.concat(F.lit("En "), month_name("periodo_mes"), F.lit(" de "), F.col("periodo_anio").cast("string"),
                    F.lit(", el avance nacional de "), F.col("cultivo"), reg)
    sup = F.when(F.col("sup_avance").isNotNull(),
                 F.concat(F.lit("muestra una superficie estimada de "), fmt_thousands("sup_avance", 0),
                          F.lit(" hectáreas")))
    prod = F.when(F.col("prod_avance").isNotNull(),
                  F.concat(F.lit("con una producción de "), fmt_thousands("prod_avance", 3),
                           F.lit(" miles de toneladas")))
    parts = [head, sup, prod]
    if "sup_definitivo" in a.columns and "anio_definitivo" in a.columns:
        parts.append(F.when(F.col("sup_definitivo").isNotNull() & F.col("anio_definitivo").isNotNull()
                            & (F.col("anio_definitivo") != 0),
                            F.concat(F.lit("El dato definitivo de "), F.col("anio_definitivo").cast("string"),
                                     F.lit(" fue "), fmt_thousands("sup_definitivo", 0),
                                     F.lit(" ha de superficie"))))
    text = F.concat(F.concat_ws(". ", *parts), F.lit("."))
    base = F.concat(F.lit("av_nac_"), F.col("cultivo"), F.lit("_"), F.col("periodo_anio").cast("string"),
                    F.lit("_"), zfill("periodo_mes", 2), F.lit("_"), F.col("regimen"))
    md = meta(fuente=F.lit("avances"), nivel=F.lit("nacional"), cultivo="cultivo", anio="periodo_anio",
              mes="periodo_mes", regimen=F.coalesce(F.col("regimen"), F.lit("total")))
    return _frame(a, base, text, "avances", md, ["cultivo", "periodo_anio", "periodo_mes"])


def ccaa_fragments(avances: DataFrame) -> DataFrame:
    """Community sums of province rows, one sentence each."""
    g = (avances.filter((F.col("nivel") == "provincia") & (F.col("regimen") == "total"))
         .groupBy("ccaa", "cultivo", "periodo_anio", "periodo_mes", "regimen")
         .agg(F.sum("sup_avance").alias("sup"),
              # exact decimal sum, so the text does not depend on summation order
              F.sum(F.col("prod_avance").cast("decimal(22,5)")).cast("double").alias("prod"),
              F.count(F.lit(1)).alias("n_prov")))
    head = F.concat(F.lit("En "), month_name("periodo_mes"), F.lit(" de "), F.col("periodo_anio").cast("string"),
                    F.lit(", "), F.col("cultivo"), F.lit(" en "), F.col("ccaa"),
                    F.lit(" (suma de "), F.col("n_prov").cast("string"), F.lit(" provincias)"))
    sup = F.when(F.col("sup").isNotNull(), F.concat(F.lit("tiene una superficie de avance de "),
                                                    fmt_thousands("sup", 0), F.lit(" hectáreas")))
    prod = F.when(F.col("prod").isNotNull(), F.concat(F.lit("y una producción de "), fmt_thousands("prod", 3),
                                                      F.lit(" miles de toneladas")))
    text = F.concat(F.concat_ws(" ", head, sup, prod), F.lit("."))
    base = F.concat(F.lit("av_ccaa_"), F.col("ccaa"), F.lit("_"), F.col("cultivo"), F.lit("_"),
                    F.col("periodo_anio").cast("string"), F.lit("_"), zfill("periodo_mes", 2), F.lit("_"),
                    F.col("regimen"))
    md = meta(fuente=F.lit("avances"), nivel=F.lit("ccaa"), ccaa="ccaa", cultivo="cultivo", anio="periodo_anio",
              mes="periodo_mes", regimen=F.coalesce(F.col("regimen"), F.lit("total")))
    return _frame(g, base, text, "avances", md, ["ccaa", "cultivo", "periodo_anio", "periodo_mes"])


def price_fragments(coyuntura: DataFrame) -> DataFrame:
    """Weekly price sentences (D2b): two decimals like Python's ``:.2f``."""
    c = coyuntura
    head = F.concat(F.lit("Semana "), F.col("semana").cast("string"), F.lit(" de "), F.col("anio").cast("string"),
                    F.lit(": "), F.col("producto"))
    act = F.when(F.col("precio_sem_actual").isNotNull(),
                 F.concat(F.lit("tiene un precio medio nacional de "), fmt_fixed("precio_sem_actual", 2),
                          F.lit(" "), F.col("unidad")))
    sign = F.when(F.col("variacion_pct") >= 0, F.lit("+")).otherwise(F.lit(""))
    var = F.when(F.col("variacion_pct").isNotNull(),
                 F.concat(F.lit("con una variación semanal del "), sign, fmt_fixed("variacion_pct", 2), F.lit("%")))
    ant = F.when(F.col("precio_sem_anterior").isNotNull(),
                 F.concat(F.lit("(semana anterior: "), fmt_fixed("precio_sem_anterior", 2), F.lit(" "),
                          F.col("unidad"), F.lit(")")))
    cat = F.when(F.col("categoria").isNotNull() & (F.col("categoria") != ""),
                 F.concat(F.lit("Categoría: "), F.lower("categoria"), F.lit(", sección: "), F.col("seccion")))
    text = F.concat(F.concat_ws(". ", head, act, var, ant, cat), F.lit("."))
    base = F.concat(F.lit("coy_"), F.col("producto"), F.lit("_"), F.col("anio").cast("string"), F.lit("_S"),
                    zfill("semana", 2))
    md = meta(fuente=F.lit("coyuntura"), producto="producto", seccion="seccion", categoria="categoria",
              anio="anio", semana="semana")
    return _frame(c, base, text, "coyuntura", md, ["anio", "semana", "seccion", "producto"])


def climate_fragments(clima_prov: DataFrame, avances: DataFrame) -> DataFrame:
    """Province-month climate sentences (D2c) with the province name from the
    panel (J8): one deterministic name per code, default "Provincia <cod>"."""
    names = (avances.filter((F.col("nivel") == "provincia") & F.col("cod_provincia").isNotNull())
             .groupBy("cod_provincia")
             .agg(F.max_by(F.struct("provincia", "ccaa"),
                           F.struct("periodo_anio", "periodo_mes", "cultivo")).alias("_n")))
    j = clima_prov.join(names, "cod_provincia", "left")
    prov = F.coalesce(F.col("_n.provincia"), F.concat(F.lit("Provincia "), F.col("cod_provincia").cast("string")))
    ccaa = F.coalesce(F.col("_n.ccaa"), F.lit(""))
    head = F.concat(F.lit("Clima en "), prov, F.lit(" ("), ccaa, F.lit(") en "), month_name("mes"), F.lit(" de "),
                    F.col("anio").cast("string"))
    est = F.concat(F.lit("basado en "), F.col("n_estaciones").cast("string"), F.lit(" estaciones AEMET"))

    def clause(c, label, unit=""):
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c).cast("string"), F.lit(unit)))
    text = F.concat(F.concat_ws(". ", head, est, clause("t_media_c", "Temperatura media: ", "°C"),
                                clause("t_max_abs_c", "máxima absoluta: ", "°C"),
                                clause("t_min_abs_c", "mínima absoluta: ", "°C"),
                                clause("precip_media_mm", "Precipitación media: ", " mm"),
                                clause("horas_sol_med", "Horas de sol: ")), F.lit("."))
    base = F.concat(F.lit("clima_"), F.col("cod_provincia").cast("string"), F.lit("_"),
                    F.col("anio").cast("string"), F.lit("_"), zfill("mes", 2))
    md = meta(fuente=F.lit("clima"), cod_provincia="cod_provincia", provincia=prov, ccaa=ccaa, anio="anio",
              mes="mes")
    return _frame(j, base, text, "clima", md, ["cod_provincia", "anio", "mes"])


def dedup_fragments(frags: DataFrame) -> DataFrame:
    """Keep the first fragment per id (D4, W6) under a total order: the
    source's own ordering columns, then the text itself (trap Q14)."""
    order = sorted(c for c in frags.columns if c.startswith("_o")) + ["text"]
    return dedup_first(frags, "id", order).drop(*[c for c in frags.columns if c.startswith("_o")])


def chunk_words(docs: DataFrame, text_col: str = "text", key: str = "doc_id", size: int = 800,
                overlap: int = 100, min_chars: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping word windows (D3): starts 0, size-overlap, …; chunks under
    ``min_chars`` characters are dropped but keep their original index, and
    ``total_chunks`` counts chunks before dropping.  The whole text is used.
    The columns named by ``carry`` go along with every chunk.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size (otherwise the window never advances)")
    step = size - overlap
    trimmed = F.trim(F.col(text_col), F.lit(WS_CHARS))
    words = F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, WS_RE))
    # explode of a one-element array: a Generate node, so later projections
    # reference the split result instead of re-evaluating the split per use
    d = spread(docs).select(key, *carry, F.explode(F.array(words)).alias("_w")).filter(F.size("_w") > 0)
    n = F.size("_w")
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    # the chunk strings are built inside one array expression, so the word
    # array is never copied once per exploded chunk row
    chunks = F.transform(starts, lambda s0: F.struct(
        s0.alias("inicio"), F.least(n - s0, F.lit(size)).alias("n_palabras"),
        F.array_join(F.slice("_w", s0 + 1, size), " ").alias("chunk")))
    ex = d.select(key, *carry, (((n - 1) / step).cast("int") + 1).alias("total_chunks"),
                  F.posexplode(chunks).alias("chunk_index", "_c"))
    out = ex.select(key, "chunk_index", "total_chunks", "_c.inicio", "_c.n_palabras", "_c.chunk", *carry)
    return out.filter(F.length(F.trim("chunk")) >= min_chars)


def document_fragments(docs: DataFrame, key: str = "doc_id", file_col: str = "source",
                       size: int = 800, overlap: int = 100) -> DataFrame:
    """Word-window chunks of whole documents as store fragments (D3 + store).

    Source name ``pdf`` in both the fragments and the replacement key (the
    reference wrote "pdf" but deleted "pdfs", trap Q15).
    """
    c = chunk_words(docs.select(key, "text", F.col(file_col).alias("_archivo")), "text", key, size, overlap,
                    carry=("_archivo",))
    base = F.concat(F.lit("pdf_"), F.col(key).cast("string"), F.lit("_"), zfill("chunk_index", 4))
    md = meta(fuente=F.lit("pdf"), archivo="_archivo", chunk_index="chunk_index", total_chunks="total_chunks")
    return _frame(c, base, F.col("chunk"), "pdf", md, [key, "chunk_index"])


def fragment_counts(store: DataFrame) -> DataFrame:
    """Fragments per source."""
    return store.groupBy("fuente").agg(F.count(F.lit(1)).alias("n_fragmentos"),
                                       F.count_distinct("id").alias("n_ids"))


# Metadata keys of the fragment store and their types.
STORE_COLUMNS = {"nivel": "string", "cultivo": "string", "regimen": "string", "ccaa": "string", "provincia": "string",
                 "cod_provincia": "int", "producto": "string", "seccion": "string", "categoria": "string",
                 "anio": "int", "mes": "int", "semana": "int", "archivo": "string", "chunk_index": "int"}
FILTERED = ("cultivo", "producto", "provincia", "ccaa", "archivo")  # text columns that equality filters name


def write_typed_store(frags: DataFrame, path: str) -> DataFrame:
    """The fragments with their metadata as typed columns, one folder per source.

    Rows are sorted by the columns that filters name, and these have Parquet
    Bloom filters, so an equality skips the row groups that cannot hold it.
    An empty metadata value is NULL here.
    """
    typed = frags.select("id", "text", "fuente", *[
        F.nullif(F.col("metadata")[c], F.lit("")).try_cast(t).alias(c) for c, t in STORE_COLUMNS.items()])
    writer = typed.hint("rebalance", "fuente").sortWithinPartitions("fuente", *FILTERED, "anio", "mes").write
    for c in FILTERED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.mode("overwrite").partitionBy("fuente").parquet(path)
    return frags.sparkSession.read.parquet(path)


def filter_fragments(store: DataFrame, where: dict[str, str | int]) -> DataFrame:
    """Fragments whose metadata equal ``where`` (D6); every key must be a column of the store."""
    unknown = sorted(set(where) - set(STORE_COLUMNS) - {"fuente", "id"})
    if unknown:
        raise ValueError(f"not metadata columns: {unknown}")
    out = store
    for c, v in where.items():
        out = out.filter(F.col(c) == F.lit(v))
    return out
