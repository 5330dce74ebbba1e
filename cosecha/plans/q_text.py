"""Fragment, chunking, k-NN and entity-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.text import MONTHS_ES
from ..operators import fragments as FR
from ..operators.analysis import dedup_first
from ..operators.entities import extract_context
from ..operators import vector as V
from ..operators.vector import knn, label_centroids
from ..session import importable
from ..sources import tables as TB
from ..sources.tables import Tables
from .oracle import R, fold_sql, with_tables
from .registry import query

_MES = "[" + ",".join("'" + m + "'" for m in MONTHS_ES) + "]"


def _mes(c):
    return f"{_MES}[{c}]"


def _fmt(x, d):  # Python f"{x:,.Nf}".replace(",", ".")
    return f"replace(format('{{:,.{d}f}}', {x}), ',', '.')"


def _fix(x, d):  # Python f"{x:.Nf}"
    return f"format('{{:.{d}f}}', {x})"


def _safe_id(base):
    return f"replace(replace(trim({base}), '/', '-'), ' ', '_') || '_' || substr(md5({base}), 1, 8)"


def _z2(c):
    return f"CASE WHEN length(CAST({c} AS VARCHAR)) >= 2 THEN CAST({c} AS VARCHAR) ELSE lpad(CAST({c} AS VARCHAR), 2, '0') END"


# The wording of the sentences is that of ``operators.fragments``.
NAT_SQL = f"""
SELECT {_safe_id(f"'av_nac_' || cultivo || '_' || CAST(periodo_anio AS VARCHAR) || '_' || {_z2('periodo_mes')} || '_' || regimen")} AS id,
  concat_ws('. ',
    'En ' || {_mes('periodo_mes')} || ' de ' || CAST(periodo_anio AS VARCHAR) || ', el avance nacional de ' || cultivo
      || CASE WHEN regimen IS NOT NULL AND regimen <> 'total' THEN ' (' || regimen || ')' ELSE '' END,
    CASE WHEN sup_avance IS NOT NULL THEN 'muestra una superficie estimada de ' || {_fmt('sup_avance', 0)} || ' hectáreas' END,
    CASE WHEN prod_avance IS NOT NULL THEN 'con una producción de ' || {_fmt('prod_avance', 3)} || ' miles de toneladas' END
  ) || '.' AS text, 'avances' AS fuente, cultivo, periodo_anio, periodo_mes
FROM avances WHERE nivel = 'nacional'"""


@query("frag_national", with_tables(NAT_SQL))
def q_frag_national(spark, d):
    f = FR.national_fragments(Tables.get(spark, d).avances())
    return f.select("id", "text", "fuente", F.col("_o0").alias("cultivo"), F.col("_o1").alias("periodo_anio"),
                    F.col("_o2").alias("periodo_mes"))


CCAA_SQL = f"""
SELECT {_safe_id(f"'av_ccaa_' || ccaa || '_' || cultivo || '_' || CAST(periodo_anio AS VARCHAR) || '_' || {_z2('periodo_mes')} || '_' || regimen")} AS id,
  concat_ws(' ',
    'En ' || {_mes('periodo_mes')} || ' de ' || CAST(periodo_anio AS VARCHAR) || ', ' || cultivo || ' en ' || ccaa
      || ' (suma de ' || CAST(n_prov AS VARCHAR) || ' provincias)',
    CASE WHEN sup IS NOT NULL THEN 'tiene una superficie de avance de ' || {_fmt('sup', 0)} || ' hectáreas' END,
    CASE WHEN prod IS NOT NULL THEN 'y una producción de ' || {_fmt('prod', 3)} || ' miles de toneladas' END
  ) || '.' AS text, 'avances' AS fuente
FROM (SELECT ccaa, cultivo, periodo_anio, periodo_mes, regimen, sum(sup_avance) AS sup,
             CAST(sum(CAST(prod_avance AS DECIMAL(22,5))) AS DOUBLE) AS prod, count(*) AS n_prov
      FROM avances WHERE nivel = 'provincia' AND regimen = 'total'
      GROUP BY ccaa, cultivo, periodo_anio, periodo_mes, regimen)"""


@query("frag_ccaa", with_tables(CCAA_SQL))
def q_frag_ccaa(spark, d):
    return FR.ccaa_fragments(Tables.get(spark, d).avances()).select("id", "text", "fuente")


PRICE_SQL = f"""
SELECT {_safe_id(f"'coy_' || producto || '_' || CAST(anio AS VARCHAR) || '_S' || {_z2('semana')}")} AS id,
  concat_ws('. ',
    'Semana ' || CAST(semana AS VARCHAR) || ' de ' || CAST(anio AS VARCHAR) || ': ' || producto,
    CASE WHEN precio_sem_actual IS NOT NULL THEN 'tiene un precio medio nacional de ' || {_fix('precio_sem_actual', 2)} || ' ' || unidad END,
    CASE WHEN variacion_pct IS NOT NULL THEN 'con una variación semanal del ' || CASE WHEN variacion_pct >= 0 THEN '+' ELSE '' END || {_fix('variacion_pct', 2)} || '%' END,
    CASE WHEN precio_sem_anterior IS NOT NULL THEN '(semana anterior: ' || {_fix('precio_sem_anterior', 2)} || ' ' || unidad || ')' END,
    CASE WHEN categoria IS NOT NULL AND categoria <> '' THEN 'Categoría: ' || lower(categoria) || ', sección: ' || seccion END
  ) || '.' AS text, 'coyuntura' AS fuente, anio, semana, seccion, producto
FROM coyuntura"""


@query("frag_price", with_tables(PRICE_SQL))
def q_frag_price(spark, d):
    f = FR.price_fragments(Tables.get(spark, d).coyuntura())
    return f.select("id", "text", "fuente", F.col("_o0").alias("anio"), F.col("_o1").alias("semana"),
                    F.col("_o2").alias("seccion"), F.col("_o3").alias("producto"))


@query("dedup_first", with_tables(f"""
SELECT id, text, anio, semana, seccion, producto, n_copias FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY anio, semana, seccion, producto, text) AS rn,
         count(*) OVER (PARTITION BY id) AS n_copias
  FROM ({PRICE_SQL})) WHERE rn = 1"""))
def q_dedup_first(spark, d):
    f = FR.price_fragments(Tables.get(spark, d).coyuntura())
    dd = dedup_first(f.select("id", "text", F.col("_o0").alias("anio"), F.col("_o1").alias("semana"),
                              F.col("_o2").alias("seccion"), F.col("_o3").alias("producto")),
                     "id", ["anio", "semana", "seccion", "producto", "text"])
    return dd.select("id", "text", "anio", "semana", "seccion", "producto", "n_copias")


CLIMA_FRAG_SQL = f"""
SELECT {_safe_id(f"'clima_' || CAST(cp.cod_provincia AS VARCHAR) || '_' || CAST(anio AS VARCHAR) || '_' || {_z2('mes')}")} AS id,
  concat_ws('. ',
    'Clima en ' || COALESCE(n.provincia, 'Provincia ' || CAST(cp.cod_provincia AS VARCHAR)) || ' (' || COALESCE(n.ccaa, '')
      || ') en ' || {_mes('mes')} || ' de ' || CAST(anio AS VARCHAR),
    'basado en ' || CAST(n_estaciones AS VARCHAR) || ' estaciones AEMET',
    CASE WHEN t_media_c IS NOT NULL THEN 'Temperatura media: ' || CAST(t_media_c AS VARCHAR) || '°C' END,
    CASE WHEN t_max_abs_c IS NOT NULL THEN 'máxima absoluta: ' || CAST(t_max_abs_c AS VARCHAR) || '°C' END,
    CASE WHEN t_min_abs_c IS NOT NULL THEN 'mínima absoluta: ' || CAST(t_min_abs_c AS VARCHAR) || '°C' END,
    CASE WHEN precip_media_mm IS NOT NULL THEN 'Precipitación media: ' || CAST(precip_media_mm AS VARCHAR) || ' mm' END,
    CASE WHEN horas_sol_med IS NOT NULL THEN 'Horas de sol: ' || CAST(horas_sol_med AS VARCHAR) END
  ) || '.' AS text, 'clima' AS fuente
FROM clima_provincial cp LEFT JOIN (
  SELECT cod_provincia, max_by(provincia, (periodo_anio, periodo_mes, cultivo)) AS provincia,
         max_by(ccaa, (periodo_anio, periodo_mes, cultivo)) AS ccaa
  FROM avances WHERE nivel = 'provincia' AND cod_provincia IS NOT NULL GROUP BY cod_provincia) n
ON cp.cod_provincia = n.cod_provincia"""


@query("frag_climate", with_tables(CLIMA_FRAG_SQL))
def q_frag_climate(spark, d):
    t = Tables.get(spark, d)
    return FR.climate_fragments(t.clima_provincial(), t.avances()).select("id", "text", "fuente")


@query("chunk_words", """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, total_chunks, CAST(s AS INTEGER) AS inicio,
       CAST(least(n - s, 800) AS INTEGER) AS n_palabras,
       md5(array_to_string(w[s + 1 : s + 800], ' ')) AS chunk_md5,
       CAST(length(array_to_string(w[s + 1 : s + 800], ' ')) AS INTEGER) AS n_chars
FROM (
  SELECT doc_id, w, n, CAST((n - 1) // 700 + 1 AS INTEGER) AS total_chunks,
         unnest(range(0, n, 700)) AS s, generate_subscripts(range(0, n, 700), 1) - 1 AS i
  FROM (SELECT doc_id, string_split_regex(trim(text, ' \n\t\r'), '\\s+') AS w,
               len(string_split_regex(trim(text, ' \n\t\r'), '\\s+')) AS n
        FROM documents WHERE regexp_matches(text, '\\S')))
WHERE length(array_to_string(w[s + 1 : s + 800], ' ')) >= 50""")
def q_chunk_words(spark, d):
    docs = Tables.get(spark, d).raw("documents", "doc_id", "text")
    c = FR.chunk_words(docs)
    return c.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "total_chunks", "inicio",
                    "n_palabras", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("n_chars"))


def _z4(c):
    return f"CASE WHEN length(CAST({c} AS VARCHAR)) >= 4 THEN CAST({c} AS VARCHAR) ELSE lpad(CAST({c} AS VARCHAR), 4, '0') END"


DOC_FRAG_SQL = f"""
SELECT {_safe_id(f"'pdf_' || CAST(doc_id AS VARCHAR) || '_' || {_z4('i')}")} AS id, chunk AS text, 'pdf' AS fuente
FROM (
  SELECT doc_id, i, array_to_string(w[s + 1 : s + 800], ' ') AS chunk
  FROM (
    SELECT doc_id, w, n, unnest(range(0, n, 700)) AS s, generate_subscripts(range(0, n, 700), 1) - 1 AS i
    FROM (SELECT doc_id, string_split_regex(trim(text, ' \n\t\r'), '\\s+') AS w,
                 len(string_split_regex(trim(text, ' \n\t\r'), '\\s+')) AS n
          FROM documents WHERE regexp_matches(text, '\\S'))))
WHERE length(chunk) >= 50"""


@query("doc_fragments", DOC_FRAG_SQL)
def q_doc_fragments(spark, d):
    docs = Tables.get(spark, d).raw("documents", "doc_id", "text", "source")
    return FR.document_fragments(docs).select("id", "text", "fuente")


def _knn_sql(metric: str) -> str:
    if metric == "l2":
        dist = "list_sum(list_transform(list_zip(e.embedding, q.query_vec), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"
    else:
        dist = ("1.0 - list_sum(list_transform(list_zip(e.embedding, q.query_vec), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / "
                "(sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * "
                "sqrt(list_sum(list_transform(q.query_vec, lambda x: x * x))))")
    return f"""
WITH ex AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
per AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM ex GROUP BY label, pos),
q AS (SELECT label AS query_id, list(m ORDER BY pos) AS query_vec FROM per GROUP BY label),
sc AS (SELECT q.query_id, e.vec_id, {dist} AS distance FROM embeddings e, q)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {R('distance', 9)} AS distance,
       {R('(1.0 - distance) * 100', 1)} AS relevancia
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM sc)
WHERE rank <= 5"""


def _knn(metric):
    def run(spark, d):
        emb = Tables.get(spark, d).raw("embeddings", "vec_id", "embedding", "label")
        return knn(label_centroids(emb), emb, k=5, metric=metric)
    return run


query("knn_l2", _knn_sql("l2"))(_knn("l2"))
query("knn_cosine", _knn_sql("cosine"))(_knn("cosine"))


def _lsh(spark, d):
    importable(spark)
    emb = Tables.get(spark, d).raw("embeddings", "vec_id", "embedding", "label")
    # Every 50th vector asks, beside the mean of each label.
    asked = label_centroids(emb).select(F.col("query_id").cast("long").alias("query_id"), "query_vec").unionByName(
        emb.where("vec_id % 50 = 0").select((F.col("vec_id") + 1000).alias("query_id"), F.transform(
            "embedding", lambda x: x.cast("double")).alias("query_vec")))
    return asked, emb


@query("knn_lsh")
def q_knn_lsh(spark, d):
    asked, emb = _lsh(spark, d)
    return V.knn_lsh(asked, emb, V.Projections(64), metric="cosine")


@query("knn_lsh_recall", """
SELECT CAST((SELECT count(DISTINCT label) FROM embeddings) + (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS BIGINT)
         AS n_consultas, TRUE AS recall_suficiente""")
def q_knn_lsh_recall(spark, d):
    asked, emb = _lsh(spark, d)
    r = V.recall(V.knn_lsh(asked, emb, V.Projections(64), metric="cosine"), knn(asked, emb, metric="cosine"))
    return r.select("n_consultas", (F.col("recall") >= 0.9).alias("recall_suficiente"))


@query("knn_context", f"""
SELECT k.query_id, k.rank, k.vec_id, k.relevancia,
       '[' || CASE WHEN coalesce(d.source, '') = '' THEN '?' ELSE d.source END
           || CASE WHEN coalesce(d.lang, '') = '' THEN '' ELSE '|' || d.lang END
           || '|rel:' || format('{{:.1f}}', k.relevancia) || '%]' AS etiqueta,
       d.source, d.lang, md5(d.text) AS texto_md5
FROM ({_knn_sql("cosine")}) k JOIN documents d ON d.doc_id = k.vec_id""")
def q_knn_context(spark, d):
    t = Tables.get(spark, d)
    emb = t.raw("embeddings", "vec_id", "embedding", "label")
    store = V.write_text_store(t.raw("documents", "doc_id", "text", "source", "lang"), t.scratch("text_store"), "doc_id")
    top = knn(label_centroids(emb), emb, k=5, metric="cosine")
    found = V.retrieve(top, store, "vec_id", "doc_id", "text", ["source", "lang"])
    return found.select("query_id", "rank", "vec_id", "relevancia", "etiqueta", "source", "lang",
                        F.md5("texto").alias("texto_md5"))


@query("fragment_filter", with_tables(f"""
SELECT id, text, fuente, cultivo, periodo_anio AS anio, periodo_mes AS mes FROM ({NAT_SQL})
WHERE cultivo = 'SMALL' AND periodo_anio = 1998"""))
def q_fragment_filter(spark, d):
    t = Tables.get(spark, d)
    store = FR.write_typed_store(all_fragments(t), t.scratch("typed_store"))
    hit = FR.filter_fragments(store, {"fuente": "avances", "nivel": "nacional", "cultivo": "SMALL", "anio": 1998})
    return hit.select("id", "text", "fuente", "cultivo", "anio", "mes")


@query("fragment_counts", with_tables(f"""
SELECT fuente, count(*) AS n_fragmentos, count(DISTINCT id) AS n_ids FROM (
  SELECT id, fuente FROM ({NAT_SQL}) UNION ALL SELECT id, fuente FROM ({CCAA_SQL})
  UNION ALL SELECT id, fuente FROM ({PRICE_SQL}) UNION ALL SELECT id, fuente FROM ({CLIMA_FRAG_SQL})
  UNION ALL SELECT id, fuente FROM ({DOC_FRAG_SQL}))
GROUP BY fuente"""))
def q_fragment_counts(spark, d):
    return FR.fragment_counts(all_fragments(Tables.get(spark, d)))


def all_fragments(t: Tables):
    parts = [FR.national_fragments(t.avances()), FR.ccaa_fragments(t.avances()),
             FR.price_fragments(t.coyuntura()), FR.climate_fragments(t.clima_provincial(), t.avances()),
             FR.document_fragments(t.raw("documents", "doc_id", "text", "source"))]
    out = parts[0].select("id", "text", "fuente", "metadata")
    for p in parts[1:]:
        out = out.unionByName(p.select("id", "text", "fuente", "metadata"))
    return out


# --------------------------------------------------------------- entities
def _entities_sql() -> str:
    p = fold_sql("pregunta")

    def chain(pairs):
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"
    ccaa = chain([(f"contains({p}, '{k}')", f"'{v}'") for k, v in dims.CHAT_CCAA.items()])
    provs = sorted(dims.CHAT_PROVINCE_CODE, key=len, reverse=True)
    prov = chain([(f"regexp_matches({p}, '\\b{k}\\b')", f"'{k}'") for k in provs])
    cod = chain([(f"regexp_matches({p}, '\\b{k}\\b')", f"'{dims.CHAT_PROVINCE_CODE[k]}'") for k in provs])
    rank = " OR ".join(f"contains({p}, '{w}')" for w in dims.CHAT_RANKING_WORDS)
    crops = sorted(dims.CHAT_CROPS, key=len, reverse=True)
    crop = chain([(f"contains({p}, '{c}')", f"'{c.upper()}'") for c in crops])
    months = ", ".join(f"{{'pos': instr({p}, '{m}'), 'mes': {n}}}" for m, n in dims.MONTHS.items())
    return with_tables(f"""
SELECT q_id, pregunta,
  CASE WHEN geo AND cultivo IS NOT NULL THEN cultivo END AS cultivo,
  CASE WHEN geo AND cultivo IS NOT NULL THEN a0 END AS anio_ini,
  CASE WHEN geo AND cultivo IS NOT NULL THEN a1 END AS anio_fin,
  CASE WHEN geo AND cultivo IS NOT NULL THEN m0 END AS mes_ini,
  CASE WHEN geo AND cultivo IS NOT NULL THEN m1 END AS mes_fin,
  CASE WHEN geo AND cultivo IS NOT NULL THEN ccaa END AS ccaa,
  CASE WHEN geo AND cultivo IS NOT NULL THEN provincia END AS provincia,
  CASE WHEN geo AND cultivo IS NOT NULL THEN cod_provincia END AS cod_provincia,
  CASE WHEN geo AND cultivo IS NOT NULL THEN es_ranking END AS es_ranking,
  CASE WHEN geo AND cultivo IS NOT NULL THEN m0 > m1 AND a0 < a1 END AS cruza_anio
FROM (
  SELECT *, contains(p, 'provincia') OR ccaa IS NOT NULL OR cod_provincia IS NOT NULL OR es_ranking AS geo,
         COALESCE(list_min(ys), 2023) AS a0, COALESCE(list_max(ys), COALESCE(list_min(ys), 2023)) AS a1,
         COALESCE(ms[1].mes, 1) AS m0, COALESCE(ms[-1].mes, 12) AS m1
  FROM (
    SELECT q_id, pregunta, {p} AS p, {ccaa} AS ccaa, {prov} AS provincia, {cod} AS cod_provincia,
           ({rank}) AS es_ranking, {crop} AS cultivo,
           list_transform(regexp_extract_all(pregunta, '(20\\d{{2}})', 1), lambda y: CAST(y AS INTEGER)) AS ys,
           list_sort(list_filter([{months}], lambda s: s.pos > 0)) AS ms
    FROM raw_questions))""")


CTX_COLS = ["cultivo", "anio_ini", "anio_fin", "mes_ini", "mes_fin", "ccaa", "provincia", "cod_provincia",
            "es_ranking", "cruza_anio"]


@query("extract_entities", _entities_sql())
def q_extract_entities(spark, d):
    qs = TB.raw_questions(Tables.get(spark, d))
    out = extract_context(qs, "pregunta")
    return out.select("q_id", "pregunta", *[F.col("ctx")[c].alias(c) for c in CTX_COLS])
