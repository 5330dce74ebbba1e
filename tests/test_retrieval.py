"""Approximate search against the exact one, late fetching of texts, and metadata filters that prune."""

import random

import numpy as np
from pyspark.sql import functions as F

from cosecha.operators import fragments as FR
from cosecha.operators import vector as V
from cosecha.session import importable


def plan_of(df):
    return df._jdf.queryExecution().toString()


def vectors(n=600, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return [(i, (centres[i % 12] + 0.4 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_lsh_recall_and_exact_distances(spark):
    importable(spark)
    data = vectors()
    emb = spark.createDataFrame(data + [(9_001, None), (9_002, [1.0])], "vec_id long, embedding array<double>")
    asked = emb.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    emb = emb.where("embedding is not null and size(embedding) = 16 or vec_id > 9000")
    exact = V.knn(asked, emb.where("vec_id < 9000"), k=5, metric="cosine")
    found = V.knn_lsh(asked, emb, V.Projections(16, tables=12, bits=6), k=5, metric="cosine").cache()
    r = V.recall(found, exact).first()
    assert r.n_consultas == 60 and r.esperados == 300 and r.recall >= 0.9
    true = {(x.query_id, x.vec_id): x.distance for x in V.knn(asked, emb.where("vec_id < 9000"), k=600,
                                                              metric="cosine").collect()}
    for x in found.collect():
        assert true[x.query_id, x.vec_id] == x.distance
    few = V.knn_lsh(asked, emb, V.Projections(16, tables=1, bits=10), k=5, metric="cosine")
    assert V.recall(few, exact).first().recall < r.recall  # a single table misses more


def test_knn_blocks_do_not_matter(spark):
    emb = spark.createDataFrame(vectors(200), "vec_id long, embedding array<double>")
    asked = emb.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    want = {(i, r, j) for i, r, j, *_ in V.knn(asked, emb, blocks=1).collect()}
    assert want == {(i, r, j) for i, r, j, *_ in V.knn(asked, emb, blocks=50).collect()} and len(want) == 35


def test_blocks_send_on_only_what_can_be_nearest(spark):
    """Pairs that can't be among the nearest never become rows; the ranks are those of all pairs."""
    data = vectors(1500)
    odd = [(None, data[0][1]), (5_000, None), (5_001, [0.0] * 16), (5_002, [1.0]), (5_003, [None] + [1.0] * 15),
           (7, data[7][1]), (5_004, [float("nan")] * 16)]
    odd += [(6_000 + i, data[20][1]) for i in range(900)]  # copies
    emb = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i % 35, data[i][1]) for i in range(40)] + [(900, [0.0] * 16), (901, None)],
                                  "query_id long, query_vec array<double>")
    cands = emb.select(F.col("vec_id").alias("cand_id"), F.col("embedding").alias("cand_vec"))
    for metric in ("l2", "cosine"):
        every = cands.crossJoin(asked).select("query_id", "cand_id", V._distance(metric).alias("distance"),
                                              F.lit(0).alias("_blk"))
        want = sorted(map(repr, V._top(every, 5, "vec_id").collect()))
        for blocks in (1, 9):
            assert sorted(map(repr, V.knn(asked, emb, 5, metric, blocks=blocks).collect())) == want
        one = F.lit(0).alias("b")
        sent = V._in_blocks(cands.select("*", one), asked.select("*", one), ["b"], 5, metric).count()
        assert sent <= 42 * 20  # of 101 178 pairs


def test_retrieve_reads_only_blocks_of_found_ids(spark, tmp_path):
    rows = [(i, f"text {i}", "web" if i % 2 else None, "" if i % 3 else "es") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    store = V.write_text_store(docs, str(tmp_path / "s"), "doc_id", blocks=64)
    top = spark.createDataFrame([(1, 1, 6, 12.34), (1, 2, 7, -5.0), (2, 1, 6, 99.96)],
                                "query_id int, rank int, vec_id long, relevancia double")
    found = V.retrieve(top, store, "vec_id", "doc_id", "text", ["source", "lang"], blocks=64)
    assert "dynamicpruning" in plan_of(found).lower()
    got = sorted((r.query_id, r.rank, r.etiqueta, r.texto) for r in found.collect())
    assert got == [(1, 1, "[?|es|rel:12.3%]", "text 6"), (1, 2, "[web|rel:-5.0%]", "text 7"),
                   (2, 1, "[?|es|rel:100.0%]", "text 6")]


def test_metadata_filter_is_pushed(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"id{i}", f"t{i}", rnd.choice(["avances", "coyuntura"]),
             {"cultivo": rnd.choice(["TRIGO", "MAÍZ", ""]), "anio": str(1990 + i % 9), "mes": "x"}) for i in range(500)]
    frags = spark.createDataFrame(rows, "id string, text string, fuente string, metadata map<string,string>")
    store = FR.write_typed_store(frags, str(tmp_path / "store"))
    hit = FR.filter_fragments(store, {"fuente": "avances", "cultivo": "TRIGO", "anio": 1993})
    plan = plan_of(hit)
    assert "EqualTo(cultivo,TRIGO)" in plan and "EqualTo(anio,1993)" in plan
    assert "PartitionFilters: [isnotnull(fuente" in plan
    want = {r[0] for r in rows if r[2] == "avances" and r[3]["cultivo"] == "TRIGO" and r[3]["anio"] == "1993"}
    assert {r.id for r in hit.collect()} == want and want
    assert store.where("mes is not null").count() == 0
    assert store.where("cultivo is null").count() == sum(r[3]["cultivo"] == "" for r in rows)
    try:
        FR.filter_fragments(store, {"autor": "x"})
    except ValueError as e:
        assert "autor" in str(e)
    else:
        raise AssertionError("an unknown column must be refused")
