"""Model queries: split, OLS metrics and attributions (O), boosted trees and
exact Shapley attributions (rows-only)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import model as M
from ..session import scratch_path
from ..sources.tables import Tables
from . import datasets as DS
from . import oracle_datasets as OD
from .oracle import R, with_tables
from .registry import query

LI_FEATURES = ["l_quantity", "l_discount"]
LI_TARGET = "l_extendedprice"


def _bucket_sql(keys: list[str], seed: int = 42) -> str:
    s = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f" || '|{seed}'"
    return f"(('0x' || substr(md5({s}), 1, 8))::BIGINT % 100)"


def _split_sql(keys):
    b = _bucket_sql(keys)
    return f"CASE WHEN {b} < 15 THEN 'test' WHEN {b} < 30 THEN 'val' ELSE 'train' END"


V3_KEYS = ["cultivo", "cod_provincia", "anio", "mes"]


@query("hash_split", with_tables(f"SELECT cultivo, cod_provincia, anio, mes, {_split_sql(V3_KEYS)} AS split FROM v3",
                                 OD.v3_ctes()))
def q_hash_split(spark, d):
    v3 = DS.DatasetBuilder(Tables.get(spark, d)).v3()
    return M.hash_split(v3, V3_KEYS).select(*V3_KEYS, "split")


_LI_KEYS = ["l_orderkey", "l_linenumber"]
_OLS_CTES = f"""
li AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount, l_extendedprice,
              {_split_sql(_LI_KEYS)} AS split FROM lineitem),
st AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
              covar_samp(l_quantity, l_quantity) AS c11, covar_samp(l_quantity, l_discount) AS c12,
              covar_samp(l_discount, l_discount) AS c22, covar_samp(l_quantity, l_extendedprice) AS c1y,
              covar_samp(l_discount, l_extendedprice) AS c2y FROM li WHERE split = 'train'),
cf AS (SELECT m1, m2, my, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1,
              (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM st),
attr AS (SELECT li.*, {R("b1 * (l_quantity - m1)", 4)} AS shap_l_quantity,
                {R("b2 * (l_discount - m2)", 4)} AS shap_l_discount,
                (my - b1 * m1 - b2 * m2) + b1 * l_quantity + b2 * l_discount AS pred
         FROM li, cf)"""


def _li(spark, d):
    li = Tables.get(spark, d).raw("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *LI_FEATURES, LI_TARGET)
    return M.hash_split(li, _LI_KEYS)


def _ols(spark, d):
    li = _li(spark, d)
    model = M.fit_ols(li.filter(F.col("split") == "train"), LI_FEATURES, LI_TARGET)
    return li, model


@query("regression_metrics", f"""WITH {_OLS_CTES}
SELECT split, count(*) AS n,
       {R("1.0 - sum((l_extendedprice - pred) * (l_extendedprice - pred)) / (var_pop(l_extendedprice) * count(*))", 4)} AS r2,
       {R("sqrt(sum((l_extendedprice - pred) * (l_extendedprice - pred)) / count(*))", 6)} AS rmse,
       {R("avg(abs(l_extendedprice - pred))", 6)} AS mae
FROM attr GROUP BY split""")
def q_regression_metrics(spark, d):
    li, model = _ols(spark, d)
    return M.regression_metrics(li.withColumn("pred", model.predict()), LI_TARGET, "pred")


_METRICS_SQL = f"""
SELECT split, {R("1.0 - sum((l_extendedprice - pred) * (l_extendedprice - pred)) / (var_pop(l_extendedprice) * count(*))", 4)} AS r2
FROM attr GROUP BY split"""


@query("r2_gap", f"""WITH {_OLS_CTES}, m AS ({_METRICS_SQL})
SELECT tr.r2 AS r2_train, te.r2 AS r2_test, {R("tr.r2 - te.r2", 4)} AS gap_r2, {R("tr.r2 - te.r2", 4)} > 0.15 AS sobreajuste
FROM (SELECT r2 FROM m WHERE split = 'train') tr, (SELECT r2 FROM m WHERE split = 'test') te""")
def q_r2_gap(spark, d):
    li, model = _ols(spark, d)
    return M.r2_gap(M.regression_metrics(li.withColumn("pred", model.predict()), LI_TARGET, "pred"))


@query("attribution_linear", f"""WITH {_OLS_CTES}
SELECT l_orderkey, l_linenumber, shap_l_quantity, shap_l_discount FROM attr""")
def q_attribution_linear(spark, d):
    li, model = _ols(spark, d)
    return M.linear_attribution(li, model).select(*_LI_KEYS, "shap_l_quantity", "shap_l_discount")


@query("shap_summary", f"""WITH {_OLS_CTES}
SELECT feature, {R("avg(abs(v))", 6)} AS shap_mean_abs, {R("avg(v)", 6)} AS shap_mean, {R("stddev_pop(v)", 6)} AS shap_std
FROM (SELECT 'l_quantity' AS feature, shap_l_quantity AS v FROM attr
      UNION ALL SELECT 'l_discount', shap_l_discount FROM attr)
GROUP BY feature ORDER BY shap_mean_abs DESC, feature""")
def q_shap_summary(spark, d):
    li, model = _ols(spark, d)
    return M.attribution_summary(M.linear_attribution(li, model), LI_FEATURES)


@query("shap_by_group", f"""WITH {_OLS_CTES}
SELECT l_returnflag, feature, {R("avg(v)", 6)} AS shap_media
FROM (SELECT l_returnflag, 'l_quantity' AS feature, shap_l_quantity AS v FROM attr
      UNION ALL SELECT l_returnflag, 'l_discount', shap_l_discount FROM attr)
GROUP BY l_returnflag, feature""")
def q_shap_by_group(spark, d):
    li, model = _ols(spark, d)
    return M.attribution_by_group(M.linear_attribution(li, model), LI_FEATURES, "l_returnflag")


# ------------------------------------------------------------ boosted trees
def _v3_split(spark, d):
    return M.hash_split(DS.DatasetBuilder(Tables.get(spark, d)).v3(), V3_KEYS)


_GBT: dict[tuple, str] = {}


def gbt(spark, d, params: B.BoostParams = B.BoostParams()):
    """The split and the model of a data folder: trained once, saved, and read from then on."""
    key = (spark.sparkContext.applicationId, d, str(params))
    if key not in _GBT:
        path = scratch_path(spark, f"gbt-{uuid.uuid4().hex[:12]}")
        _v3_split(spark, d).write.parquet(f"{path}/rows")  # read by several passes
        B.fit(spark.read.parquet(f"{path}/rows"), DS.FEATURES, DS.TARGET, params).save(spark, f"{path}/model")
        _GBT[key] = path
    return spark.read.parquet(f"{_GBT[key]}/rows"), B.BoostedTrees.load(spark, f"{_GBT[key]}/model")


@query("train_gbt")
def q_train_gbt(spark, d):
    data, model = gbt(spark, d)
    return M.regression_metrics(data.withColumn("prediction", model.prediction()), DS.TARGET, "prediction").withColumns(
        {"n_trees": F.lit(model.n_trees), "rounds": F.lit(len(model.losses)),
         "best_rmse": F.lit(min(model.losses, default=None)).cast("double")})


@query("predict_gbt")
def q_predict_gbt(spark, d):
    data, model = gbt(spark, d)
    return data.select(*V3_KEYS, "split", DS.TARGET, model.prediction().alias("prediccion"))


@query("attribution_gbt")
def q_attribution_gbt(spark, d):
    data, model = gbt(spark, d)
    means = data.filter(F.col("split") == "train").agg(*[F.avg(f).alias(f) for f in DS.FEATURES]).first().asDict()
    rows = data.withColumn("row_id", F.concat_ws("|", *[F.col(k).cast("string") for k in V3_KEYS]))
    # attributions of the test split, with the metadata the dashboard shows
    meta = ["cultivo", "provincia", "ccaa", "cod_provincia", "anio", "mes", "rendimiento", "rendimiento_raw"]
    out = model.attribute(rows.filter(F.col("split") == "test"), means)
    return out.select("row_id", *meta, *[f"shap_{f}" for f in DS.FEATURES], "prediccion", "prediccion_base")


@query("attribution_additivity", with_tables(
    f"SELECT cultivo, cod_provincia, anio, mes, TRUE AS aditiva FROM (SELECT *, {_split_sql(V3_KEYS)} AS split FROM v3) "
    "WHERE split = 'test'", OD.v3_ctes()))
def q_attribution_additivity(spark, d):
    attr = q_attribution_gbt(spark, d)
    total = sum((F.col(f"shap_{f}") for f in DS.FEATURES), F.col("prediccion_base"))
    return attr.select(*V3_KEYS, (F.abs(total - F.col("prediccion")) < 1e-9).alias("aditiva"))
