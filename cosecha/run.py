"""Command-line batch run: the reference's regeneration order as Spark jobs.

usage: python -m cosecha.run --sf-dir /root/testdata/sf0.1 [--out DIR] [--steps etl,validate,...]

Steps (each writes versioned outputs under ``--out``, never modifying inputs):

* ``etl``        domain tables derived from the input tables
* ``validate``   validated panel (negatives → NULL, IQR flag), quality report,
                 dataset v1 and its label codes
* ``process``    climate limits + median imputation, dataset v2, label codes
* ``finalize``   hierarchical imputation → dataset v3, readiness profile
* ``train``      boosted trees on v3 with a hash split, metrics per split,
                 exact Shapley attributions and their summaries
* ``fragments``  text fragment store partitioned by source

``--out`` defaults to a folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from .operators import boosting as B
from .operators import model as M
from .operators.encode import mappings
from .operators.quality import dataset_profile, quality_report
from .plans import datasets as DS
from .session import build_session, scratch_path
from .sources.landing import replace_partitions, report_json
from .sources.tables import Tables

STEPS = ["etl", "validate", "process", "finalize", "train", "fragments"]


def run(spark, sf_dir: str, out: str, steps: list[str], shapley: bool = True) -> dict[str, float]:
    t = Tables.get(spark, sf_dir)
    b = DS.DatasetBuilder(t)
    times: dict[str, float] = {}

    def write(df, name, fmt="parquet", **opts):
        w = df.write.mode("overwrite")
        for k, v in opts.items():
            w = w.option(k, v)
        getattr(w, fmt)(f"{out}/{name}")

    for step in steps:
        t0 = time.time()
        if step == "etl":
            t.materialize()
        elif step == "validate":
            write(b.av_valid(), "clean/avances_validado")
            q = quality_report(t.avances(), t.coyuntura(), t.clima_mensual())
            wide = (q.withColumn("k", F.concat_ws("__", "tabla", "metrica"))
                    .groupBy().pivot("k").agg(F.first("valor")))
            write(report_json(wide), "reports/calidad", "text")
            v1 = b.v1()
            write(v1, "model/dataset_modelado")
            write(mappings(v1, DS.ENCODED), "model/label_encoders_v1", "json")
        elif step == "process":
            write(b.clima_prov_v2(), "clean/clima_provincial")
            v2 = b.v2()
            write(v2, "model/dataset_modelado_limpio")
            write(mappings(v2, DS.ENCODED), "model/label_encoders", "json")
        elif step == "finalize":
            v3 = b.v3()
            write(v3, "model/dataset_final")
            write(report_json(dataset_profile(v3, DS.FEATURES, DS.TARGET)), "reports/final", "text")
        elif step == "train":
            data = M.hash_split(spark.read.parquet(f"{out}/model/dataset_final"),
                                ["cultivo", "cod_provincia", "anio", "mes"]).cache()
            model = B.fit(data, DS.FEATURES, DS.TARGET)
            model.save(spark, f"{out}/model/gbt")
            write(data.withColumn("prediction", model.prediction()), "model/predictions")
            pred = spark.read.parquet(f"{out}/model/predictions")
            write(M.regression_metrics(pred, DS.TARGET, "prediction"), "model/metrics", "json")
            if shapley:
                base = data.filter(F.col("split") == "train").agg(
                    *[F.avg(f).alias(f) for f in DS.FEATURES]).first().asDict()
                rows = data.withColumn("row_id", F.concat_ws("|", "cultivo", "cod_provincia", "anio", "mes"))
                write(model.attribute(rows, base).select("row_id", *[f"shap_{f}" for f in DS.FEATURES],
                                                         "prediccion", "prediccion_base"), "model/shap_values")
                attr = spark.read.parquet(f"{out}/model/shap_values")
                write(M.attribution_summary(attr, DS.FEATURES), "model/shap_summary", "json")
            data.unpersist()
        elif step == "fragments":
            from .plans.q_text import all_fragments
            replace_partitions(spark, all_fragments(t), f"{out}/fragments", ["fuente"])
        else:
            raise ValueError(f"unknown step {step!r}; steps: {STEPS}")
        times[step] = round(time.time() - t0, 3)
    return times


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", default=None)
    ap.add_argument("--steps", default=",".join(STEPS))
    ap.add_argument("--master", default=None)
    ap.add_argument("--no-shapley", action="store_true")
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    out = a.out or scratch_path(spark, "run", time.strftime("%Y%m%d-%H%M%S"))
    print(run(spark, a.sf_dir, out, a.steps.split(","), shapley=not a.no_shapley), out)


if __name__ == "__main__":
    main()
