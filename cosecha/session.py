"""SparkSession construction and the shared checkpoint / warehouse folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins and coalesces shuffle
# partitions at run time; skew-join splitting protects the (crop, province)
# and (province, month) keys, which can be very uneven in real data.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "cosecha",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and command-line use.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from
    spark-submit; only local runs get the settings chosen here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_CHOSEN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``, or the application by
    ``setCheckpointDir``; we only choose our own (a fresh scratch folder) when
    neither is set, i.e. in local tests.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or _CHOSEN.get(sc.applicationId) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: cluster jobs never use a "
                               "machine-local temporary folder")
        d = tempfile.mkdtemp(prefix="cosecha-ckpt-")
        _CHOSEN[sc.applicationId] = d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is shipped as usual (``--py-files``); the path
    then names nothing there and does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """Path under the shared checkpoint folder (never a machine-local tmp)."""
    return "/".join([checkpoint_dir(spark), *parts])


def spread(df, min_partitions: int | None = None):
    """Give CPU-heavy row-wise work at least one partition per core.

    A small input (one Parquet row group) is read by a single task; before an
    expensive per-row step such an input is round-robin repartitioned to the
    cluster's default parallelism.  Inputs that already have that many splits
    (any large table) are returned unchanged, so at scale this adds no shuffle.
    Counting the splits behind a shuffle would run it, so such an input is
    judged by the size that the optimiser expects; no job runs here.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName() != "AdaptiveSparkPlan":
        return df.repartition(want) if df.rdd.getNumPartitions() < want else df
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    expected = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return df.repartition(want) if expected < want * split else df
