"""Period re-delivery as a stream.

A delivery is a folder of Parquet files and a manifest row that names it and
its version.  A stream reads the manifests in the order of their arrival, and
``foreachBatch`` replaces the periods that the deliveries contain in the
partitioned store (dynamic partition overwrite).  A commit log keeps, for each
batch, the version that each of its periods came from:

* a batch whose id is in the log is skipped, so a replay does nothing;
* a period is replaced only by a higher version than the log has for it, so
  an older delivery that arrives late cannot undo a newer one;
* the log entry follows the data: a batch that failed in between runs again
  and rewrites the same partitions with the same rows.

Store, log and checkpoint lie in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.landing import replace_partitions

MANIFEST = "carpeta string, version long"


def deliver(df: DataFrame, landing: str, version: int) -> None:
    """Land one delivery: its rows by as many tasks as they have, then its manifest."""
    folder = f"{landing}/entregas/{version:012d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(folder)
    df.sparkSession.createDataFrame([(folder, version)], MANIFEST).coalesce(1).write.mode("append").parquet(
        f"{landing}/manifiestos")


def _logged(spark: SparkSession, log: str, keys: list[str], schema) -> DataFrame:
    """The commit log: batch, the keys of a period and the version it came from."""
    fields = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{fields}, version long, lote long")
    return spark.read.schema(f"{fields}, version long, lote long").parquet(log)


def apply_batch(batch: DataFrame, batch_id: int, store: str, log: str, keys: list[str], schema) -> str:
    """Apply the deliveries that a batch of manifests names; says what was done."""
    spark = batch.sparkSession
    logged = _logged(spark, log, keys, schema)
    if logged.where(F.col("lote") == batch_id).limit(1).count():
        return "repetido"
    manifests = batch.collect()  # one small row a delivery
    rows = None
    for m in manifests:
        part = spark.read.schema(schema).parquet(m.carpeta).withColumn("version", F.lit(m.version).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return "vacio"
    newest = rows.groupBy(*keys).agg(F.max("version").alias("_v"))
    held = logged.groupBy(*keys).agg(F.max("version").alias("_held"))
    same = lambda a, b: [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys]
    wanted = (newest.alias("n").join(held.alias("h"), same("n", "h"), "left")
              .where(F.col("_held").isNull() | (F.col("_v") > F.col("_held"))).select("n.*"))
    won = (rows.alias("r").join(wanted.alias("n"), [*same("r", "n"), F.col("r.version") == F.col("n._v")])
           .select("r.*"))
    if won.limit(1).count():
        replace_partitions(spark, won, store, keys)
    # Written last and under the batch's own name: running it again replaces it.
    (wanted.select(*keys, F.col("_v").alias("version"), F.lit(batch_id).cast("long").alias("lote"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(log))
    return "aplicado"


def run_redelivery_stream(spark: SparkSession, landing: str, store: str, checkpoint: str,
                          keys: list[str], schema, files_per_batch: int = 1) -> DataFrame:
    """Process every landed delivery (``availableNow``) and return the store."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, store, f"{store}_log", keys, schema)

    stream = (spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files_per_batch)
              .parquet(f"{landing}/manifiestos"))
    q = (stream.writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(store)


def period_deliveries(avances: DataFrame, corrected_year: int, parts: int = 4) -> list[tuple[int, DataFrame]]:
    """The panel as (version, delivery): its years dealt to ``parts`` deliveries, a corrected one of
    ``corrected_year`` (areas doubled), and the same year once more as it was, an older version that comes late."""
    year = F.col("periodo_anio")
    out = [(i + 1, avances.filter(F.pmod(year, F.lit(parts)) == i)) for i in range(parts)]
    wrong = avances.filter(year == corrected_year)
    out.append((parts + 2, wrong.withColumn("sup_avance", F.col("sup_avance") * 2)))
    out.append((parts + 1, wrong.withColumn("sup_avance", F.col("sup_avance") * 3)))
    return out
