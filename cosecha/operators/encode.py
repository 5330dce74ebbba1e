"""Dense label encoding.

Codes are the 0-based rank of the value in the sorted distinct set, NULL
encoded as "DESCONOCIDO" (the reference's fill value).  Only distinct values
are ranked, never fact rows: they are range-partitioned, numbered inside each
partition, and shifted by the sizes of the partitions before them, so no task
sees all of them.  All columns are ranked together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

UNKNOWN = "DESCONOCIDO"


def mappings(df: DataFrame, cols: list[str]) -> DataFrame:
    """(columna, clase, codigo) of every encoding (the JSON export); codes are long."""
    checkpoint_dir(df.sparkSession)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.coalesce(
        F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN)).alias("clase")) for c in cols])).alias("x")
    values = df.select(cells).select("x.*").distinct()
    # Written once: a range partitioning is sampled, so a second run might cut elsewhere.
    local = (values.repartitionByRange("columna", "clase").withColumn("part", F.spark_partition_id())
             .withColumn("place", F.row_number().over(Window.partitionBy("part", "columna").orderBy("clase")) - 1)
             .checkpoint(eager=True))
    sizes = local.groupBy("columna", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("columna").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before, ["columna", "part"]).select("columna", "clase",
                                                          (F.col("before") + F.col("place")).alias("codigo"))


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_enc") -> DataFrame:
    """``df`` with a code ``<col><suffix>`` for each of ``cols``."""
    codes = mappings(df, cols)

    def coded(out: DataFrame, c: str) -> DataFrame:
        own = codes.where(F.col("columna") == c).select(F.col("clase").alias(f"_k_{c}"),
                                                        F.col("codigo").alias(f"{c}{suffix}"))
        return out.join(own, F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) == F.col(f"_k_{c}"),
                        "left").drop(f"_k_{c}")

    return reduce(coded, cols, df)
