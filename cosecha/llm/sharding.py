"""Contiguous, byte-balanced shards from global prefix sums (native operator).

Rows are range-partitioned by ``doc_id``; each partition's byte and row totals
(a table of as many rows as partitions) give every partition its global
offsets, and a window inside the partition completes each row's prefix sum.
Equal targets then cut the line of bytes: a row belongs to the shard in which
its middle byte lies, so every shard is a contiguous doc_id range and its size
is off the target by less than one row at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

ROW_BYTES = 8


def byte_shards(docs: DataFrame, n_shards: int = 24, partitions: int | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` with its shard and its slot there.

    * ``size``: UTF-8 bytes of the text (null: none) plus 8.
    * Order: ``doc_id`` (nulls first), ties by size and checksum; repeated
      rows are rows of their own.  An empty table gives no rows.
    * ``keep`` names further columns of ``docs`` to carry along; other
      columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("_none")]).alias("_kept"))
    order = ["doc_id", "size", "text_crc32"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the range bounds come from a sample, and the totals must
    # describe the very partitions that the prefix sums run over.
    rows = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "shards")
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_part").agg(F.sum("size").alias("_b"), F.count("*").alias("_r"))
               .select("_part", F.coalesce(F.sum("_b").over(line), F.lit(0)).alias("_bytes_before"),
                       F.coalesce(F.sum("_r").over(line), F.lit(0)).alias("_rows_before"),
                       F.sum("_b").over(Window.partitionBy()).alias("_total")))
    inside = Window.partitionBy("_part").orderBy(*order)
    start = F.col("_bytes_before") + F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (rows.join(F.broadcast(offsets), "_part")  # a row for each partition
              .withColumn("_start", start)
              .withColumn("_at", F.col("_rows_before") + F.row_number().over(inside) - 1)
              .withColumn("shard", F.expr(
                  f"cast(least({n_shards - 1}, ((2 * _start + size) * {n_shards}) div (2 * _total)) as int)")))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_kept.{c}").alias(c) for c in keep if c != "doc_id"])


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """Write the documents as one folder for each shard.

    The folders are named by ``shard``, or, where ``docs`` has such a column,
    by ``shard_`` and so on; all columns of ``docs`` stay.
    """
    folder = fresh(docs, "shard")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))
    shards = byte_shards(whole, n_shards, keep=("whole",))
    (shards.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias(folder))
     .write.partitionBy(folder).parquet(path))


# DuckDB has no crc32: the table of the reflected polynomial 0xEDB88320 is
# built from its rule, and each text's bytes are folded through it.
ORACLE_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
docs AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents),
sized AS (
  SELECT doc_id, strlen(body) + 8 AS size,
    CASE WHEN strlen(body) = 0 THEN 0 ELSE xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(strlen(body)),
        lambda i: ('0x' || substr(hex(encode(body)), (2 * i + 1)::INT, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) END AS text_crc32
  FROM docs, crc_table),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start,
    sum(size) OVER () AS total FROM sized),
cut AS (
  SELECT *, least(23, ((2 * start + size) * 24) // (2 * total))::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot,
  NULL::INT AS grown_shard
FROM cut
"""
