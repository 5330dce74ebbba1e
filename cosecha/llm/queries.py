"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, jaccard_join, line_dedup, mtree, packing, pitman_yor, repair, rollups, run_index,
               sharding, simhash, toxicity, variants)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree_search": lambda spark, d: mtree.report(table(spark, d, "embeddings")),
    "op2_decontaminate": lambda spark, d: decontaminate.report(table(spark, d, "documents"),
                                                               table(spark, d, "benchmark")),
    "op3_nnls_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op4_partenum_join": lambda spark, d: jaccard_join.report(table(spark, d, "documents")),
    "op5_token_rollups": lambda spark, d: rollups.report(table(spark, d, "documents")),
    "op6_line_dedup": lambda spark, d: line_dedup.report(table(spark, d, "documents")),
    "op7_byte_shards": lambda spark, d: sharding.byte_shards(table(spark, d, "documents")),
    "op8_toxicity": lambda spark, d: toxicity.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_run_index_dedup": lambda spark, d: run_index.report(table(spark, d, "documents")),
    "op10_pitman_yor": lambda spark, d: pitman_yor.report(table(spark, d, "documents")),
    "op11_simhash_covering": lambda spark, d: simhash.report(table(spark, d, "documents")),
    "op12_conversation_repair": lambda spark, d: repair.report(table(spark, d, "conversations")),
    "op13_spelling_variants": lambda spark, d: variants.report(table(spark, d, "documents")),
}

ORACLE: dict[str, str] = {
    "op1_mtree_search": mtree.ORACLE_SQL,
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op4_partenum_join": jaccard_join.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op7_byte_shards": sharding.ORACLE_SQL,
    "op11_simhash_covering": simhash.ORACLE_SQL,
    "op12_conversation_repair": repair.ORACLE_SQL,
    "op13_spelling_variants": variants.ORACLE_SQL,
}
