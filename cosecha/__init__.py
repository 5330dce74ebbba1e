"""cosecha — Spark-native analytics for territorial agricultural statistics.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` expressions, joins, aggregates and windows, so
Catalyst can push filters into the Parquet scans, prune columns and let AQE
size the shuffles at run time.
"""

__version__ = "0.1.0"
