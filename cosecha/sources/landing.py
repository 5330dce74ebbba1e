"""Landed files: climate JSON (S4, I16, I5), file discovery (S1), Parquet
round trip (S6), table replacement by key (S7-S11), reports (S12), exports
(S13) and quarantine (S16).

Writes go to the shared folder named by ``spark.checkpoint.dir`` (never a
machine-local temp dir).  Replacement by period uses Parquet partitioning with
``partitionOverwriteMode=dynamic``: a delivery rewrites exactly the partitions
it contains, which is the reference's "delete period, insert" made atomic per
partition and idempotent on re-delivery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import float_climate, normalise_climate, py_float

# Weather-service JSON keys → climate columns.
CLIMATE_KEYS = {
    "tm_mes": "t_media", "ta_max": "t_max_abs", "ta_min": "t_min_abs", "tm_max": "t_max_med",
    "tm_min": "t_min_med", "p_mes": "precip_mm", "n_llu": "dias_precip", "sol": "horas_sol", "hr": "hr_media",
}
CLIMATE_JSON_SCHEMA = "fecha string, indicativo string, " + ", ".join(f"{k} string" for k in CLIMATE_KEYS)


# ---------------------------------------------------------------- climate
def land_climate_json(clima_mensual: DataFrame, path: str) -> str:
    """Write station-month rows as the weather service delivers them: one JSON
    array of all-string objects per (station, year) line, decimal commas,
    "Ip" for missing precipitation, plus the annual summary record
    ("YYYY-13")."""
    cm = clima_mensual

    def es(c):
        return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    rec = F.struct(F.concat(F.col("anio").cast("string"), F.lit("-"), F.col("mes").cast("string")).alias("fecha"),
                   F.col("indicativo"),
                   *[(F.when(F.col(v).isNull(), F.lit("Ip")).otherwise(es(v)) if k == "p_mes" else es(v)).alias(k)
                     for k, v in CLIMATE_KEYS.items()])
    annual = F.struct(F.concat(F.col("anio").cast("string"), F.lit("-13")).alias("fecha"), F.col("indicativo"),
                      *[F.lit(None).cast("string").alias(k) for k in CLIMATE_KEYS])
    per_year = (cm.groupBy("indicativo", "anio")
                .agg(F.collect_list(rec).alias("recs"), F.first(annual).alias("anual")))
    lines = per_year.select(F.to_json(F.concat("recs", F.array("anual"))).alias("value"))
    lines.write.mode("overwrite").text(path)
    return path


def read_climate_json(spark: SparkSession, path: str, drop_month_13: bool = True) -> DataFrame:
    """All-string schema (no inference), arrays exploded to one row per
    record, dates split (I16), numbers parsed with the climate rules (I5).
    Month 13 (annual summary) is dropped unless ``drop_month_13=False`` (Q10)."""
    raw = spark.read.schema(CLIMATE_JSON_SCHEMA).json(path)
    df = normalise_climate(raw, "fecha")
    if drop_month_13:
        df = df.filter(F.col("mes").between(1, 12))
    return df.select("indicativo", F.col("anio").cast("int").alias("anio"), F.col("mes").cast("int").alias("mes"),
                     *[float_climate(k).alias(v) for k, v in CLIMATE_KEYS.items()])


# ---------------------------------------------------------------- files
def discover_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Recursive, patterned file listing (S1): path, size, modification time,
    sorted and de-duplicated by path."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime"))
    return df.dropDuplicates(["path"]).orderBy("path")


# ------------------------------------------------------------- replacement
def replace_partitions(spark: SparkSession, delivery: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Overwrite only the partitions present in ``delivery``.

    The delivery is stamped with ``fecha_carga``; rows of other partitions
    stay untouched.  Re-running the same delivery gives the same table.
    """
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    stamped = delivery.withColumn("fecha_carga", F.current_timestamp())
    # REBALANCE by the partition keys: rows of a period go to the same writers,
    # and AQE splits a period that is too big for one task (a hot period never
    # lands in a single writer) and merges the small ones
    stamped.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path)


def replace_by_key(existing: DataFrame, delivery: DataFrame, delete_keys: list[str], pk: list[str]) -> DataFrame:
    """Delete every existing row whose ``delete_keys`` appear in the delivery,
    then append the delivery (S9).

    ``pk`` contains ``delete_keys``, so a kept row can never share its key with
    a delivered one: the delivery alone has to be unique, and reading fails if
    it isn't.
    """
    missing = set(delete_keys) - set(pk)
    if missing:
        raise ValueError(f"the primary key lacks {sorted(missing)}")
    keys = delivery.select(*[F.col(k).alias(f"_{k}") for k in delete_keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in delete_keys]
    kept = existing.join(keys, same, "left_anti")
    return kept.unionByName(assert_unique(delivery.select(*existing.columns), pk))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """A keyed store: one folder (``_cubo``) for each bucket of the hash of ``keys``."""
    spark = df.sparkSession
    (df.withColumn("_cubo", _bucket(keys, buckets)).hint("rebalance", "_cubo").write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("_cubo").parquet(path))
    return spark.read.parquet(path)


def upsert_bucketed(spark: SparkSession, path: str, delivery: DataFrame, delete_keys: list[str], pk: list[str],
                    buckets: int = 64) -> DataFrame:
    """``replace_by_key`` on a keyed store, reading and rewriting only the buckets that the delivery touches.

    The bucket numbers, at most ``buckets`` integers, come to the driver and
    prune the store's folders.  Running a delivery again gives the same store.
    """
    cubo = _bucket(delete_keys, buckets)
    touched = sorted(r[0] for r in delivery.select(cubo).distinct().collect())
    store = spark.read.parquet(path)
    old = store.where(F.col("_cubo").isin(touched)) if touched else store.limit(0)
    new = replace_by_key(old, delivery.withColumn("_cubo", cubo), delete_keys, pk)
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_cubo").parquet(path))
    return spark.read.parquet(path)


def assert_unique(df: DataFrame, pk: list[str]) -> DataFrame:
    """The same rows; reading them fails if two share ``pk`` (NULLs count as equal).

    The check is a filter of the plan itself, so nothing runs twice and no
    caller can forget it.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy(*pk))
    fail = F.raise_error(F.lit(f"clave primaria {pk} duplicada")).cast("boolean")
    return (df.withColumn("_n", rows).filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fail)).drop("_n"))


def write_versioned(df: DataFrame, path: str) -> DataFrame:
    """Full refresh (S10): overwrite the table, read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- reports
def report_json(report: DataFrame) -> DataFrame:
    """One JSON document per report row (S12): ``to_json(struct(*))``."""
    return report.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in report.columns])).alias("json"))


def export_frames(frames: dict[str, DataFrame], root: str, info: dict[str, str] | None = None) -> DataFrame:
    """Write each non-empty named result as a headed CSV folder plus an info
    frame (S13); returns (nombre, filas) of what was written.

    Each frame is computed once: its rows are counted while they are written,
    by as many tasks as it has partitions, and the folder of an empty one is
    removed again.
    """
    spark = next(iter(frames.values())).sparkSession
    written = []
    for name, df in frames.items():
        seen = Observation(f"export_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(
            f"{root}/{name}")
        n = seen.get.get("n", 0)
        if n:
            written.append((name, n))
        else:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    meta = [("exportado", "now")] + sorted((info or {}).items())
    spark.createDataFrame(meta, "clave string, valor string").withColumn(
        "valor", F.when(F.col("clave") == "exportado", F.current_timestamp().cast("string")).otherwise(F.col("valor"))
    ).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/_info")
    return spark.createDataFrame(written, "nombre string, filas long")


def write_isolated(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write good and bad rows of an isolated ingestion in one pass.

    Returns the store, in one folder per ``tipo``, and the run summary: files
    read and failed, sheets read and failed, rows.  The counts are observed
    while the rows are written.
    """
    seen = Observation("ingestion")
    of = lambda tipo, bad: F.count_if(
        (F.col("tipo") == tipo) & (F.col("motivo").isNotNull() if bad else F.col("motivo").isNull()))
    counts = {"archivos_ok": of("archivo", False), "archivos_error": of("archivo", True), "hojas_ok": of("hoja", False),
              "hojas_error": of("hoja", True), "registros": of("registro", False)}
    (rows.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite").partitionBy("tipo")
     .parquet(path))
    spark = rows.sparkSession
    got = seen.get
    summary = spark.createDataFrame([tuple(got[n] for n in counts)], ", ".join(f"{n} long" for n in counts))
    return spark.read.schema(rows.schema).parquet(path), summary


def quarantine_numbers(df: DataFrame, raw: str, null_tokens: tuple[str, ...]) -> DataFrame:
    """Cells that are not a NULL token and do not parse as a number (S16),
    counted by reason; good rows continue, bad rows are kept for review."""
    s = F.regexp_replace(F.col(raw), r"^\s+|\s+$", "")
    token = s.isin(*null_tokens)
    parsed = py_float(F.replace(s, F.lit(","), F.lit(".")))
    motivo = (F.when(token, F.lit("token_nulo"))
              .when(parsed.isNull() & s.contains("."), F.lit("separador_miles"))
              .when(parsed.isNull(), F.lit("no_numerico")))
    return df.withColumn("motivo", motivo)
