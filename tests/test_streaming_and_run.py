"""Stream re-delivery replaces periods idempotently; the batch run writes its outputs."""

import os
import uuid

from pyspark.sql import functions as F

from cosecha.session import scratch_path
from cosecha.streaming import redelivery as RD
from cosecha.streaming.redelivery import deliver, run_redelivery_stream

from conftest import SF_SMALL


SCHEMA = "anio int, mes int, v double"
KEYS = ["anio", "mes"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anio", "mes", "v").collect())


def test_stream_redelivery_replaces_periods(spark):
    root = scratch_path(spark, "test_stream", uuid.uuid4().hex[:8])
    first = spark.createDataFrame([(2023, m, float(m)) for m in (1, 2, 3)], SCHEMA).repartition(3)
    newer = spark.createDataFrame([(2023, 2, 20.0)], SCHEMA)
    deliver(first, f"{root}/landing", 1)
    deliver(newer, f"{root}/landing", 5)

    def run():
        return run_redelivery_stream(spark, f"{root}/landing", f"{root}/store", f"{root}/_chk", KEYS, SCHEMA)

    want = [(2023, 1, 1.0), (2023, 2, 20.0), (2023, 3, 3.0)]
    assert rows_of(run()) == want
    assert rows_of(run()) == want  # a restart finds nothing new
    # An older delivery comes late: it brings what is new in it and undoes nothing.
    deliver(spark.createDataFrame([(2023, 2, -2.0), (2023, 4, 4.0)], SCHEMA), f"{root}/landing", 3)
    want.append((2023, 4, 4.0))
    assert rows_of(run()) == want
    # The same delivery again changes nothing; a newer one of two periods replaces both.
    deliver(newer, f"{root}/landing", 5)
    assert rows_of(run()) == want
    deliver(spark.createDataFrame([(2023, 1, 10.0), (2023, 4, 40.0), (2023, 4, 41.0)], SCHEMA), f"{root}/landing", 6)
    assert rows_of(run()) == [(2023, 1, 10.0), (2023, 2, 20.0), (2023, 3, 3.0), (2023, 4, 40.0), (2023, 4, 41.0)]


def test_replayed_and_broken_batches(spark):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(SCHEMA)
    root = scratch_path(spark, "test_replay", uuid.uuid4().hex[:8])

    def apply(i, version, *rows):
        folder = f"{root}/d{uuid.uuid4().hex[:6]}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(folder)
        batch = spark.createDataFrame([(folder, version)], "carpeta string, version long")
        return RD.apply_batch(batch, i, f"{root}/store", f"{root}/log", KEYS, schema)

    assert apply(0, 1, (2023, 1, 1.0), (2023, 2, 2.0)) == "aplicado"
    assert apply(0, 9, (2023, 1, 99.0)) == "repetido"  # the batch id is in the log
    store = lambda: rows_of(spark.read.parquet(f"{root}/store"))
    assert store() == [(2023, 1, 1.0), (2023, 2, 2.0)]
    # Data written, then lost before the log entry: the batch runs again and ends the same.
    write, RD.replace_partitions = RD.replace_partitions, None
    try:
        def then_fail(*args):
            write(*args)
            raise OSError("lost")
        RD.replace_partitions = then_fail
        try:
            apply(1, 2, (2023, 2, 22.0))
        except OSError:
            pass
    finally:
        RD.replace_partitions = write
    assert store() == [(2023, 1, 1.0), (2023, 2, 22.0)]
    assert apply(1, 2, (2023, 2, 22.0)) == "aplicado"
    assert store() == [(2023, 1, 1.0), (2023, 2, 22.0)]
    log = spark.read.parquet(f"{root}/log")
    assert sorted((r.mes, r.version, r.lote) for r in log.collect()) == [(1, 1, 0), (2, 1, 0), (2, 2, 1)]


def test_upsert_touches_only_its_buckets(spark):
    from cosecha.sources import landing as LD
    path = scratch_path(spark, "test_upsert", uuid.uuid4().hex[:8])
    schema = "k string, y int, m int, v double"
    rows = [(f"s{i % 40}" if i % 41 else None, 2000 + i % 3, m, float(i)) for i in range(120) for m in (1, 2)]
    LD.write_bucketed(spark.createDataFrame(rows, schema), path, ["k", "y"], 16)
    files = lambda: {r.f: r.t for r in spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    before = files()
    new = [("s1", 2001, 1, -1.0), (None, 2000, 7, -2.0), ("new", 1999, 1, -3.0)]
    delivery = spark.createDataFrame(new, schema)
    want = sorted([r for r in rows if (r[0], r[1]) not in {x[:2] for x in new}] + new, key=str)
    for _ in range(2):  # again: the same
        got = LD.upsert_bucketed(spark, path, delivery, ["k", "y"], ["k", "y", "m"], 16)
        assert sorted((tuple(r[c] for c in ("k", "y", "m", "v")) for r in got.collect()), key=str) == want
    after = files()
    assert 0 < len(before.keys() - after.keys()) <= 3
    assert all(after[f] == t for f, t in before.items() if f in after)
    old = spark.read.parquet(path).where("_cubo in (1, 2)")
    plan = LD.replace_by_key(old, delivery.withColumn("_cubo", F.lit(1)), ["k", "y"], ["k", "y", "m"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_cubo" in text
    try:
        LD.upsert_bucketed(spark, path, delivery.unionByName(delivery), ["k", "y"], ["k", "y", "m"], 16)
    except Exception as e:  # noqa: BLE001 - Spark wraps it
        assert "duplicada" in str(e)
    else:
        raise AssertionError("a delivery with two rows of one key must fail")
    assert files() == after
    try:
        LD.replace_by_key(old, delivery, ["v"], ["k"])
    except ValueError:
        pass
    else:
        raise AssertionError("the primary key must contain the delete keys")


def test_batch_run_writes_outputs(spark):
    from cosecha.run import run
    out = scratch_path(spark, "test_run", uuid.uuid4().hex[:8])
    times = run(spark, SF_SMALL, out, ["etl", "validate", "process", "finalize"], shapley=False)
    assert set(times) == {"etl", "validate", "process", "finalize"}
    final = spark.read.parquet(f"{out}/model/dataset_final")
    assert final.count() > 0
    assert final.filter(F.col("t_media_c").isNull()).count() == 0
    codes = spark.read.json(f"{out}/model/label_encoders")
    assert set(r.columna for r in codes.select("columna").distinct().collect()) == {"cultivo", "provincia", "ccaa"}
