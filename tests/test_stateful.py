"""Custom stream state against the batch operators, with a restart in the middle."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veritally.operators.align import dedupe_slots
from veritally.operators.monitoring import peak_concurrency
from veritally.streaming.stateful import ROCKSDB, slot_changes, slot_counts, stream_peak_concurrency

WRITES = "model_name string, instance_index long, iteration int, is_safe boolean, category string, timestamp timestamp_ntz"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in ROCKSDB:
        spark.conf.unset(k)


def run(stream, folder):
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/n={n:06d}")
    ).start().awaitTermination()


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_rewritten_slots_end_with_the_batch_counts(spark, tmp_path):
    """Late, equal and repeated writes; the stream is stopped and started again."""
    rng = random.Random(6)
    for part in range(4):
        rows = [
            ("m" if rng.random() < 0.7 else "n", rng.randrange(25), rng.randrange(2), rng.random() < 0.5, rng.choice(["a", "b", None]),
             START + timedelta(seconds=rng.randrange(400)))
            for _ in range(120)
        ]
        spark.createDataFrame(rows + rows[:5], WRITES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part % 2:
            run(slot_changes(read(spark, tmp_path, WRITES)), tmp_path)
    changes = spark.read.parquet(f"{tmp_path}/out")
    writes = spark.read.parquet(f"{tmp_path}/in").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    want = dedupe_slots(writes).groupBy("model_name", "category").agg(F.count(F.lit(1)).alias("slots"), F.count_if("is_safe").alias("safe"))
    assert sorted(map(tuple, slot_counts(changes).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert changes.where("change = -1").count() > 20
    # Every slot has one verdict at any time.
    per_slot = changes.groupBy("model_name", "instance_index", "iteration").agg(F.sum("change").alias("c"))
    assert per_slot.where("c <> 1").count() == 0


def test_settled_slots_leave_the_state(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, WRITES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        run(slot_changes(read(spark, tmp_path, WRITES), settle="10 seconds", keep_seconds=60), tmp_path)

    add([("m", 1, 0, True, "a", START)])
    go()
    add([("m", 1, 0, False, "b", START + timedelta(seconds=30))])
    go()
    # Far ahead: the first slot is settled, its timer fires and its state is gone.
    add([("m", 2, 0, True, "a", START + timedelta(seconds=500))])
    go()
    add([("m", 3, 0, True, "a", START + timedelta(seconds=501))])
    go()
    rows = [tuple(r)[1:-1] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("n", "change").collect()]
    assert sorted(rows, key=repr) == sorted([
        (1, 0, True, "a", 1), (1, 0, True, "a", -1), (1, 0, False, "b", 1), (2, 0, True, "a", 1), (3, 0, True, "a", 1),
    ], key=repr)


def test_calls_in_flight_out_of_order(spark, tmp_path):
    """The number for all calls equals the batch one once a last row has moved the watermark past them."""
    rng = random.Random(9)
    schema = "model_name string, latency double, timestamp timestamp_ntz"
    calls = [(rng.choice("mn"), float(rng.choice([0, 5, 1_000, 40_000, rng.randrange(90_000)])), START + timedelta(seconds=rng.randrange(600))) for _ in range(400)]
    calls.sort(key=lambda r: r[2] + timedelta(seconds=rng.randrange(55)))
    for part in range(4):
        spark.createDataFrame(calls[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part % 2:
            run(stream_peak_concurrency(read(spark, tmp_path, schema), "120 seconds"), tmp_path)
    for k in range(2):
        last = [(m, 0.0, START + timedelta(days=1 + k)) for m in "mn"]
        spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream_peak_concurrency(read(spark, tmp_path, schema), "120 seconds"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("model_name").agg(F.max("peak_calls").alias("peak_calls"))
    want = peak_concurrency(spark.read.parquet(f"{tmp_path}/in").withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
