from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veritally.operators.align import align_predictions
from veritally.operators.binary import binary_confusion
from veritally.streaming.progress import latest_complete, run_progress, start_append, start_complete, windowed_confusion

SCHEMA = "model_name string, instance_index long, is_safe boolean, timestamp timestamp_ntz"
START = datetime(2024, 1, 1)


@pytest.fixture
def arrivals(spark, rows, tmp_path):
    """Three files in event-time order and one late file."""
    source = tmp_path / "in"

    def add(name, data):
        df = rows(SCHEMA, data).coalesce(1)
        df.write.mode("append").parquet(str(source))

    def batch(first, n):
        return [
            ("m" if i % 2 else "n", i % 7, i % 3 == 0, START + timedelta(seconds=20 * i)) for i in range(first, first + n)
        ]

    return source, add, batch


def read(spark, source):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))


def labels(rows):
    return rows("instance_index long, category string", [(i, "safe" if i % 2 else "bad") for i in range(6)])


def test_progress_resumes_and_equals_batch(spark, arrivals, tmp_path):
    source, add, batch = arrivals
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    add("a", batch(0, 50))
    start_complete(run_progress(read(spark, source)), out, mark).awaitTermination()
    add("b", batch(50, 31))
    start_complete(run_progress(read(spark, source)), out, mark).awaitTermination()
    want = run_progress(spark.read.schema(SCHEMA).parquet(str(source)))
    assert sorted(map(tuple, latest_complete(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_two_generations_are_kept(spark, arrivals, tmp_path):
    source, add, batch = arrivals
    out, mark = tmp_path / "out", str(tmp_path / "mark")
    for k in range(5):
        add(f"{k}", batch(20 * k, 20))
        start_complete(run_progress(read(spark, source)), str(out), mark).awaitTermination()
    assert len(list(out.iterdir())) == 2
    (out / "batch=999999999999").mkdir()  # a batch that was not finished
    assert latest_complete(spark, str(out)).agg(F.sum("finished")).first()[0] == 100


def test_closed_windows_equal_batch_and_late_rows_are_dropped(spark, rows, arrivals, tmp_path):
    source, add, batch = arrivals
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = windowed_confusion(read(spark, source), labels(rows), ["safe"])
        start_append(stream, out, mark).awaitTermination()

    add("a", batch(0, 200))
    run()
    # 200 rows of 20 s: the watermark is 3980 s - 600 s, so windows up to 3300 s are closed.
    everything = spark.read.schema(SCHEMA).parquet(str(source)).withColumn(
        "window", F.window(F.col("timestamp").cast("timestamp"), "5 minutes")
    )
    aligned = align_predictions(everything.withColumn("category", F.lit(None).cast("string")), labels(rows), ["safe"])
    closed = (
        binary_confusion(aligned, ("model_name", "window"))
        .where(F.col("window.end") <= F.lit(START + timedelta(seconds=3300)).cast("timestamp"))
        .select("model_name", "window.start", "window.end", "tp", "tn", "fp", "fn")
    )
    want = sorted(map(tuple, closed.collect()))
    assert len(want) == 22
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want
    # A row of a closed window and a row far ahead that closes the rest.
    add("late", [("m", 1, True, START), ("m", 1, True, START + timedelta(days=1))])
    run()
    got = spark.read.parquet(out)
    assert got.groupBy("model_name", "window_start").count().where("count > 1").count() == 0
    total = got.agg(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).collect()[0][0]
    labelled = sum(1 for i in range(200) if i % 7 < 6)
    assert total == labelled
