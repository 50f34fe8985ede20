"""Scoring that is stopped and taken up again; run numbers under concurrent writers."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from veritally.operators.monitoring import classify_failures
from veritally.operators.requests import expand_iterations
from veritally.operators.scoring import Pace, retry_wait, score_slots
from veritally.plans import resume
from veritally.plans.resume import _not_done, read_store, resume_run, settled_slots
from veritally.sources.sinks import claim_experiment_index, save_run


def make():
    return lambda texts: [{"is_safe": "bad" not in t} for t in texts]


def make_stopping(folder):
    """Scores a few tasks and then fails the whole job, as a stopped run does."""

    def build():
        from pyspark import TaskContext

        if TaskContext.get().partitionId() >= 5:
            time.sleep(3)
            raise SystemExit("stopped")
        return lambda texts: [{"is_safe": True} for _ in texts]

    return build


def make_quota(folder):
    """Texts with a number fail so many times for their quota, counting calls in files."""
    import os

    def classify(texts):
        for t in texts:
            if t.startswith("q"):
                if len(texts) > 1:
                    raise RuntimeError("one at a time")
                calls = sum(n.startswith(t + "-") for n in os.listdir(folder))
                open(f"{folder}/{t}-{calls}", "w").close()
                if calls < int(t[1:]):
                    raise RuntimeError("Quota exceeded, retry in 0.01s")
            if t == "broken":
                raise ValueError("bad text")
        return [{"is_safe": True} for _ in texts]

    return lambda: classify


@pytest.fixture
def requests(spark):
    return spark.range(0, 160, 1, 8).select(
        F.col("id").alias("instance_index"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("safe").alias("category")
    )


def test_stopped_run_scores_each_slot_once(spark, requests, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception):
        resume_run(requests, {"m": make_stopping(str(tmp_path))}, path, 2, batch_size=4)
    kept = spark.read.parquet(path).count()
    # Tasks that had ended are kept, though the job failed.
    assert 0 < kept < 320
    done = resume_run(requests, {"m": make}, path, 2, batch_size=4)
    raw = spark.read.parquet(path)
    assert raw.count() == done.count() == 320 and raw.select("instance_index", "iteration").distinct().count() == 320
    again = resume_run(requests, {"m": make, "k": make}, path, 2)
    assert again.count() == 640 and spark.read.parquet(path).count() == 640


def test_quota_errors_are_retried_three_times_in_all(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    texts = ["q0", "q1", "q2", "q3", "broken", "", None]
    requests = spark.createDataFrame([(i, t, "safe") for i, t in enumerate(texts)], "instance_index long, text string, category string")
    store = {r["instance_index"]: r for r in resume_run(requests, {"m": make_quota(str(folder))}, str(tmp_path / "s")).collect()}
    assert {i: (r["attempt"], r["error"] is None) for i, r in store.items()} == {
        0: (1, True), 1: (2, True), 2: (3, True), 3: (3, False), 4: (1, False),
    }
    # Neither is called again: the calls are used up, the text is bad.
    resume_run(requests, {"m": make_quota(str(folder))}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5


def test_calls_left_are_made_by_the_next_run(spark, tmp_path):
    folder, path = tmp_path / "calls", str(tmp_path / "s")
    folder.mkdir()
    requests = spark.createDataFrame([(0, "q2", "safe"), (1, "fine", "safe")], "instance_index long, text string, category string")
    first = resume_run(requests, {"m": make_quota(str(folder))}, path, attempts=1)
    assert {r["instance_index"]: r["attempt"] for r in first.where("error IS NOT NULL").collect()} == {0: 1}
    second = {r["instance_index"]: r for r in resume_run(requests, {"m": make_quota(str(folder))}, path).collect()}
    assert (second[0]["attempt"], second[0]["error"], second[1]["attempt"]) == (3, None, 1)
    assert len(list(folder.iterdir())) == 3


def test_rule_is_that_of_failure_rows(spark):
    errors = ["429 RESOURCE_EXHAUSTED. Please retry in 7.5s", "Quota exceeded", "x Quota exceeded", "Quota exceeded retry in 3s"]
    rows = [(e, n) for e in errors for n in range(1, 9)]
    got = classify_failures(spark.createDataFrame(rows, "error string, attempt int"), 7).collect()
    for r in got:
        assert retry_wait(r["error"], r["attempt"], 7) == r["wait_seconds"]


@pytest.mark.parametrize("most", [100, 0])
def test_done_slots_by_bitmap_and_by_key(spark, requests, monkeypatch, most):
    monkeypatch.setattr(resume, "MOST_BITMAPS", most)
    wide = requests.select((F.col("instance_index") * 40_000 - 70_000).alias("instance_index"), "text")
    expanded = expand_iterations(wide, 3).select("instance_index", "iteration", "text")
    done = expanded.where((F.col("instance_index") / 40_000 + F.col("iteration")) % 3 < 1.5).select("instance_index", "iteration")
    left = _not_done(expanded, done, 3)
    assert sorted(map(tuple, left.select("instance_index", "iteration").collect())) == sorted(
        map(tuple, expanded.select("instance_index", "iteration").exceptAll(done).collect())
    )


def test_texts_are_not_shuffled(spark, requests, tmp_path):
    requests.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    path = str(tmp_path / "s")
    resume_run(stored.where("instance_index < 50"), {"m": make}, path)
    expanded = expand_iterations(stored, 1).select("instance_index", "iteration", "text")
    todo = _not_done(expanded, settled_slots(read_store(spark, path)).select("instance_index", "iteration"), 1)
    plan = score_slots(todo, "m", make, max_concurrency=2)._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "RoundRobin" in line]
    assert todo.count() == 110 and "BroadcastHashJoin" in plan
    # Only the store's keys and bitmaps are dealt out.
    assert texts and not any("text#" in line for line in texts)


def test_pace_is_a_token_bucket():
    pace, start = Pace(50.0, 5), time.monotonic()
    for _ in range(6):
        pace.take(5)
    assert 0.4 < time.monotonic() - start < 1.5
    start = time.monotonic()
    Pace(None, 1).take(10**9)
    assert time.monotonic() - start < 0.1


def test_eight_writers_get_eight_numbers(spark, tmp_path):
    path = str(tmp_path / "results")
    report = spark.createDataFrame([("m", 0.5)], "model_name string, f1 double")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: claim_experiment_index(spark, path, "my exp/1"), range(24)))
    assert sorted(numbers) == list(range(24))
    with ThreadPoolExecutor(8) as pool:
        runs = list(pool.map(lambda _: save_run(report, path, "e", "d"), range(8)))
    assert sorted(runs) == list(range(8))
    assert sorted(r["experiment_index"] for r in spark.read.parquet(path).where("experiment = 'e'").collect()) == list(range(8))


def test_failed_writer_leaves_nothing_and_keeps_its_number(spark, tmp_path):
    path = str(tmp_path / "results")
    report = spark.createDataFrame([("m", 0.5)], "model_name string, f1 double")
    assert save_run(report, path, "e", "d") == 0
    with pytest.raises(Exception):
        save_run(report.withColumn("f1", F.raise_error(F.lit("failed")).cast("double")), path, "e", "d")
    assert save_run(report, path, "e", "d") == 2
    assert sorted(r["experiment_index"] for r in spark.read.parquet(path).collect()) == [0, 2]
