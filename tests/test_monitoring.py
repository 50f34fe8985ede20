import random

import pytest

from veritally.operators.monitoring import classify_failures, failure_summary, peak_concurrency, run_log_summary
from veritally.sources.run_logs import parse_log_lines


def test_failure_rules(rows):
    data = [
        ("429 RESOURCE_EXHAUSTED. Please retry in 57.9s.", 1, "quota", 58.9),
        ("429 RESOURCE_EXHAUSTED. retry in 3s", 1, "quota", 4.0),
        ("Quota exceeded for metric", 1, "quota", 5.0),
        ("Quota exceeded for metric", 5, "quota", 16.0),
        ("Quota exceeded for metric", 400, "quota", 60.0),
        ("Error: Quota exceeded", 1, "Error", None),
        ("Invalid response format: x", 2, "Invalid response format", None),
        (None, 1, "", None),
    ]
    df = rows("model_name string, error string, attempt int", [("m", e, a) for e, a, *_ in data])
    got = [(r["error_class"], r["wait_seconds"]) for r in classify_failures(df, attempts=1_000).collect()]
    assert got == [(c, w) for *_, c, w in data]
    # By default a third call is the last one.
    limited = {(r["error"], r["attempt"]): r["retryable"] for r in classify_failures(df).collect()}
    assert [limited[("Quota exceeded for metric", a)] for a in (1, 5, 400)] == [True, False, False]
    counts = {(r["error_class"], r["retryable"]): r["failures"] for r in failure_summary(df).collect()}
    assert counts == {("quota", True): 3, ("quota", False): 2, ("Error", False): 1, ("Invalid response format", False): 1, ("", False): 1}
    no_attempt = classify_failures(df.drop("attempt")).where("error LIKE 'Quota%'").collect()
    assert {r["wait_seconds"] for r in no_attempt} == {5.0}


def brute_peak(calls):
    events = []
    for end_us, latency in calls:
        events += [(end_us - round(latency * 1000), 1), (end_us, -1)]
    best = now = 0
    for _, step in sorted(events):
        now += step
        best = max(best, now)
    return best


@pytest.mark.parametrize("bucket", [1, 60, 3600])
def test_peak_equals_sweep(spark, bucket):
    """A hot group, calls across many buckets, and equal instants."""
    rng = random.Random(bucket)
    data = []
    for m, n in (("hot", 400), ("one", 1), ("same", 30)):
        for _ in range(n):
            end = 1_700_000_000_000_000 + (0 if m == "same" else rng.randrange(0, 900) * 500_000)
            data.append((m, end, float(rng.choice([0.5, 500, 1000, 90_000, 400_000]))))
    df = spark.createDataFrame(data, "model_name string, us long, latency double").selectExpr(
        "model_name", "timestamp_micros(us) AS timestamp", "latency"
    )
    got = {r["model_name"]: r["peak_calls"] for r in peak_concurrency(df, bucket_seconds=bucket).collect()}
    assert got == {m: brute_peak([(e, x) for k, e, x in data if k == m]) for m in ("hot", "one", "same")}


def test_log_summary(rows):
    lines = [
        "2026-02-22 22:06:58 | INFO     | Loaded 109 samples from dataset",
        "2026-02-22 22:06:58 | INFO     | Evaluating some-model on 109 samples",
        "2026-02-22 22:11:29 | INFO     | Completed evaluation. Got 109 responses",
    ]
    failed = [lines[1], "2026-02-22 22:06:59 | ERROR    | Benchmark failed with error: x"]
    df = rows("source_file string, value string", [("a", x) for x in lines] + [("b", x) for x in failed])
    got = {r["source_file"]: r for r in run_log_summary(parse_log_lines(df)).collect()}
    a, b = got["a"], got["b"]
    assert (a["model_name"], a["samples"], a["responses"], a["seconds"], a["errors"]) == ("some-model", 109, 109, 271, 0)
    assert a["per_second"] == pytest.approx(109 / 271)
    assert (b["model_name"], b["responses"], b["seconds"], b["errors"]) == ("some-model", None, None, 1)
