"""Replays of several datasets and runs, responses without a request, empty runs."""

import json

import pytest

from veritally.plans.report import full_report
from veritally.plans.runs import replay_run
from veritally.sources.result_files import scan_results
from veritally.sources.sinks import write_predictions


def record(i, category, safe, with_index=True, iteration=0, text="t"):
    prediction = {"is_safe": safe, "score": 0.5, "category": category, "latency": 2.0 + i, "model_name": "m", "iteration": iteration}
    if with_index:
        prediction["instance_index"] = i
    return {"request_text": f"{text}{i}", "request_metadata": {"category": category}, "prediction": prediction}


def save(path, dataset, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"model": "m", "dataset": dataset, "total_samples": len(records), "metrics": {}, "predictions": records}))


def test_datasets_and_runs_stay_apart(spark, tmp_path):
    flip = ["safe", "bad"]
    save(tmp_path / "exp" / "000" / "a.json", "A", [record(i, flip[i % 2], i % 2 == 0) for i in range(6)])
    save(tmp_path / "exp" / "001" / "b.json", "B", [record(i, flip[(i + 1) % 2], i % 2 == 1, with_index=False) for i in range(4)])
    save(tmp_path / "exp" / "002" / "a.json", "A", [record(i, "safe", False) for i in range(3)])
    out = replay_run(spark, str(tmp_path / "exp" / "*"), ["safe", "bad"], ["safe"], 1)
    got = {(r["dataset"], r["run"]): (r["n_instances"], r["binary"]["accuracy"], r["n_unmatched"], dict(r["category_distribution"]))
           for r in out.collect()}
    assert got == {
        ("A", "000"): (6, 1.0, 0, {"safe": 3, "bad": 3}),
        ("B", "001"): (4, 1.0, 0, {"safe": 2, "bad": 2}),
        ("A", "002"): (3, 0.0, 0, {"safe": 3}),
    }


def test_unmatched_responses_are_counted_and_in_no_metric(rows):
    requests = rows("instance_index long, text string, category string", [(0, "a", "safe"), (1, "b", "bad"), (2, "c", None), (3, "d", "")])
    responses = rows(
        "model_name string, instance_index long, iteration int, is_safe boolean, category string, latency double",
        [("m", 0, 0, True, "safe", 1.0), ("m", 1, 0, False, "bad", 3.0), ("m", 2, 0, False, None, 5.0), ("m", 3, 0, False, None, 7.0),
         ("m", 9, 0, True, "safe", 900.0), ("m", None, 0, True, "safe", 900.0)],
    )
    [r] = full_report(responses, requests, ["safe", "bad"], ["safe"]).collect()
    assert (r["n_unmatched"], r["latency"]["max"], r["binary"]["tp"] + r["binary"]["tn"]) == (2, 7.0, 4)
    # A missing label and an empty one are two entries.
    assert set(r["performance_by_category"]) == {"safe", "bad", "", "\0"}
    assert dict(r["category_distribution"]) == {"safe": 1, "bad": 1, "": 2}


def test_many_labels_and_groups(spark):
    requests = spark.range(10_400).selectExpr("id AS instance_index", "'x' AS text", "concat('label', id) AS category")
    responses = spark.range(10_400).selectExpr(
        "'m' AS model_name", "id AS instance_index", "CAST(id % 2 AS int) AS iteration", "false AS is_safe", "CAST(NULL AS string) AS category", "1.0D AS latency"
    )
    [r] = full_report(responses, requests, ["safe"], ["safe"], iterations=2).collect()
    assert len(r["performance_by_category"]) == len(r["category_distribution"]) == 10_400


def test_an_empty_run_is_an_error(rows):
    requests = rows("instance_index long, text string, category string", [(0, "a", "safe")])
    responses = rows("model_name string, instance_index long, iteration int, is_safe boolean, category string, latency double", [])
    with pytest.raises(ValueError):
        full_report(responses, requests, ["safe"], ["safe"])


def test_written_predictions_are_read_back(spark, rows, tmp_path):
    requests = rows("instance_index long, text string, category string", [(0, "first", "safe"), (1, "sec\nond", "bad")])
    data = [("m", i, k, i == 0, 0.5, "safe" if i == 0 else "bad", 1.0 + i + k) for i in (0, 1) for k in (0, 1)]
    responses = rows("model_name string, instance_index long, iteration int, is_safe boolean, score double, category string, latency double", data)
    write_predictions(responses, requests, str(tmp_path / "out"), "exp", 3, fmt="json")
    saved = scan_results(spark, str(tmp_path / "out" / "*" / "*"), lines=True)
    got = {(r["instance_index"], r["iteration"]): (r["model_name"], r["text"], r["actual"], r["category"], r["is_safe"], r["latency"]) for r in saved.collect()}
    assert got == {(i, k): ("m", ["first", "sec\nond"][i], ["safe", "bad"][i], c, s, t) for _, i, k, s, _, c, t in data}
    [r] = replay_run(spark, str(tmp_path / "out" / "*" / "*"), ["safe", "bad"], ["safe"], 2, lines=True).collect()
    assert r["binary"]["macro_mean"]["accuracy"] == 1.0 and r["n_instances"] == 2
