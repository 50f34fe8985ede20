"""Reports of saved runs equal their published metrics."""

import json

import pytest

from golden import CLASSES, RUNS
from veritally.plans.report import full_report
from veritally.plans.runs import replay_run

RESPONSES = (
    "model_name string, instance_index long, iteration int, is_safe boolean, "
    "categories array<string>, latency double"
)


def tables(rows, data):
    responses = rows(RESPONSES, [("m", i, it, safe, cats, lat) for i, it, _, safe, cats, lat in data])
    labels = sorted({(i, actual) for i, _, actual, *_ in data})
    return responses, rows("instance_index long, category string", labels)


def check(report, want):
    b, m = report["binary"], report["multiclass"]
    four = ("accuracy", "precision", "recall", "f1")
    assert tuple(b["macro_mean"][k] for k in four) == pytest.approx(want["macro"])
    assert tuple(b["micro"][k] for k in four[1:]) == pytest.approx(want["micro"])
    assert tuple(b["average_confusion_matrix"][k] for k in ("tp", "tn", "fp", "fn")) == want["average"]
    assert tuple(m["macro_mean"][k] for k in four[1:]) == pytest.approx(want["multi_macro"])
    assert tuple(m["micro"][k] for k in four[1:]) == pytest.approx(want["multi_micro"])
    for a in CLASSES:
        assert tuple(report["per_class"][a][k] for k in four[1:]) == pytest.approx(want["per_class"][a])
        for p in CLASSES:
            assert report["confusion_matrix"][a][p] == want["matrix"].get((a, p), 0)
        total, correct = want["performance"][a]
        got = report["performance_by_category"][a]
        assert (got["total"], got["correct"], got["accuracy"]) == (total, correct, correct / total)
    stats = ("mean", "median", "std", "min", "max")
    assert tuple(report["latency"][k] for k in stats) == pytest.approx(want["latency"])
    assert tuple(report["latency_per_instance"][k] for k in stats) == pytest.approx(want["per_instance"])
    assert (report["n_rows"], report["n_instances"], report["iterations"]) == (12, 6, 2)
    assert report["category_distribution"] == {c: 4 for c in CLASSES}


@pytest.mark.parametrize("name", RUNS)
def test_report(rows, name):
    data, want = RUNS[name]
    responses, requests = tables(rows, data)
    [report] = full_report(responses, requests, CLASSES, ["safe"], 2).collect()
    check(report, want)


@pytest.mark.parametrize("name", RUNS)
def test_replay_of_a_result_file(spark, tmp_path, name):
    data, want = RUNS[name]
    scalar = name == "scalars"
    predictions = [
        {
            "request_text": f"prompt {i}",
            "request_metadata": {"source": "s", "original_id": 30 + i, "category": actual},
            "prediction": {
                "is_safe": safe, "score": -1.0, "category": cats[0] if cats and scalar else cats,
                "latency": lat, "model_name": "m", "timestamp": "2026-02-25T00:21:00.754028+00:00",
                "instance_index": i, "iteration": it,
                "raw_response": {"value": "x"} if scalar else "\n\nsafe",
            },
        }
        for i, it, actual, safe, cats, lat in data
    ]
    path = tmp_path / "run.json"
    path.write_text(
        json.dumps({"model": "m", "dataset": "d", "total_samples": 12, "metrics": {}, "predictions": predictions}, indent=2)
    )
    [report] = replay_run(spark, str(path), CLASSES, ["safe"], 2).collect()
    check(report, want)


def test_one_missing_response_moves_no_label(rows):
    data, _ = RUNS["scalars"]
    responses, requests = tables(rows, data[1:])
    [report] = full_report(responses, requests, CLASSES, ["safe"], 2).collect()
    # Instance 0 now has one answer, a right one; the other labels are as before.
    perf = report["performance_by_category"]
    assert perf["safe"]["correct"] == 1.0
    assert perf["unethical"]["correct"] == 0.5
