import pytest

from veritally.operators.binary import (
    binary_accumulative,
    binary_by_iteration,
    binary_confusion,
    binary_metrics,
)
from veritally.operators.counts import outcome_counts
from veritally.operators.views import binary_confusion_labeled, metrics_comparison, metrics_long, run_summary

# name: (predicted, actual, tp, tn, fp, fn)
T, N = True, False
CASES = {
    "perfect": ([T, T, N, N, T, N], [T, T, N, N, T, N], 3, 3, 0, 0),
    "all_false": ([N] * 4, [T, N, T, N], 0, 2, 0, 2),
    "all_true": ([T] * 4, [T, N, T, N], 2, 0, 2, 0),
    "known_f1": ([T] * 20 + [N] * 5, [T] * 10 + [N] * 10 + [T] * 5, 10, 0, 10, 5),
    "low_recall": ([T, N, N, N, N], [T] * 5, 1, 0, 0, 4),
    "balanced": ([T] * 50 + [N] * 100, [T] * 50 + [N] * 50 + [T] * 50, 50, 50, 0, 50),
    "no_positives": ([N] * 3, [N] * 3, 0, 3, 0, 0),
    "single_fp": ([T], [N], 0, 0, 1, 0),
    "many_fp": ([T] * 100, [T] * 10 + [N] * 90, 10, 0, 90, 0),
    "many_fn": ([N] * 100, [N] * 10 + [T] * 90, 0, 10, 0, 90),
}
SCHEMA = "model_name string, iteration int, predicted_safe boolean, actual_safe boolean"


@pytest.fixture
def cases(rows):
    return rows(SCHEMA, [(n, 0, p, a) for n, c in CASES.items() for p, a in zip(c[0], c[1])])


def expected(tp, tn, fp, fn):
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    return (tp + tn) / (tp + tn + fp + fn), p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_closed_forms(cases):
    got = {r["model_name"]: r for r in binary_metrics(cases).collect()}
    assert set(got) == set(CASES)
    for name, (_, _, *counts) in CASES.items():
        r = got[name]
        assert [r["tp"], r["tn"], r["fp"], r["fn"]] == counts
        assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == pytest.approx(expected(*counts))


def test_empty_input_is_an_error(cases):
    with pytest.raises(Exception, match="no predictions to measure"):
        binary_metrics(cases.where("false"), by=()).collect()
    assert binary_metrics(cases.where("false")).count() == 0


def test_counts_sum_to_rows_and_prefix_counts_agree(rows, cases):
    total = binary_confusion(cases, ()).collect()[0]
    assert sum(total) == cases.count()
    full = cases.selectExpr("*", "'x' AS actual", "'y' AS predicted")
    counted = outcome_counts(full)
    a = sorted(map(tuple, binary_metrics(counted).collect()))
    assert a == sorted(map(tuple, binary_metrics(cases).collect()))


def test_accumulative_divides_by_requested_iterations(rows):
    df = rows(SCHEMA, [("m", 0, T, T), ("m", 0, T, N), ("m", 2, N, N), ("m", 2, T, T)])
    per = {r["iteration"]: r for r in binary_by_iteration(df).collect()}
    assert per[0]["accuracy"] == 0.5 and per[2]["accuracy"] == 1.0
    [r] = binary_accumulative(df, 4).collect()
    assert r["macro_accuracy"] == 0.75  # observed iterations only
    assert (r["avg_tp"], r["avg_tn"], r["avg_fp"], r["avg_fn"]) == (0.5, 0.25, 0.25, 0.0)
    assert r["micro_precision"] == pytest.approx(2 / 3)


def test_views(rows, cases):
    cells = {
        (r["actual"], r["predicted"]): r["n"]
        for r in binary_confusion_labeled(binary_confusion(cases)).where("model_name = 'known_f1'").collect()
    }
    assert cells == {("safe", "safe"): 10, ("safe", "unsafe"): 5, ("unsafe", "safe"): 10, ("unsafe", "unsafe"): 0}
    long = metrics_long(binary_metrics(cases), ["accuracy", "f1"])
    wide = metrics_comparison(long, ["accuracy", "f1", "absent"]).where("model_name = 'single_fp'").collect()
    assert tuple(wide[0]) == ("single_fp", 0.0, 0.0, 0.0)
    summary = run_summary(binary_metrics(cases), ["precision"]).where("model_name = 'known_f1'").collect()
    assert tuple(summary[0]) == ("known_f1", "precision", 0.5)
    third = run_summary(binary_metrics(rows(SCHEMA, [("m", 0, T, T), ("m", 0, T, N), ("m", 0, T, N)])), ["precision"])
    assert third.collect()[0]["value"] == 0.3333


def test_only_the_asked_iterations_count(rows):
    data = [("m", i, True, True) for i in range(5) for _ in range(10)] + [("m", None, True, True)] * 3 + [("m", -1, False, True)]
    df = rows("model_name string, iteration int, predicted_safe boolean, actual_safe boolean", data)
    [r] = binary_accumulative(df, 2).collect()
    assert (r["avg_tp"], r["avg_fn"], r["macro_accuracy"]) == (10.0, 0.0, 1.0)
