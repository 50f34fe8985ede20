import math

import pytest

from veritally.operators.multiclass import (
    average_confusion_matrix,
    confusion_matrix,
    confusion_matrix_wide,
    multiclass_accumulative,
    multiclass_summary,
    per_class_mean,
    per_class_metrics,
    unknown_labels,
)
from veritally.operators.views import confusion_normalized

ABC = ["a", "b", "c"]
SCHEMA = "model_name string, iteration int, actual string, predicted string"
DATA = [
    ("m", 0, "a", "a"), ("m", 0, "a", "b"), ("m", 0, "b", "b"), ("m", 0, "b", None),
    ("m", 1, "a", "a"), ("m", 1, "a", "a"), ("m", 1, "b", "a"), ("m", 1, "c", "a"),
    ("null", 0, "a", None), ("null", 0, "b", None),
]


def test_dense_matrix_skips_null_predictions(rows):
    got = {tuple(r)[:3]: r["n"] for r in confusion_matrix(rows(SCHEMA, DATA), ABC).collect()}
    assert len(got) == 2 * 9
    nonzero = {k: n for k, n in got.items() if n}
    assert nonzero == {
        ("m", "a", "a"): 3, ("m", "a", "b"): 1, ("m", "b", "b"): 1, ("m", "b", "a"): 1, ("m", "c", "a"): 1
    }


def test_wide_matrix_has_zeroes(rows):
    got = {(r["model_name"], r["actual"]): (r["a"], r["b"], r["c"])
           for r in confusion_matrix_wide(rows(SCHEMA, DATA), ABC).collect()}
    assert got[("m", "a")] == (3, 1, 0)
    assert got[("null", "c")] == (0, 0, 0)


def test_per_class_and_summary(rows):
    matrix = confusion_matrix(rows(SCHEMA, DATA), ABC)
    per = {r["class"]: r for r in per_class_metrics(matrix).where("model_name = 'm'").collect()}
    assert (per["a"]["precision"], per["a"]["recall"], per["a"]["support"]) == (3 / 5, 3 / 4, 4)
    assert (per["b"]["precision"], per["b"]["recall"], per["b"]["f1"]) == (0.5, 0.5, 0.5)
    assert (per["c"]["precision"], per["c"]["recall"], per["c"]["support"]) == (0.0, 0.0, 1)
    s = {r["model_name"]: r for r in multiclass_summary(matrix).collect()}
    assert s["m"]["accuracy"] == pytest.approx(4 / 7)
    assert s["m"]["weighted_recall"] == pytest.approx((3 + 1 + 0) / 7)
    assert s["m"]["macro_precision"] == pytest.approx((3 / 5 + 1 / 2) / 3)
    # Nothing but NULL predictions: no accuracy, zeroes elsewhere.
    assert math.isnan(s["null"]["accuracy"])
    assert (s["null"]["macro_f1"], s["null"]["weighted_f1"]) == (0.0, 0.0)


def test_averages_are_truncated_and_dense(rows):
    avg = {(r["actual"], r["predicted"]): (r["avg_n"], r["avg_n_trunc"])
           for r in average_confusion_matrix(rows(SCHEMA, DATA), ABC).where("model_name = 'm'").collect()}
    assert avg[("a", "a")] == (1.5, 1) and avg[("b", "b")] == (0.5, 0) and avg[("c", "c")] == (0.0, 0)
    by_iteration = confusion_matrix(rows(SCHEMA, DATA), ABC, ("model_name", "iteration"))
    mean = {r["class"]: r for r in per_class_mean(by_iteration).where("model_name = 'm'").collect()}
    assert mean["a"]["precision"] == pytest.approx((1.0 + 0.5) / 2)
    acc = multiclass_accumulative(by_iteration).where("model_name = 'm'").collect()[0]
    assert acc["micro_precision"] == acc["micro_recall"] == pytest.approx(4 / 7)
    assert acc["macro_precision"] == pytest.approx((0.75 + 0.25 + 0.0) / 3)


@pytest.mark.parametrize("bad", [("m", 0, "a", "zzz"), ("m", 0, "zzz", "a"), ("m", 0, None, "a")])
def test_unknown_labels_raise_or_are_set_aside(rows, bad):
    df = rows(SCHEMA, DATA + [bad])
    with pytest.raises(Exception, match="label"):
        confusion_matrix(df, ABC).collect()
    kept = confusion_matrix(df, ABC, on_unknown="quarantine")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, confusion_matrix(rows(SCHEMA, DATA), ABC).collect()))
    assert [tuple(r) for r in unknown_labels(df, ABC).collect()] == [bad]


def test_unknown_actual_of_a_null_prediction_is_skipped(rows):
    df = rows(SCHEMA, [("m", 0, "zzz", None), ("m", 0, "a", "a")])
    assert confusion_matrix(df, ABC).where("n > 0").count() == 1
    with pytest.raises(ValueError):
        confusion_matrix(df, ABC, on_unknown="ignore")


def test_normalized_rows(rows):
    matrix = confusion_matrix(rows(SCHEMA, DATA), ABC)
    share = {tuple(r)[:3]: r["share"] for r in confusion_normalized(matrix).collect()}
    assert share[("m", "a", "a")] == 0.75 and share[("null", "a", "a")] == 0.0
    totals = rows("actual string, total long", [("a", 10), ("b", 5)])
    share = {tuple(r)[1:3]: r["share"] for r in
             confusion_normalized(matrix, label_counts=totals).where("model_name = 'm'").select("model_name", "actual", "predicted", "share").collect()}
    assert share[("a", "a")] == 0.3 and share[("c", "a")] == 0.0


def test_rows_without_an_iteration_are_in_no_average(rows):
    df = rows("model_name string, iteration int, actual string, predicted string",
              [("m", i, "a", "a") for i in (0, 1) for _ in range(4)] + [("m", None, "a", "a")])
    cells = {(r["actual"], r["predicted"]): r["avg_n"] for r in average_confusion_matrix(df, ["a", "b"]).collect()}
    assert cells[("a", "a")] == 4.0
