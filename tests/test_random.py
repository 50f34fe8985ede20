"""Random runs against plain Python."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from veritally.plans.report import full_report, stats
from veritally.operators.align import align_predictions

CLASSES = ["safe", "bad", "off"]
call = st.tuples(
    st.sampled_from(["m", "n"]), st.integers(0, 5), st.integers(0, 2), st.booleans(),
    st.sampled_from([*CLASSES, None]), st.integers(1, 40),
)
RUN = st.tuples(
    st.lists(st.sampled_from(CLASSES), min_size=6, max_size=6),
    st.lists(call, min_size=1, max_size=30, unique_by=lambda c: c[:3]),
)


def div(a, b):
    return a / b if b else 0.0


def f1(p, r):
    return div(2 * p * r, p + r)


def by_hand(labels, calls, model, iterations):
    mine = [c for c in calls if c[0] == model]
    per_iteration = defaultdict(list)
    for c in mine:
        per_iteration[c[2]].append(c)
    macro, counts, matrices = [], np.zeros(4), []
    for rows in per_iteration.values():
        pairs = [(r[3], labels[r[1]] == "safe") for r in rows]
        tp, tn = pairs.count((True, True)), pairs.count((False, False))
        fp, fn = pairs.count((True, False)), pairs.count((False, True))
        p, r = div(tp, tp + fp), div(tp, tp + fn)
        macro.append(((tp + tn) / len(pairs), p, r, f1(p, r)))
        counts += (tp, tn, fp, fn)
        m = np.zeros((3, 3))
        for row in rows:
            if row[4] is not None:
                m[CLASSES.index(labels[row[1]]), CLASSES.index(row[4])] += 1
        matrices.append(m)
    per_class = np.array([
        [(div(m[i, i], m[:, i].sum()), div(m[i, i], m[i].sum()),
          f1(div(m[i, i], m[:, i].sum()), div(m[i, i], m[i].sum()))) for i in range(3)]
        for m in matrices
    ]).mean(axis=0)
    total = sum(matrices)
    performance = defaultdict(lambda: [0, 0.0])
    for i, label in enumerate(labels):
        answers = [r[3] == (label == "safe") for r in mine if r[1] == i]
        performance[label][0] += 1
        performance[label][1] += div(sum(answers), len(answers))
    means = [np.mean([r[5] for r in mine if r[1] == i]) for i in {r[1] for r in mine}]
    return {
        "macro": np.mean(macro, axis=0), "average": counts / iterations, "per_class": per_class,
        "matrix": np.trunc(total / len(matrices)), "micro": div(np.trace(total), total.sum()),
        "performance": performance, "latency": [r[5] for r in mine], "means": means,
    }


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(RUN)
def test_report_equals_plain_python(spark, run):
    labels, calls = run
    responses = spark.createDataFrame(
        [(m, i, it, s, c, float(x)) for m, i, it, s, c, x in calls],
        "model_name string, instance_index long, iteration int, is_safe boolean, category string, latency double",
    )
    requests = spark.createDataFrame(list(enumerate(labels)), "instance_index long, category string")
    for r in full_report(responses, requests, CLASSES, ["safe"], 3).collect():
        want = by_hand(labels, calls, r["model_name"], 3)
        b, m = r["binary"], r["multiclass"]
        assert tuple(b["macro_mean"]) == pytest.approx(tuple(want["macro"]))
        assert tuple(b["average_confusion_matrix"]) == pytest.approx(tuple(want["average"]))
        assert m["micro"]["precision"] == pytest.approx(want["micro"])
        assert tuple(m["macro_mean"]) == pytest.approx(tuple(want["per_class"].mean(axis=0)))
        for i, a in enumerate(CLASSES):
            assert tuple(r["per_class"][a]) == pytest.approx(tuple(want["per_class"][i]))
            assert [r["confusion_matrix"][a][p] for p in CLASSES] == list(want["matrix"][i])
        for label, (total, correct) in want["performance"].items():
            got = r["performance_by_category"][label]
            assert (got["total"], got["correct"]) == (total, pytest.approx(correct))
        for name, values in (("latency", want["latency"]), ("latency_per_instance", want["means"])):
            got = r[name]
            assert (got["mean"], got["median"], got["std"]) == pytest.approx(
                (np.mean(values), np.median(values), np.std(values))
            )
    aligned = align_predictions(responses, requests, ["safe"])
    for r in stats(aligned).collect():
        mine = [c for c in calls if c[0] == r["model_name"]]
        right = sum(c[3] == (labels[c[1]] == "safe") for c in mine)
        assert r["accuracy"] == pytest.approx(right / len(mine))
        assert r["latency_median"] == np.median([c[5] for c in mine])
