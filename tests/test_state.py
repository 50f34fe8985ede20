"""Run state merges to the report of all rows; levels come from one aggregation."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from veritally.plans.report import full_report, state_report
from veritally.plans.state import (
    SKETCH, add_part, class_levels, instance_state, labelled, merge_instances, merge_outcomes, outcome_state, read_state, report_levels,
)

CLASSES = ["safe", "bad", "odd"]
RESPONSES = "model_name string, instance_index long, iteration int, is_safe boolean, category string, latency double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    requests = [(i, rng.choice(CLASSES)) for i in range(200)]
    responses = [
        (m, i, k, rng.random() < 0.6, rng.choice([*CLASSES, None]), None if rng.random() < 0.05 else 1e6 + rng.expovariate(0.01))
        for m in ("m", "n", None) for i in range(210) for k in range(3) if rng.random() < 0.9
    ]
    return spark.createDataFrame(responses, RESPONSES), spark.createDataFrame(requests, "instance_index long, category string"), responses, dict(requests)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-9) or math.isnan(a) and math.isnan(b)))


def flat(row):
    out = {}

    def walk(name, value):
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{name}.{k}", v)
        else:
            out[name] = value

    walk("", row.asDict(recursive=True))
    return out


@pytest.mark.parametrize("iterations", [3, 1])
def test_state_report_is_the_full_report(spark, tables, tmp_path, iterations):
    responses, requests, _, _ = tables
    for part in (*range(4), 2):
        add_part(str(tmp_path), f"p{part}", responses.where(F.col("instance_index") % 4 == part), requests, ["safe"])
    outcomes, instances = read_state(spark, str(tmp_path))
    got = {r["model_name"]: flat(r) for r in state_report(outcomes, instances, requests, CLASSES, ["safe"], iterations).collect()}
    want = {r["model_name"]: flat(r) for r in full_report(responses, requests, CLASSES, ["safe"], iterations).collect()}
    assert got.keys() == want.keys() and len(want) == 3
    for model in want:
        assert got[model].keys() == want[model].keys() and want[model][".n_unmatched"] > 0
        assert not [k for k in want[model] if k != ".latency.median" and not close(got[model][k], want[model][k])]
        assert abs(got[model][".latency.median"] - want[model][".latency.median"]) < 50


def test_merging_is_closed_and_in_any_order(spark, tables):
    """States of parts, merged pairwise or at once, are the state of all rows."""
    responses, requests, _, _ = tables
    rows = labelled(responses, requests, ["safe"])
    parts = [outcome_state(rows.where(F.col("instance_index") % 3 == k)) for k in range(3)]
    whole = outcome_state(rows)
    at_once = merge_outcomes(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    pairwise = merge_outcomes(merge_outcomes(parts[2].unionByName(parts[0])).unionByName(parts[1]))
    key = lambda r: repr(tuple(r)[:7])
    want = sorted(map(tuple, whole.drop("v_sketch").collect()), key=key)
    for state in (at_once, pairwise):
        got = sorted(map(tuple, state.drop("v_sketch").collect()), key=key)
        assert len(got) == len(want) and all(close(a, b) or math.isclose(a, b, abs_tol=1e-3) for x, y in zip(got, want) for a, b in zip(x, y))
    instances = [instance_state(rows.where(F.col("iteration") == k)) for k in range(3)]
    merged = merge_instances(instances[0].unionByName(instances[1]).unionByName(instances[2]))
    pick = merged.select("model_name", "instance_index", "_safe", "_all", "_n")
    assert sorted(pick.collect(), key=repr) == sorted(instance_state(rows).select(*pick.columns).collect(), key=repr)


def test_levels_are_separate_groupings(spark, tables):
    responses, requests, rows, labels = tables
    got = {(r["level"], r["model_name"], r["iteration"]): r for r in report_levels(outcome_state(labelled(responses, requests, ["safe"]))).collect()}
    rows = [r for r in rows if r[1] in labels]
    groups = {}
    for r in rows:
        for key in ((0, r[0], r[2]), (1, r[0], None), (3, None, None)):
            groups.setdefault(key, []).append(r)
    assert got.keys() == groups.keys()
    for key, some in groups.items():
        r = got[key]
        truth = [(x[3], labels[x[1]] == "safe") for x in some]
        assert (r["n"], r["tp"], r["tn"], r["fp"], r["fn"]) == (len(some), *[truth.count(c) for c in ((True, True), (False, False), (True, False), (False, True))])
        seen = [x for x in some if x[4] is not None]
        assert close(r["multi_accuracy"], sum(x[4] == labels[x[1]] for x in seen) / len(seen)) and r["unpredicted"] == len(some) - len(seen)
        values = sorted(x[5] for x in some if x[5] is not None)
        assert math.isclose(r["mean"], statistics.fmean(values)) and math.isclose(r["std"], statistics.pstdev(values), rel_tol=1e-6)
        assert (r["min"], r["max"]) == (values[0], values[-1])
        for q, c in ((0.5, "median"), (0.95, "p95")):
            rank = sum(x <= r[c] for x in values) / len(values)
            assert abs(rank - q) < 0.01 + 1 / len(values)


def test_one_aggregation_for_all_levels(spark, tables):
    responses, requests, _, _ = tables
    state = labelled(responses, requests, ["safe"])
    for df in (report_levels(outcome_state(state)), class_levels(outcome_state(state), CLASSES)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Expand [") == 1, plan


def test_classes_without_rows_are_zero(spark, tables):
    responses, requests, _, _ = tables
    state = outcome_state(labelled(responses, requests, ["safe"]))
    got = class_levels(state, [*CLASSES, "never"]).collect()
    assert len(got) == 4 * (9 + 3 + 1)
    assert {(r["support"], r["f1"]) for r in got if r["class"] == "never"} == {(0, 0.0)}


def test_sketch_of_many_values(spark):
    """The median of merged sketches is within the stated rank error."""
    n = 200_000
    rows = spark.range(n).selectExpr("'m' AS model_name", "id AS instance_index", "0 AS iteration", "true AS is_safe", "'safe' AS category", "pow(id % 9973, 2) AS latency")
    requests = rows.selectExpr("instance_index", "category")
    table = labelled(rows, requests, ["safe"])
    merged = merge_outcomes(outcome_state(table.where("instance_index % 7 < 3")).unionByName(outcome_state(table.where("instance_index % 7 >= 3"))))
    r = report_levels(merged).where("level = 3").first()
    for q, c in ((0.5, "median"), (0.95, "p95")):
        assert abs(rows.where(F.col("latency") <= r[c]).count() / n - q) < 0.01
    assert SKETCH == 1_000


def test_reports_read_responses_once(spark, tables, tmp_path, monkeypatch):
    """Raw responses are scanned by one job only; all parts read the narrow table."""
    responses, requests, _, _ = tables
    responses.withColumn("raw_response", F.lit("x" * 100)).write.parquet(f"{tmp_path}/responses")
    stored = spark.read.parquet(f"{tmp_path}/responses")
    report = full_report(stored, requests, CLASSES, ["safe"], 3)
    assert f"{tmp_path}/responses" not in report._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert report.count() == 3
