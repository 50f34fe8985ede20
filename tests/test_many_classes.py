"""Metrics without a grid equal the dense ones, and stay linear in classes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veritally.operators.many_classes import (
    checked, occurring_cells, outside_labels, sparse_accumulative, sparse_class_metrics, sparse_summary,
)
from veritally.operators.multiclass import confusion_matrix, matrix_by_iteration, multiclass_accumulative, multiclass_summary, per_class_metrics

CLASSES = ["a", "b", "c", "never"]
SCHEMA = "model_name string, iteration int, actual string, predicted string"


def classes(spark):
    return spark.createDataFrame([(c,) for c in [*CLASSES, "a"]], "class string")


@pytest.fixture(scope="module")
def aligned(spark):
    rng = random.Random(5)
    rows = [(m, rng.choice([0, 1, 4, None]), rng.choice("abc"), rng.choice(["a", "b", "c", None])) for m in ("m", "n", None) for _ in range(150)]
    rows += [("silent", 0, "a", None)] * 3
    return spark.createDataFrame(rows, SCHEMA)


def same(got, want):
    # The dense forms leave out no group either; NULL is a group in both.
    assert sorted(got.columns) == sorted(want.columns)
    order = got.columns
    a, b = (sorted(map(tuple, x.select(*order).collect()), key=repr) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and (math.isclose(p, q, rel_tol=1e-12) or math.isnan(p) and math.isnan(q))), (x, y)


def test_sparse_is_dense(spark, aligned):
    dense = confusion_matrix(aligned, CLASSES)
    same(sparse_class_metrics(aligned, classes(spark)), per_class_metrics(dense))
    same(sparse_summary(aligned, classes(spark)), multiclass_summary(dense))
    same(sparse_accumulative(aligned, classes(spark)), multiclass_accumulative(matrix_by_iteration(aligned, CLASSES)))
    same(sparse_summary(aligned, classes(spark), ()), multiclass_summary(confusion_matrix(aligned, CLASSES, ()), ()))


def test_labels_outside_the_table(spark, aligned):
    odd = aligned.union(spark.createDataFrame([("m", 0, "x", "a"), ("m", 0, "a", "y"), ("m", 0, None, "a"), ("m", 0, "zz", None)], SCHEMA))
    with pytest.raises(Exception, match="outside the class list"):
        sparse_summary(odd, classes(spark)).collect()
    same(sparse_class_metrics(odd, classes(spark), on_unknown="quarantine"), sparse_class_metrics(aligned, classes(spark)))
    found = outside_labels(occurring_cells(odd), classes(spark)).select("actual", "predicted").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([("x", "a"), ("a", "y"), (None, "a")], key=repr)
    with pytest.raises(ValueError):
        checked(aligned, classes(spark), "ignore")


def test_twenty_thousand_classes(spark):
    """No step has more rows than input rows and classes; no grid in the plan."""
    k = 20_000
    rows = spark.range(3 * k).select(
        F.concat(F.lit("m"), F.col("id") % 1).alias("model_name"), F.concat(F.lit("c"), F.col("id") % k).alias("actual"),
        F.concat(F.lit("c"), F.when(F.col("id") < k, F.col("id") % k).otherwise((F.col("id") + 1) % k)).alias("predicted"),
    )
    names = spark.range(k + 7).select(F.concat(F.lit("c"), "id").alias("class"))
    each = sparse_class_metrics(rows, names)
    r = each.agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"), F.avg("f1").alias("f1")).first()
    assert (r["n"], r["tp"]) == (k + 7, k) and math.isclose(r["f1"], k / 3 / (k + 7))
    summary = sparse_summary(rows, names)
    s = summary.first()
    assert math.isclose(s["accuracy"], 1 / 3) and math.isclose(s["macro_f1"], k / 3 / (k + 7))
    for df in (each, summary):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
