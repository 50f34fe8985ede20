import numpy as np
import pytest
from pyspark.sql import functions as F

import veritally.operators.quantiles as Q
from veritally.operators.latency import latency_box, latency_per_instance, latency_stats
from veritally.operators.quantiles import exact_percentiles

SCHEMA = "model_name string, instance_index long, latency double"


@pytest.mark.parametrize("values", [[100.0], [50.0] * 4, [10.0, 20.0, 30.0, 40.0, 50.0], [1.0, 2.0, 3.0, 4.0, 5.0], [4.0, 1.0]])
def test_closed_forms(rows, values):
    df = rows(SCHEMA, [("m", i, x) for i, x in enumerate(values)])
    [r] = latency_stats(df).collect()
    want = (np.mean(values), np.median(values), np.std(values), min(values), max(values))
    assert tuple(r)[1:] == pytest.approx(want)
    [a] = latency_stats(df, approx=True).collect()
    assert (a["mean"], a["std"]) == pytest.approx((want[0], want[2]))


def test_group_without_values(rows):
    df = rows(SCHEMA, [("m", 0, None), ("n", 0, 2.0), (None, 0, 3.0)])
    got = {r["model_name"]: r["median"] for r in latency_stats(df).collect()}
    assert got == {"m": None, "n": 2.0, None: 3.0}


def skewed(spark):
    """One group with most rows, ties, a long tail and negative values."""
    base = spark.range(60_000)
    return base.select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.exp((F.hash("id") % 1000) / 80.0)) - 3.0).alias("x"),
    )


def test_exact_percentiles_equal_numpy(spark):
    df = skewed(spark)
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = exact_percentiles(df, ["g"], "x", ps, list("abcde"), [F.count("x").alias("n")])
    pdf = df.toPandas()
    got = {r["g"]: r for r in out.collect()}
    assert len(got) == 8
    for g, part in pdf.groupby("g"):
        assert tuple(got[g])[2:] == pytest.approx(tuple(np.quantile(part["x"], ps)), rel=1e-12)
        assert got[g]["n"] == len(part)


def test_brackets_of_a_coarse_sketch(spark, monkeypatch):
    """Real brackets and slices, many rows outside them."""
    monkeypatch.setattr(Q, "ACCURACY", 200)
    monkeypatch.setattr(Q, "SLICES", 7)
    df = skewed(spark)
    ps = [0.1, 0.5, 0.77]
    pdf = df.toPandas()
    for r in exact_percentiles(df, ["g"], "x", ps, ["a", "b", "c"]).collect():
        want = np.quantile(pdf.loc[pdf["g"] == r["g"], "x"], ps)
        assert tuple(r)[1:] == pytest.approx(tuple(want), rel=1e-12)


def test_nan_null_and_empty_groups(rows):
    nan = float("nan")
    df = rows(SCHEMA, [("m", i, nan) for i in range(3)] + [("m", 3, 1.0), ("e", 0, None), (None, 0, 2.0), (None, 1, 4.0)])
    got = {r["model_name"]: r["median"] for r in latency_stats(df).collect()}
    assert np.isnan(got["m"]) and got["e"] is None and got[None] == 3.0
    boxes = {r["model_name"]: r["q3"] for r in latency_box(df).collect()}
    assert boxes[None] == 3.5
    [one] = latency_box(df.where("latency < 5"), by=()).collect()
    assert (one["n"], one["median"]) == (3, 2.0)
    assert exact_percentiles(df.limit(0), ["model_name"], "latency", [0.5], ["x"]).count() == 0


def test_global_percentile(spark):
    [r] = exact_percentiles(skewed(spark), [], "x", [0.5], ["m"]).collect()
    assert r["m"] == pytest.approx(np.median(skewed(spark).toPandas()["x"]))


def test_per_instance_means(rows):
    df = rows(SCHEMA, [("m", 0, 10.0), ("m", 0, 30.0), ("m", 1, 5.0), ("m", 2, 100.0)])
    [r] = latency_per_instance(df).collect()
    assert (r["median"], r["min"], r["max"]) == (20.0, 5.0, 100.0)
    [a] = latency_per_instance(df, approx=True).collect()
    assert a["mean"] == pytest.approx(125 / 3)


def test_box(rows):
    values = [1.0, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 90.0]
    [r] = latency_box(rows(SCHEMA, [("m", i, x) for i, x in enumerate(values)])).collect()
    assert (r["q1"], r["median"], r["q3"]) == (11.0, 13.0, 15.0)
    assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["n"]) == (10.0, 16.0, 2, 9)
