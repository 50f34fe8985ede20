"""Latency statistics: population deviation and interpolating median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ratios import _col
from .quantiles import attach, exact_percentiles

MODEL = ("model_name",)
FIELDS = ("mean", "median", "std", "min", "max")


def moments(value: str = "latency"):
    return [
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def latency_stats(
    responses: DataFrame,
    by: Sequence[str] = MODEL,
    approx: bool = False,
    value: str = "latency",
) -> DataFrame:
    """mean, median, population std, min and max per group.

    The median is exact by default; ``approx=True`` takes it from a sketch in
    the single pass of the other statistics.
    """
    return with_median(responses, by, approx, value).select(*by, *FIELDS)


def with_median(rows: DataFrame, by: Sequence[str], approx: bool, value: str = "latency", extra=()) -> DataFrame:
    """Latency statistics and any ``extra`` aggregates of the same groups."""
    if approx:
        median = F.percentile_approx(value, 0.5).alias("median")
        return rows.groupBy(*by).agg(*extra, *moments(value), median)
    return exact_percentiles(rows, by, value, [0.5], ["median"], [*extra, *moments(value)])


def instance_means(
    responses: DataFrame, by: Sequence[str] = MODEL, value: str = "latency"
) -> DataFrame:
    """Mean latency of every instance; combined before the shuffle."""
    return responses.groupBy(*by, "instance_index").agg(F.avg(value).alias(value))


def latency_per_instance(
    responses: DataFrame, by: Sequence[str] = MODEL, approx: bool = False
) -> DataFrame:
    """Statistics over the per-instance means.

    The exact median reads the means twice; the plan shuffles them once and
    reuses that exchange.
    """
    return latency_stats(instance_means(responses, by), by, approx)


def latency_box(
    responses: DataFrame, by: Sequence[str] = MODEL, value: str = "latency"
) -> DataFrame:
    """Box-plot numbers: exact quartiles, 1.5 IQR whiskers, outlier count.

    A whisker ends at the farthest value inside its fence, or at the quartile
    when none lies beyond it.
    """
    by = list(by)
    names = ["q1", "median", "q3"]
    box = exact_percentiles(
        responses, by, value, [0.25, 0.5, 0.75], names, [F.count(value).alias("n")]
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    fenced = box.select(
        *by, *names, "n", (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi")
    )
    v = _col(value)
    ends = (
        attach(responses.select(*by, value).where(v.isNotNull()), fenced, by, [*names, "n", "_lo", "_hi"])
        .groupBy(*by, *names, "n")
        .agg(
            F.min(F.when(v >= F.col("_lo"), v)).alias("_low"),
            F.max(F.when(v <= F.col("_hi"), v)).alias("_high"),
            F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("outliers"),
        )
    )
    return ends.select(
        *by,
        "n",
        *names,
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
        "outliers",
    )
