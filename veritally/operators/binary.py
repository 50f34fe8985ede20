"""Safe / unsafe classification; safe is the positive class.

All functions take aligned rows (``predicted_safe``, ``actual_safe``) or
pre-counted rows with an ``n`` column, and a list of group columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ratios import binary_ratios, harmonic, ratio
from .counts import weight

COUNTS = ("tp", "tn", "fp", "fn")


def confusion_counts(n) -> list:
    """tp, tn, fp and fn as aggregates over rows of weight ``n``."""
    p, t = F.col("predicted_safe"), F.col("actual_safe")
    cases = {"tp": p & t, "tn": ~p & ~t, "fp": p & ~t, "fn": ~p & t}
    return [
        F.coalesce(F.sum(F.when(case, n)), F.lit(0)).cast("long").alias(name)
        for name, case in cases.items()
    ]


def binary_confusion(df: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_counts(weight(df)))


def binary_metrics(df: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """accuracy, precision, recall, f1 and the four counts per group.

    A global aggregate (``by=()``) over no rows raises: there is nothing to
    measure.
    """
    counts = binary_confusion(df, by)
    if not by:
        size = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
        empty = F.raise_error(F.lit("no predictions to measure")).cast("long")
        counts = counts.withColumn("tp", F.when(size > 0, F.col("tp")).otherwise(empty))
    return counts.select(*by, *binary_ratios(), *COUNTS)


def binary_by_iteration(df: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    return binary_metrics(df, (*by, "iteration"))


def binary_accumulative(
    df: DataFrame, iterations: int, by: Sequence[str] = ("model_name",)
) -> DataFrame:
    """Macro means over iterations, micro from summed counts, mean counts.

    Only iterations 0 .. ``iterations`` - 1 count; rows of others, and of no
    iteration, are left out.  Macro means skip iterations without rows; the
    mean counts divide by the requested number of iterations.
    """
    asked = (F.col("iteration") >= 0) & (F.col("iteration") < int(iterations))
    per_iteration = binary_by_iteration(df.where(asked), by)
    macro = [
        F.avg(m).alias(f"macro_{m}") for m in ("accuracy", "precision", "recall", "f1")
    ]
    sums = [F.sum(c).alias(c) for c in COUNTS]
    micro_p = ratio("tp", F.col("tp") + F.col("fp"))
    micro_r = ratio("tp", F.col("tp") + F.col("fn"))
    return (
        per_iteration.groupBy(*by)
        .agg(*macro, *sums)
        .select(
            *by,
            "macro_accuracy", "macro_precision", "macro_recall", "macro_f1",
            micro_p.alias("micro_precision"),
            micro_r.alias("micro_recall"),
            harmonic(micro_p, micro_r).alias("micro_f1"),
            *[(F.col(c) / F.lit(float(iterations))).alias(f"avg_{c}") for c in COUNTS],
        )
    )
