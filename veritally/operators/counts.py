"""The one heavy aggregation: aligned rows to outcome counts.

Every classification metric is a function of
``(group, iteration, actual, predicted, actual_safe, predicted_safe) -> n``.
The number of rows here depends on models, iterations and classes, not on the
data, and counts are combined before the shuffle, so a label or model holding
most rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

OUTCOME = ("actual", "predicted", "actual_safe", "predicted_safe")


def outcome_counts(aligned: DataFrame, by: Sequence[str] = ("model_name", "iteration")) -> DataFrame:
    return aligned.groupBy(*by, *OUTCOME).agg(F.count(F.lit(1)).alias("n"))


def weight(df: DataFrame):
    """Row weight: the count column of pre-counted input, else 1."""
    return F.col("n") if "n" in df.columns else F.lit(1).cast("long")
