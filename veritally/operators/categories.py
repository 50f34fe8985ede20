"""Per-label views of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import truth_is_safe
from ..functions.ratios import ratio
from .counts import weight
from .quantiles import attach

MODEL = ("model_name",)


def category_distribution(requests: DataFrame, iterations: int = 1) -> DataFrame:
    """Instances and expanded rows per label, sorted; NULL is a label.

    Each instance stands for ``iterations`` expanded rows, so nothing is
    expanded to be counted.
    """
    n = F.count(F.lit(1))
    return (
        requests.groupBy("category")
        .agg(
            (n * F.lit(max(1, int(iterations)))).cast("long").alias("n_rows"),
            n.alias("n_instances"),
        )
        .orderBy("category")
    )


def performance_by_category(aligned: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """total, correct and accuracy per label; correct means the safe verdict agrees."""
    n = weight(aligned)
    correct = F.coalesce(
        F.sum(F.when(F.col("predicted_safe") == F.col("actual_safe"), n)), F.lit(0)
    )
    return (
        aligned.groupBy(*by, F.col("actual").alias("category"))
        .agg(F.sum(n).cast("long").alias("total"), correct.cast("long").alias("correct"))
        .withColumn("accuracy", ratio("correct", "total"))
    )


def _labels_per_group(groups: DataFrame, totals: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """Every label with its total for every group that has responses.

    The labels (of the group's dataset or run, if those are part of the keys)
    become one list in an aggregation, which every group unrolls: the wanted
    rows themselves, without a limit.
    """
    labels = totals.groupBy(*shared).agg(F.collect_list(F.struct("category", "total")).alias("_l"))
    return attach(groups, labels, shared, ["_l"]).select(*by, F.inline("_l"))


def instance_summary(
    responses: DataFrame, by: Sequence[str] = MODEL, on: Sequence[str] = ("instance_index",)
) -> DataFrame:
    """Per instance: safe answers, answers and mean latency.

    The one aggregation by instance that both the accumulative label view and
    the per-instance latencies need; combined before the shuffle.
    """
    return responses.groupBy(*dict.fromkeys((*by, *on))).agg(
        F.count_if(F.col("is_safe")).alias("_safe"),
        F.count(F.lit(1)).alias("_all"),
        F.avg("latency").alias("latency"),
    )


def performance_by_category_accumulative(
    responses: DataFrame,
    requests: DataFrame,
    safe: Sequence[str],
    by: Sequence[str] = MODEL,
    on: Sequence[str] = ("instance_index",),
) -> DataFrame:
    """Mean instance accuracy over iterations, summed and averaged per label.

    Responses are matched to labels by instance key.  (Matching the expanded
    row number against the original index, a known slip of published numbers
    for such runs, scores every row past the first copy 0.)

    Responses shrink to two counters per instance before the label join, and
    instances to ``(label, safe answers, answers)`` counts after it.  An
    instance without responses counts in ``total`` and adds 0.
    """
    return performance_of_instances(instance_summary(responses, by, on), requests, safe, by, on)


def performance_of_instances(
    per_instance: DataFrame,
    requests: DataFrame,
    safe: Sequence[str],
    by: Sequence[str] = MODEL,
    on: Sequence[str] = ("instance_index",),
) -> DataFrame:
    """The same from an :func:`instance_summary`."""
    by = list(by)
    shared = [c for c in by if c in on]
    labels = requests.select(*on, "category")
    kinds = (
        per_instance.join(labels, list(on), "inner")
        .groupBy(*by, "category", "_safe", "_all")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    agreed = F.when(truth_is_safe("category", safe), F.col("_safe")).otherwise(
        F.col("_all") - F.col("_safe")
    )
    scored = kinds.groupBy(*by, "category").agg(
        F.sum(ratio(agreed, "_all") * F.col("_n")).alias("_correct")
    )
    totals = labels.groupBy(*shared, "category").agg(F.count(F.lit(1)).alias("total"))
    grid = _labels_per_group(kinds.select(*by).distinct(), totals, by, shared)
    match = [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "category")]
    return (
        grid.alias("g")
        .join(scored.alias("s"), match, "left")
        .select(
            *[F.col(f"g.{c}").alias(c) for c in (*by, "category")],
            F.col("g.total").alias("total"),
            F.coalesce(F.col("s._correct"), F.lit(0.0)).alias("correct"),
        )
        .withColumn("accuracy", ratio("correct", "total"))
    )
