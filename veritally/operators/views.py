"""The tables behind comparison charts and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ratios import ratio

MODEL = ("model_name",)


def confusion_normalized(
    matrix: DataFrame,
    by: Sequence[str] = MODEL,
    label_counts: DataFrame | None = None,
    n: str = "n",
) -> DataFrame:
    """Each cell over its row total, or over supplied ``(actual, total)`` counts.

    An empty row gives 0.0.  The window holds one row per class.
    """
    if label_counts is None:
        total = F.sum(n).over(Window.partitionBy(*by, "actual"))
        return matrix.withColumn("share", ratio(n, total))
    counts = label_counts.select("actual", F.col("total").alias("_total"))
    return (
        matrix.join(counts, "actual", "left")
        .withColumn("share", ratio(n, F.coalesce("_total", F.lit(0))))
        .drop("_total")
    )


def binary_confusion_labeled(counts: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """The four counts as a safe/unsafe matrix, actual by predicted."""
    cells = (("safe", "safe", "tp"), ("safe", "unsafe", "fn"),
             ("unsafe", "safe", "fp"), ("unsafe", "unsafe", "tn"))
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")
            )
            for a, p, c in cells
        ]
    )
    return counts.select(*by, F.inline(entries))


def metrics_long(wide: DataFrame, metrics: Sequence[str], by: Sequence[str] = MODEL) -> DataFrame:
    """One row per group and metric."""
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return wide.select(*by, F.inline(entries))


def metrics_comparison(
    long: DataFrame,
    metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1"),
    by: Sequence[str] = MODEL,
) -> DataFrame:
    """Chosen metrics side by side per model; a missing metric is 0."""
    names = list(metrics)
    return (
        long.groupBy(*by).pivot("metric", names).agg(F.first("value", ignorenulls=True)).na.fill(0.0, names)
    )


def run_summary(
    wide: DataFrame,
    metrics: Sequence[str],
    by: Sequence[str] = MODEL,
    digits: int = 4,
    **config: str,
) -> DataFrame:
    """Flat summary ``(config..., group, metric, value)`` to four decimals.

    ``config`` (experiment, dataset and the like) becomes constant columns.
    """
    values = metrics_long(wide, metrics, by).withColumn("value", F.round("value", digits))
    return values.select(*[F.lit(text).alias(name) for name, text in config.items()], "*")
