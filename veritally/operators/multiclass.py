"""Multiclass classification over a fixed, ordered class list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import array_literal, checked_class, class_names, known_class
from ..functions.ratios import harmonic, ratio
from .counts import weight

MODEL = ("model_name",)


def unknown_labels(aligned: DataFrame, classes) -> DataFrame:
    """Quarantine: rows with a predicted or actual label outside the list."""
    names = class_names(classes)
    fine = known_class("predicted", names) & (
        F.col("predicted").isNull() | F.coalesce(F.col("actual").isin(names), F.lit(False))
    )
    return aligned.where(~fine)


def cell_counts(
    df: DataFrame, classes, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """``(group, actual, predicted) -> n`` including NULL predictions.

    A label outside the list raises in the task that meets it, or with
    ``quarantine`` is left to :func:`unknown_labels`.
    """
    if on_unknown not in ("error", "quarantine"):
        raise ValueError("on_unknown must be 'error' or 'quarantine'")
    names = class_names(classes)
    n = weight(df)
    counted = df.groupBy(*by, "actual", "predicted").agg(F.sum(n).cast("long").alias("n"))
    if on_unknown == "quarantine":
        fine = known_class("predicted", names) & (
            F.col("predicted").isNull() | F.coalesce(F.col("actual").isin(names), F.lit(False))
        )
        return counted.where(fine)
    # Checked after counting: once per distinct pair, not once per row.
    actual = F.when(
        F.col("predicted").isNotNull(),
        F.coalesce(
            checked_class("actual", names, "actual"),
            F.raise_error(F.lit("missing actual label for a predicted class")).cast("string"),
        ),
    ).otherwise(F.col("actual"))
    return counted.select(
        *by,
        actual.alias("actual"),
        checked_class("predicted", names, "predicted").alias("predicted"),
        "n",
    )


def dense_class_grid(
    cells: DataFrame, classes, by: Sequence[str] = MODEL
) -> DataFrame:
    """All actual x predicted cells of every group, zero filled.

    The cells of a group (at most one per class pair) become a map in one
    aggregation and the class list, a literal, is unrolled over it, so there
    is neither a cross join nor a lookup join.  Groups with NULL predictions
    only keep an all-zero grid.
    """
    names = array_literal(class_names(classes))
    pair = F.struct(F.col("actual").alias("actual"), F.col("predicted").alias("predicted"))
    entry = F.when(
        F.col("predicted").isNotNull(), F.struct(pair.alias("key"), F.col("n").alias("value"))
    )
    grouped = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    return (
        grouped.select(*by, "_cells", F.explode(names).alias("actual"))
        .select(*by, "_cells", "actual", F.explode(names).alias("predicted"))
        .select(
            *by,
            "actual",
            "predicted",
            F.coalesce(
                F.try_element_at("_cells", F.struct("actual", "predicted")), F.lit(0)
            ).cast("long").alias("n"),
        )
    )


def confusion_matrix(
    df: DataFrame, classes, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """Long dense matrix; NULL predictions are in no cell."""
    return dense_class_grid(cell_counts(df, classes, by, on_unknown), classes, by)


def confusion_matrix_wide(
    df: DataFrame, classes, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """One column per predicted class, in class order."""
    dense = confusion_matrix(df, classes, by, on_unknown)
    names = class_names(classes)
    return (
        dense.groupBy(*by, "actual")
        .pivot("predicted", names)
        .agg(F.sum("n"))
        .na.fill(0, names)
    )


def per_class_metrics(matrix: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """precision, recall, f1 and support per class of a dense matrix.

    Each cell contributes to its row class and its column class, so row and
    column totals come from one aggregation without a self join.
    """
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    as_actual = F.struct(
        F.col("actual").alias("class"), F.col("n").alias("support"), zero.alias("picked"), hit.alias("tp")
    )
    as_predicted = F.struct(
        F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("picked"), zero.alias("tp")
    )
    totals = (
        matrix.select(*by, F.explode(F.array(as_actual, as_predicted)).alias("_c"))
        .groupBy(*by, F.col("_c.class").alias("class"))
        .agg(
            F.sum("_c.tp").cast("long").alias("tp"),
            F.sum("_c.support").cast("long").alias("support"),
            F.sum("_c.picked").cast("long").alias("picked"),
        )
    )
    precision, recall = ratio("tp", "picked"), ratio("tp", "support")
    return totals.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        harmonic(precision, recall).alias("f1"),
        "support",
        "tp",
    )


def multiclass_summary(matrix: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """accuracy, macro and support-weighted averages.

    With no non-NULL prediction the accuracy is NaN and the weighted averages
    are plain means of zeros.
    """
    classes = per_class_metrics(matrix, by)
    parts = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = F.when(total > 0, ratio(F.sum("tp"), total)).otherwise(F.lit(float("nan")))
    macro = [F.avg(m).alias(f"macro_{m}") for m in parts]
    weighted = [
        F.when(total > 0, ratio(F.sum(F.col(m) * F.col("support")), total))
        .otherwise(F.avg(m))
        .alias(f"weighted_{m}")
        for m in parts
    ]
    return classes.groupBy(*by).agg(accuracy.alias("accuracy"), *macro, *weighted)


def average_confusion_matrix(
    df: DataFrame, classes, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """Cell means over the observed iterations, exact and truncated to int.

    The published form is the truncated one.
    """
    return average_of(matrix_by_iteration(df, classes, by, on_unknown), by)


def matrix_by_iteration(
    df: DataFrame, classes, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """A dense matrix per iteration; rows without an iteration are in none."""
    return confusion_matrix(df.where(F.col("iteration").isNotNull()), classes, (*by, "iteration"), on_unknown)


def average_of(by_iteration: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """The average from a dense matrix per iteration."""
    mean = F.avg("n")
    return by_iteration.groupBy(*by, "actual", "predicted").agg(
        mean.alias("avg_n"), mean.cast("int").alias("avg_n_trunc")
    )


def per_class_mean(by_iteration: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Mean over iterations of the per-class metrics of a dense matrix per iteration."""
    each = per_class_metrics(by_iteration, (*by, "iteration"))
    return each.groupBy(*by, "class").agg(
        *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")]
    )


def multiclass_accumulative(by_iteration: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Macro mean of the per-class means and micro from the summed matrix.

    Over non-NULL pairs summed false positives equal summed false negatives,
    so micro precision and recall are both trace / total.
    """
    parts = ("precision", "recall", "f1")
    each = per_class_metrics(by_iteration, (*by, "iteration"))
    classes = each.groupBy(*by, "class").agg(
        *[F.avg(m).alias(m) for m in parts],
        F.sum("tp").alias("tp"),
        F.sum("support").alias("support"),
    )
    micro = ratio("tp", "support")
    return (
        classes.groupBy(*by)
        .agg(
            *[F.avg(m).alias(f"macro_{m}") for m in parts],
            F.sum("tp").alias("tp"),
            F.sum("support").alias("support"),
        )
        .select(
            *by,
            *[f"macro_{m}" for m in parts],
            micro.alias("micro_precision"),
            micro.alias("micro_recall"),
            harmonic(micro, micro).alias("micro_f1"),
        )
    )
