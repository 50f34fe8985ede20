"""Multiclass metrics over very many classes, without a class x class grid.

A matrix of 20,000 classes has 400 million cells, nearly all of them zero.
Here only cells that occur exist; per class the row sum (support), column sum
(picked) and diagonal (tp) are enough for every metric, and what is not there
is zero.  The class list is a table, joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ratios import harmonic, ratio
from .counts import weight
from .quantiles import attach

MODEL = ("model_name",)
PARTS = ("precision", "recall", "f1")


def occurring_cells(aligned: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """``(group, actual, predicted) -> n`` of the pairs that occur; no NULL prediction."""
    return (
        aligned.where(F.col("predicted").isNotNull())
        .groupBy(*by, "actual", "predicted")
        .agg(F.sum(weight(aligned)).cast("long").alias("n"))
    )


def outside_labels(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Cells with a label that is not in ``classes(class)``; NULL is none."""
    known = classes.select("class").distinct()
    fine = cells.join(known.withColumnRenamed("class", "actual"), "actual", "left_semi").join(
        known.withColumnRenamed("class", "predicted"), "predicted", "left_semi"
    )
    return cells.exceptAll(fine.select(*cells.columns))


def class_totals(cells: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """tp, support and picked of every class that occurs in a group.

    Every cell leaves its count with its row class and its column class,
    combined before the one shuffle; a class that most rows have is no hot key.
    """
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    parts = F.array(
        F.struct(F.col("actual").alias("class"), n.alias("support"), zero.alias("picked"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), n.alias("picked"), zero.alias("tp")),
    )
    return cells.select(*by, F.inline(parts)).groupBy(*by, "class").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("tp", "support", "picked")]
    )


def _with_metrics(totals: DataFrame) -> DataFrame:
    precision, recall = ratio("tp", "picked"), ratio("tp", "support")
    return totals.withColumns({"precision": precision, "recall": recall, "f1": harmonic(precision, recall)})


def checked(cells: DataFrame, classes: DataFrame, on_unknown: str = "error") -> DataFrame:
    """Cells whose labels are both in the class table; others raise or are left out."""
    if on_unknown not in ("error", "quarantine"):
        raise ValueError("on_unknown must be 'error' or 'quarantine'")
    out = cells
    for side in ("actual", "predicted"):
        known = classes.select(F.col("class").alias("_class"), F.lit(True).alias(f"_{side}")).distinct()
        out = out.join(known, F.col(side) == F.col("_class"), "left").drop("_class")
    fine = F.col("_actual").isNotNull() & F.col("_predicted").isNotNull()
    if on_unknown == "quarantine":
        return out.where(fine).select(*cells.columns)
    message = F.concat(F.lit("label outside the class list: "), F.coalesce("actual", F.lit("NULL")), F.lit(" / "), F.col("predicted"))
    n = F.when(fine, F.col("n")).otherwise(F.raise_error(message).cast("long"))
    return out.withColumn("n", n).select(*cells.columns)


def sparse_class_metrics(
    aligned: DataFrame, classes: DataFrame, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """precision, recall, f1, support and tp of every class of ``classes(class)`` in every group.

    One row per group and class, as many as are asked for: classes that do not
    occur are added as zeros.
    """
    by = list(by)
    totals = class_totals(checked(occurring_cells(aligned, by), classes, on_unknown), by)
    # The groups are few; every class row unrolls their list.
    groups = aligned.select(*by).distinct().agg(F.collect_list(F.struct(*by) if by else F.struct(F.lit(0))).alias("_g"))
    zeros = attach(classes.select("class").distinct(), groups, (), ["_g"]).select("class", F.inline("_g")).select(
        *by, "class", *[F.lit(0).cast("long").alias(c) for c in ("tp", "support", "picked")]
    )
    every = totals.unionByName(zeros).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "picked")])
    return _with_metrics(every).select(*by, "class", *PARTS, "support", "tp")


def sparse_summary(
    aligned: DataFrame, classes: DataFrame, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """accuracy, macro and support-weighted averages over all classes of the table.

    Only classes that occur have rows; the macro averages divide by the number
    of classes.  A group with NULL predictions only has NaN accuracy and zeros.
    """
    by = list(by)
    each = _with_metrics(class_totals(checked(occurring_cells(aligned, by), classes, on_unknown), by))
    size = classes.agg(F.count_distinct("class").alias("_k"))
    total = F.sum("support")
    sums = each.groupBy(*by).agg(
        F.sum("tp").alias("_tp"), total.alias("_all"),
        *[F.sum(m).alias(f"_{m}") for m in PARTS],
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in PARTS],
    )
    kept = [c for c in sums.columns if c not in by]
    out = attach(attach(aligned.select(*by).distinct(), sums, by, kept, "left"), size, (), ["_k"])
    return out.select(
        *by,
        F.when(F.col("_all") > 0, ratio("_tp", "_all")).otherwise(F.lit(float("nan"))).alias("accuracy"),
        *[F.coalesce(ratio(f"_{m}", "_k"), F.lit(0.0)).alias(f"macro_{m}") for m in PARTS],
        *[F.coalesce(f"weighted_{m}", F.lit(0.0)).alias(f"weighted_{m}") for m in PARTS],
    )


def sparse_accumulative(
    aligned: DataFrame, classes: DataFrame, by: Sequence[str] = MODEL, on_unknown: str = "error"
) -> DataFrame:
    """Macro mean over iterations and micro from the summed matrix, as the dense form has them.

    A class that an iteration lacks has zeros there, so its mean divides by
    the group's iterations; rows without an iteration are in none.
    """
    by = list(by)
    rows = aligned.where(F.col("iteration").isNotNull())
    keys = [*by, "iteration"]
    each = _with_metrics(class_totals(checked(occurring_cells(rows, keys), classes, on_unknown), keys))
    sums = each.groupBy(*by).agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_all"), *[F.sum(m).alias(f"_{m}") for m in PARTS]
    )
    seen = rows.select(*keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_i"))
    size = classes.agg(F.count_distinct("class").alias("_k"))
    out = attach(attach(seen, sums, by, ["_tp", "_all", *[f"_{m}" for m in PARTS]], "left"), size, (), ["_k"])
    micro = F.coalesce(ratio("_tp", "_all"), F.lit(0.0))
    return out.select(
        *by,
        *[F.coalesce(ratio(F.col(f"_{m}"), F.col("_k") * F.col("_i")), F.lit(0.0)).alias(f"macro_{m}") for m in PARTS],
        micro.alias("micro_precision"), micro.alias("micro_recall"), harmonic(micro, micro).alias("micro_f1"),
    )
