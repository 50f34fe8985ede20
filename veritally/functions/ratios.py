"""Ratios that turn an empty denominator into 0.0 instead of an ANSI error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator, denominator) -> Column:
    """``numerator / denominator`` as DOUBLE, 0.0 when the denominator is 0."""
    top = _col(numerator).cast("double")
    return F.coalesce(F.try_divide(top, _col(denominator).cast("double")), F.lit(0.0))


def harmonic(precision, recall) -> Column:
    """F1 of a precision and a recall, 0.0 when both are 0."""
    p, r = _col(precision), _col(recall)
    return ratio(F.lit(2.0) * (p * r), p + r)


def binary_ratios(tp="tp", tn="tn", fp="fp", fn="fn") -> list[Column]:
    """accuracy, precision, recall and f1 from four counts; safe is positive."""
    tp, tn, fp, fn = (_col(c) for c in (tp, tn, fp, fn))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        harmonic(precision, recall).alias("f1"),
    ]
