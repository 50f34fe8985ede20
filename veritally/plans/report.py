"""The full report of a run: one row per model with nested metrics.

The responses are read and joined with their labels once, into a written table
of the few columns that metrics need; outcome counts, instance summaries and
latency statistics derive from it.  A lost executor costs no more than its
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.labels import class_names
from ..functions.ratios import binary_ratios
from ..operators.binary import COUNTS, binary_accumulative, binary_metrics, confusion_counts
from ..operators.categories import (
    instance_summary,
    performance_by_category,
    performance_of_instances,
)
from ..operators.counts import OUTCOME, outcome_counts, weight
from ..operators.latency import FIELDS, latency_stats, with_median
from ..operators.quantiles import attach
from ..operators.multiclass import (
    average_of,
    confusion_matrix,
    matrix_by_iteration,
    multiclass_accumulative,
    multiclass_summary,
    per_class_mean,
    per_class_metrics,
)
from .shared import written
from .state import instances_of, labelled, report_levels

MODEL = "model_name"


def _nested(df: DataFrame, by: Sequence[str], name: str, fields: Sequence[str]) -> DataFrame:
    return df.select(*by, F.struct(*fields).alias(name))


def _per_class_map(df: DataFrame, by: Sequence[str], name: str, fields: Sequence[str], key: str = "class") -> DataFrame:
    """One map entry per class; a group has one row per class here.

    A NULL class is the entry of the empty name; where a class of that name
    exists too, it is told apart by a NUL character.
    """
    both = F.max(F.col(key) == "").over(Window.partitionBy(*by))
    named = F.coalesce(F.col(key), F.when(both, F.lit("\0")).otherwise(F.lit("")))
    df = df.withColumn("_name", named)
    entry = F.struct(F.col("_name").alias("key"), F.struct(*fields).alias("value"))
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def _matrix_map(matrix: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """actual -> (predicted -> value), from one row per class pair."""
    cell = F.struct(F.col("predicted").alias("key"), F.col(value).alias("value"))
    rows = matrix.groupBy(*by, "actual").agg(
        F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("row")
    )
    entry = F.struct(F.col("actual").alias("key"), F.col("row").alias("value"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def _distribution(requests: DataFrame, iterations: int, shared: Sequence[str]) -> DataFrame:
    """Per dataset or run, if those are part of the keys: label -> expanded
    rows, and the number of requests.  A NULL label counts as an empty one."""
    labels = requests.groupBy(*shared, F.coalesce("category", F.lit("")).alias("key")).agg(
        (F.count(F.lit(1)) * max(1, int(iterations))).alias("value"), F.count(F.lit(1)).alias("_k")
    )
    return labels.groupBy(*shared).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("category_distribution"),
        F.coalesce(F.sum("_k"), F.lit(0)).alias("_n"),
    )


def _joined(tables: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One row per group from all parts."""
    out = tables[0]
    for t in tables[1:]:
        out = attach(out, t, by, [c for c in t.columns if c not in by], "left")
    return out


def full_report(
    responses: DataFrame,
    requests: DataFrame,
    classes,
    safe: Sequence[str],
    iterations: int = 1,
    dataset: str = "dataset",
    on_unknown: str = "error",
    approx_latency: bool = False,
    by: Sequence[str] = (MODEL,),
    on: Sequence[str] = ("instance_index",),
) -> DataFrame:
    """All metrics of a run, single or accumulative by ``iterations``.

    One row per ``by``.  ``on`` is the key of a request; name ``dataset`` and
    ``run`` in both when the tables hold several.  ``n_rows`` counts expanded
    rows and ``n_instances`` requests; ``iterations`` is always present, and
    ``n_unmatched`` counts a group's responses without a request: they are in
    no metric.  No response at all is an error.  The labelled rows, outcome
    counts and instance summaries are written to the shared folder once; the
    rest is one lazy plan over them.
    """
    by = list(by)
    known = [c for c in on if c in responses.columns]
    if len(known) < len(on):
        raise ValueError("the responses lack a part of the request key")
    # The only read of the responses, and the only join: narrow rows that all parts share.
    keys = list(dict.fromkeys((*by, *on)))
    rows = written(
        labelled(responses, requests, safe, on).select(*keys, "iteration", "matched", *OUTCOME, "latency"), "labelled"
    )
    matched = rows.where("matched")
    counts = written(outcome_counts(matched, (*by, "iteration")), "counts")
    unmatched = rows.where("NOT matched").groupBy(*by).agg(F.count(F.lit(1)).alias("n_unmatched"))
    instances = None
    if iterations > 1:
        instances = written(instance_summary(matched.withColumnRenamed("predicted_safe", "is_safe"), by, on), "instances")
    latency = latency_stats(matched, by, approx_latency)
    return _report(counts, unmatched, instances, latency, requests, classes, safe, iterations, dataset, on_unknown, approx_latency, by, on)


def state_report(
    outcomes: DataFrame,
    instances: DataFrame,
    requests: DataFrame,
    classes,
    safe: Sequence[str],
    iterations: int = 1,
    dataset: str = "dataset",
    on_unknown: str = "error",
    by: Sequence[str] = (MODEL,),
    on: Sequence[str] = ("instance_index",),
) -> DataFrame:
    """The report of merged run state (:mod:`veritally.plans.state`).

    Reads no response.  Everything is as in :func:`full_report` but the median
    of all latencies, which comes from the sketch.
    """
    by = list(by)
    outcomes = written(outcomes, "outcomes")
    matched = outcomes.where("matched")
    unmatched = outcomes.where("NOT matched").groupBy(*by).agg(F.sum("n").alias("n_unmatched"))
    kept = written(instances_of(instances), "instances") if iterations > 1 else None
    latency = report_levels(outcomes, by).where(F.col("level") == 1).select(*by, *FIELDS)
    counts = matched.select(*by, "iteration", *OUTCOME, "n")
    return _report(counts, unmatched, kept, latency, requests, classes, safe, iterations, dataset, on_unknown, False, by, on)


def _report(counts, unmatched, instances, latency, requests, classes, safe, iterations, dataset, on_unknown, approx, by, on) -> DataFrame:
    """The report from its small tables."""
    names, shared = class_names(classes), [c for c in by if c in on]
    if counts.isEmpty():
        raise ValueError("no predictions to measure")
    head = attach(counts.select(*by).distinct(), _distribution(requests, iterations, shared), shared, ["category_distribution", "_n"], "left")
    head = attach(head, unmatched, by, ["n_unmatched"], "left")
    head = head.select(
        *by,
        *([] if "dataset" in by else [F.lit(dataset).alias("dataset")]),
        (F.col("_n") * max(1, iterations)).cast("long").alias("n_rows"),
        F.col("_n").cast("long").alias("n_instances"),
        F.lit(int(iterations)).alias("iterations"),
        F.lit(iterations > 1).alias("accumulative"),
        F.coalesce("n_unmatched", F.lit(0)).cast("long").alias("n_unmatched"),
        "category_distribution",
    )
    tables = [head]
    if iterations > 1:
        performance = performance_of_instances(instances, requests, safe, by, on)
        per_instance = latency_stats(instances, by, approx)
        tables += _accumulative(counts, performance, names, iterations, on_unknown, by)
        tables.append(_nested(per_instance, by, "latency_per_instance", FIELDS))
    else:
        tables += _single(counts, names, on_unknown, by)
    tables.append(_nested(latency, by, "latency", FIELDS))
    return _joined(tables, by)


def _accumulative(counts, performance, names, iterations, on_unknown, by) -> list[DataFrame]:
    binary = binary_accumulative(counts, iterations, by)
    binary = binary.select(
        *by,
        F.struct(
            F.struct(*[F.col(f"macro_{m}").alias(m) for m in ("accuracy", "precision", "recall", "f1")])
            .alias("macro_mean"),
            F.struct(*[F.col(f"micro_{m}").alias(m) for m in ("precision", "recall", "f1")]).alias("micro"),
            F.struct(*[F.col(f"avg_{c}").alias(c) for c in ("tp", "tn", "fp", "fn")])
            .alias("average_confusion_matrix"),
        ).alias("binary"),
    )
    dense = matrix_by_iteration(counts, names, by, on_unknown)
    multi = multiclass_accumulative(dense, by)
    multi = multi.select(
        *by,
        F.struct(
            F.struct(*[F.col(f"macro_{m}").alias(m) for m in ("precision", "recall", "f1")])
            .alias("macro_mean"),
            F.struct(*[F.col(f"micro_{m}").alias(m) for m in ("precision", "recall", "f1")]).alias("micro"),
        ).alias("multiclass"),
    )
    return [
        binary,
        multi,
        _matrix_map(average_of(dense, by), by, "confusion_matrix", "avg_n_trunc"),
        _per_class_map(per_class_mean(dense, by), by, "per_class", ("precision", "recall", "f1")),
        _per_class_map(
            performance, by, "performance_by_category", ("total", "correct", "accuracy"), "category"
        ),
    ]


def _single(counts, names, on_unknown, by) -> list[DataFrame]:
    binary = _nested(
        binary_metrics(counts, by), by, "binary",
        ("accuracy", "precision", "recall", "f1", "tp", "tn", "fp", "fn"),
    )
    matrix = confusion_matrix(counts, names, by, on_unknown)
    summary = multiclass_summary(matrix, by)
    return [
        binary,
        _nested(summary, by, "multiclass", [c for c in summary.columns if c not in by]),
        _matrix_map(matrix, by, "confusion_matrix", "n"),
        _per_class_map(per_class_metrics(matrix, by), by, "per_class", ("precision", "recall", "f1", "support")),
        _per_class_map(
            performance_by_category(counts, by), by, "performance_by_category",
            ("total", "correct", "accuracy"), "category",
        ),
    ]


def _prefixed(latency: DataFrame, by: Sequence[str]) -> DataFrame:
    return latency.select(*by, *[F.col(f).alias(f"latency_{f}") for f in FIELDS])


def stats(
    aligned: DataFrame, by: Sequence[str] = (MODEL,), approx: bool = False, responses: DataFrame | None = None
) -> DataFrame:
    """Binary metrics plus latency statistics when the rows carry latencies.

    Counts and moments share one pass over the rows.  With ``responses`` given
    the latencies are those of all responses, matched or not, and their passes
    need no label join.
    """
    if responses is not None:
        return attach(binary_metrics(aligned, by), _prefixed(latency_stats(responses, by, approx), by), by,
                      [f"latency_{f}" for f in FIELDS], "left")
    if "latency" not in aligned.columns:
        return binary_metrics(aligned, by)
    both = with_median(aligned, by, approx, extra=confusion_counts(weight(aligned)))
    return both.select(
        *by, *binary_ratios(), *COUNTS, *[F.col(f).alias(f"latency_{f}") for f in FIELDS]
    )


def multiclass_stats(
    aligned: DataFrame,
    classes,
    by: Sequence[str] = (MODEL,),
    on_unknown: str = "error",
    approx: bool = False,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Multiclass summary plus latency statistics when the rows carry latencies.

    With ``responses`` given the latencies are read from them, which spares
    their passes the label join.
    """
    out = multiclass_summary(confusion_matrix(aligned, classes, by, on_unknown), by)
    source = responses if responses is not None else aligned
    if "latency" not in source.columns:
        return out
    return out.join(_prefixed(latency_stats(source, by, approx), by), list(by), "left")
