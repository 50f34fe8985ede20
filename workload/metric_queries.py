"""Metrics and comparison views."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.operators.binary import (
    binary_accumulative,
    binary_by_iteration,
    binary_confusion,
    binary_metrics,
)
from veritally.operators.categories import (
    category_distribution,
    performance_by_category,
    performance_by_category_accumulative,
)
from veritally.operators.latency import latency_box, latency_per_instance, latency_stats
from veritally.operators.many_classes import sparse_class_metrics, sparse_summary
from veritally.operators.multiclass import (
    average_confusion_matrix,
    confusion_matrix,
    confusion_matrix_wide,
    multiclass_accumulative,
    multiclass_summary,
    per_class_mean,
    per_class_metrics,
)
from veritally.operators.views import (
    binary_confusion_labeled,
    confusion_normalized,
    metrics_comparison,
    metrics_long,
)
from veritally.plans.report import full_report, multiclass_stats, state_report, stats
from veritally.plans.runs import compare_models, replay_run
from veritally.plans.shared import scratch_path
from veritally.plans.state import add_part, class_levels, labelled, outcome_state, read_state, report_levels

from . import views as v
from .file_queries import aligned, stage_result_objects
from .registry import query, r6, rounded
from .sql import BINARY, f1, ratio

PRF = ("precision", "recall", "f1")
APRF = ("accuracy", *PRF)
LAT = ("mean", "median", "std", "min", "max")

_R_APRF = 'round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1'
_R_PRF = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1'
_R_LAT = "round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, min, max"


def by_iteration(spark, d):
    return confusion_matrix(aligned(spark, d), v.CLASSES, ("model_name", "iteration"))


@query("dense_class_grid", "SELECT model_name, iteration, actual, predicted, n FROM v_cells_iter")
def q_dense_class_grid(spark, d):
    return by_iteration(spark, d)


@query("binary_confusion", "SELECT model_name, tp, tn, fp, fn FROM v_binary")
def q_binary_confusion(spark, d):
    return binary_confusion(aligned(spark, d))


@query("binary_metrics", f"SELECT model_name, {_R_APRF}, tp, tn, fp, fn FROM (SELECT *, {BINARY} FROM v_binary)")
def q_binary_metrics(spark, d):
    return rounded(binary_metrics(aligned(spark, d)), *APRF)


@query("confusion_matrix", "SELECT model_name, actual, predicted, n FROM v_cells")
def q_confusion_matrix(spark, d):
    return confusion_matrix(aligned(spark, d), v.CLASSES)


@query(
    "confusion_matrix_wide",
    """
    SELECT model_name, actual, CAST(sum(n) FILTER (predicted = 'safe') AS BIGINT) AS safe,
      CAST(sum(n) FILTER (predicted = 'unethical') AS BIGINT) AS unethical,
      CAST(sum(n) FILTER (predicted = 'off-topic') AS BIGINT) AS "off-topic"
    FROM v_cells GROUP BY model_name, actual
    """,
)
def q_confusion_matrix_wide(spark, d):
    return confusion_matrix_wide(aligned(spark, d), v.CLASSES)


@query("per_class_metrics", f"SELECT model_name, class, support, tp, {_R_PRF} FROM v_class_metrics")
def q_per_class_metrics(spark, d):
    return rounded(per_class_metrics(confusion_matrix(aligned(spark, d), v.CLASSES)), *PRF)


_MULTI = ("accuracy", "macro_precision", "macro_recall", "macro_f1",
          "weighted_precision", "weighted_recall", "weighted_f1")


@query("multiclass_summary", "SELECT model_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MULTI) + " FROM v_multi")
def q_multiclass_summary(spark, d):
    return rounded(multiclass_summary(confusion_matrix(aligned(spark, d), v.CLASSES)), *_MULTI)


@query("binary_by_iteration", f"SELECT model_name, iteration, {_R_APRF}, tp, tn, fp, fn FROM v_binary_iter_metrics")
def q_binary_by_iteration(spark, d):
    return rounded(binary_by_iteration(aligned(spark, d)), *APRF)


_ACC = ("macro_accuracy", "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall",
        "micro_f1", "avg_tp", "avg_tn", "avg_fp", "avg_fn")


@query("binary_accumulative", "SELECT model_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ACC) + " FROM v_binary_acc")
def q_binary_accumulative(spark, d):
    return rounded(binary_accumulative(aligned(spark, d), v.ITERATIONS), *_ACC)


@query(
    "average_confusion_matrix",
    """
    SELECT model_name, actual, predicted, round(avg(n), 6) AS avg_n, CAST(trunc(avg(n)) AS INTEGER) AS avg_n_trunc
    FROM v_cells_iter GROUP BY model_name, actual, predicted
    """,
)
def q_average_confusion_matrix(spark, d):
    return rounded(average_confusion_matrix(aligned(spark, d), v.CLASSES), "avg_n")


@query("per_class_mean", f"SELECT model_name, class, {_R_PRF} FROM v_class_mean")
def q_per_class_mean(spark, d):
    return rounded(per_class_mean(by_iteration(spark, d)), *PRF)


@query(
    "multiclass_accumulative",
    f"""
    SELECT model_name, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
      round(macro_f1, 6) AS macro_f1, round(micro, 6) AS micro_precision, round(micro, 6) AS micro_recall,
      round({f1("micro", "micro")}, 6) AS micro_f1
    FROM v_multi_acc
    """,
)
def q_multiclass_accumulative(spark, d):
    out = multiclass_accumulative(by_iteration(spark, d))
    return rounded(out, *[c for c in out.columns if c != "model_name"])


@query("latency_stats", f"SELECT model_name, {_R_LAT} FROM v_all_latency")
def q_latency_stats(spark, d):
    return rounded(latency_stats(v.all_responses(spark, d)), "mean", "median", "std")


@query(
    "latency_stats_events",
    """
    SELECT model_name, round(avg(latency), 6) AS mean, round(median(latency), 6) AS median,
      round(stddev_pop(latency), 6) AS std, min(latency) AS min, max(latency) AS max
    FROM v_events GROUP BY model_name
    """,
)
def q_latency_stats_events(spark, d):
    return rounded(latency_stats(v.event_responses(v.table(spark, d, "events"))), "mean", "median", "std")


@query("latency_per_instance", f"SELECT model_name, {_R_LAT.replace('min, max', 'round(min, 6) AS min, round(max, 6) AS max')} FROM v_all_latency_instance")
def q_latency_per_instance(spark, d):
    return rounded(latency_per_instance(v.all_responses(spark, d)), *LAT)


@query(
    "category_distribution",
    "SELECT category, CAST(count(*) * 5 AS BIGINT) AS n_rows, count(*) AS n_instances FROM v_requests GROUP BY category",
)
def q_category_distribution(spark, d):
    return category_distribution(v.requests(spark, d), v.ITERATIONS)


@query(
    "performance_by_category",
    """
    SELECT model_name, actual AS category, count(*) AS total, CAST(count(*) FILTER (is_safe = actual_safe) AS BIGINT) AS correct,
      round(CAST(count(*) FILTER (is_safe = actual_safe) AS DOUBLE) / count(*), 6) AS accuracy
    FROM v_responses GROUP BY model_name, actual
    """,
)
def q_performance_by_category(spark, d):
    return rounded(performance_by_category(aligned(spark, d)), "accuracy")


@query(
    "performance_by_category_accumulative",
    "SELECT model_name, category, total, round(correct, 6) AS correct, round(accuracy, 6) AS accuracy FROM v_perf_acc",
)
def q_performance_by_category_accumulative(spark, d):
    out = performance_by_category_accumulative(v.responses(spark, d), v.requests(spark, d), v.SAFE)
    return rounded(out, "correct", "accuracy")


_R_LAT5 = ", ".join(f"round(l.{c}, 6) AS latency_{c}" for c in LAT)


@query(
    "stats",
    f"""
    SELECT b.model_name, b.tp, b.tn, b.fp, b.fn, {_R_APRF}, {_R_LAT5}
    FROM (SELECT *, {BINARY} FROM v_binary) b JOIN v_latency l ON b.model_name = l.model_name
    """,
)
def q_stats(spark, d):
    out = stats(aligned(spark, d))
    return rounded(out, *APRF, *[f"latency_{c}" for c in LAT])


@query(
    "multiclass_stats",
    "SELECT b.model_name, " + ", ".join(f"round(b.{c}, 6) AS {c}" for c in _MULTI)
    + f", {_R_LAT5} FROM v_multi b JOIN v_latency l ON b.model_name = l.model_name",
)
def q_multiclass_stats(spark, d):
    out = multiclass_stats(aligned(spark, d), v.CLASSES, responses=v.responses(spark, d))
    return rounded(out, *_MULTI, *[f"latency_{c}" for c in LAT])


def _flat_report(report):
    b, m = F.col("binary"), F.col("multiclass")
    perf = F.try_element_at("performance_by_category", F.lit("unethical"))
    return report.select(
        "model_name", "n_rows", "n_instances", "iterations", "accumulative",
        *[r6(b["macro_mean"][c]).alias(f"macro_{c}") for c in APRF],
        r6(b["micro"]["f1"]).alias("micro_f1"),
        *[r6(b["average_confusion_matrix"][c]).alias(f"avg_{c}") for c in ("tp", "tn", "fp", "fn")],
        *[r6(m["macro_mean"][c]).alias(f"multi_macro_{c}") for c in PRF],
        r6(m["micro"]["f1"]).alias("multi_micro_f1"),
        *[r6(F.try_element_at("per_class", F.lit("unethical"))[c]).alias(f"unethical_{c}") for c in PRF],
        F.try_element_at(
            F.try_element_at("confusion_matrix", F.lit("unethical")), F.lit("safe")
        ).alias("unethical_as_safe"),
        *[r6(F.col("latency")[c]).alias(f"latency_{c}") for c in LAT],
        *[r6(F.col("latency_per_instance")[c]).alias(f"instance_latency_{c}") for c in LAT],
        F.try_element_at("category_distribution", F.lit("safe")).alias("safe_rows"),
        perf["total"].alias("unethical_total"), r6(perf["accuracy"]).alias("unethical_accuracy"),
    )


_REPORT_SQL = f"""
    SELECT b.model_name, (SELECT count(*) * 5 FROM v_requests) AS n_rows,
      (SELECT count(*) FROM v_requests) AS n_instances, 5 AS iterations, true AS accumulative,
      round(b.macro_accuracy, 6) AS macro_accuracy, round(b.macro_precision, 6) AS macro_precision,
      round(b.macro_recall, 6) AS macro_recall, round(b.macro_f1, 6) AS macro_f1, round(b.micro_f1, 6) AS micro_f1,
      round(avg_tp, 6) AS avg_tp, round(avg_tn, 6) AS avg_tn, round(avg_fp, 6) AS avg_fp, round(avg_fn, 6) AS avg_fn,
      round(m.macro_precision, 6) AS multi_macro_precision, round(m.macro_recall, 6) AS multi_macro_recall,
      round(m.macro_f1, 6) AS multi_macro_f1, round({f1("m.micro", "m.micro")}, 6) AS multi_micro_f1,
      round(c."precision", 6) AS unethical_precision, round(c.recall, 6) AS unethical_recall, round(c.f1, 6) AS unethical_f1,
      x.n AS unethical_as_safe,
      {", ".join(f"round(l.{c}, 6) AS latency_{c}" for c in LAT)},
      {", ".join(f"round(i.{c}, 6) AS instance_latency_{c}" for c in LAT)},
      (SELECT count(*) * 5 FROM v_requests WHERE category = 'safe') AS safe_rows,
      p.total AS unethical_total, round(p.accuracy, 6) AS unethical_accuracy
    FROM v_binary_acc b
    JOIN v_multi_acc m ON b.model_name = m.model_name
    JOIN v_class_mean c ON b.model_name = c.model_name AND c.class = 'unethical'
    JOIN (SELECT model_name, CAST(trunc(avg(n)) AS INTEGER) AS n FROM v_cells_iter
          WHERE actual = 'unethical' AND predicted = 'safe' GROUP BY model_name) x ON b.model_name = x.model_name
    JOIN v_latency l ON b.model_name = l.model_name
    JOIN v_latency_instance i ON b.model_name = i.model_name
    JOIN v_perf_acc p ON b.model_name = p.model_name AND p.category = 'unethical'
"""


@query("full_report", _REPORT_SQL)
def q_full_report(spark, d):
    report = full_report(
        v.responses(spark, d), v.requests(spark, d), v.CLASSES, v.SAFE, v.ITERATIONS, "documents"
    )
    return _flat_report(report)


@query(
    "full_report_single",
    f"""
    SELECT b.model_name, (SELECT count(*) FROM v_requests) AS n_instances, 1 AS iterations,
      {_R_APRF.replace("accuracy, 6", "b.accuracy, 6")}, b.tp, b.tn, b.fp, b.fn,
      round(m.weighted_f1, 6) AS weighted_f1, round(m.accuracy, 6) AS multi_accuracy, x.n AS unethical_as_safe,
      round(l.median, 6) AS latency_median
    FROM (SELECT *, {BINARY} FROM v_binary) b JOIN v_multi m ON b.model_name = m.model_name
    JOIN (SELECT model_name, n FROM v_cells WHERE actual = 'unethical' AND predicted = 'safe') x ON b.model_name = x.model_name
    JOIN v_latency l ON b.model_name = l.model_name
    """,
)
def q_full_report_single(spark, d):
    """All responses taken as one iteration."""
    report = full_report(v.responses(spark, d), v.requests(spark, d), v.CLASSES, v.SAFE, 1)
    b, m = F.col("binary"), F.col("multiclass")
    return report.select(
        "model_name", "n_instances", "iterations", *[r6(b[c]).alias(c) for c in APRF],
        *[b[c].alias(c) for c in ("tp", "tn", "fp", "fn")],
        r6(m["weighted_f1"]).alias("weighted_f1"), r6(m["accuracy"]).alias("multi_accuracy"),
        F.try_element_at(
            F.try_element_at("confusion_matrix", F.lit("unethical")), F.lit("safe")
        ).alias("unethical_as_safe"),
        r6(F.col("latency.median")).alias("latency_median"),
    )


@query("replay_run", _REPORT_SQL.replace(
    "(SELECT count(*) * 5 FROM v_requests)", "(SELECT count(DISTINCT instance_index) * 5 FROM v_responses)"
).replace(
    "(SELECT count(*) FROM v_requests)", "(SELECT count(DISTINCT instance_index) FROM v_responses)"
))
def q_replay_run(spark, d):
    """Predictions saved as result files, read back and reported again."""
    path = stage_result_objects(spark, d)
    return _flat_report(replay_run(spark, path, v.CLASSES, v.SAFE, v.ITERATIONS, lines=True))


@query(
    "compare_models",
    """
    SELECT b.model_name, round(macro_accuracy, 6) AS accuracy, round(macro_precision, 6) AS "precision",
      round(macro_recall, 6) AS recall, round(macro_f1, 6) AS f1, round(l.mean, 6) AS mean_latency,
      round(l.median, 6) AS median_latency
    FROM v_binary_acc b JOIN v_latency l ON b.model_name = l.model_name
    """,
)
def q_compare_models(spark, d):
    out = compare_models(v.responses(spark, d), v.requests(spark, d), v.CLASSES, v.SAFE, v.ITERATIONS)
    return rounded(out, *APRF, "mean_latency", "median_latency")


@query(
    "confusion_normalized",
    f"""
    SELECT model_name, actual, predicted, n,
      round({ratio("n", "sum(n) OVER (PARTITION BY model_name, actual)")}, 6) AS share
    FROM v_cells
    """,
)
def q_confusion_normalized(spark, d):
    return rounded(confusion_normalized(confusion_matrix(aligned(spark, d), v.CLASSES)), "share")


@query(
    "binary_confusion_labeled",
    """
    SELECT model_name, unnest(['safe', 'safe', 'unsafe', 'unsafe']) AS actual,
      unnest(['safe', 'unsafe', 'safe', 'unsafe']) AS predicted, unnest([tp, fn, fp, tn]) AS n FROM v_binary
    """,
)
def q_binary_confusion_labeled(spark, d):
    return binary_confusion_labeled(binary_confusion(aligned(spark, d)))


_BOX_SQL = """
    SELECT b.model_name, b.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(least(min(latency) FILTER (latency >= q1 - 1.5 * (q3 - q1)), q1), 6) AS whisker_low,
      round(greatest(max(latency) FILTER (latency <= q3 + 1.5 * (q3 - q1)), q3), 6) AS whisker_high,
      CAST(count(*) FILTER (latency < q1 - 1.5 * (q3 - q1) OR latency > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
    FROM {0} r JOIN (
      SELECT model_name, count(latency) AS n, quantile_cont(latency, 0.25) AS q1, median(latency) AS median,
        quantile_cont(latency, 0.75) AS q3 FROM {0} GROUP BY model_name) b ON r.model_name = b.model_name
    GROUP BY b.model_name, b.n, q1, median, q3
"""
_BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("latency_box", _BOX_SQL.format("v_events"))
def q_latency_box(spark, d):
    return rounded(latency_box(v.event_responses(v.table(spark, d, "events"))), *_BOX)


@query("latency_box_responses", _BOX_SQL.format("v_all_responses"))
def q_latency_box_responses(spark, d):
    return rounded(latency_box(v.all_responses(spark, d)), *_BOX)


@query(
    "metrics_comparison",
    f"""
    SELECT model_name, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, 0.0::DOUBLE AS auc
    FROM (SELECT *, {BINARY} FROM v_binary)
    """,
)
def q_metrics_comparison(spark, d):
    """A metric no model has is reported as 0."""
    long = metrics_long(binary_metrics(aligned(spark, d)), APRF)
    return rounded(metrics_comparison(long, ("accuracy", "f1", "auc")), "accuracy", "f1")


@query(
    "metrics_comparison_multiclass",
    "SELECT model_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MULTI[:4]) + " FROM v_multi",
)
def q_metrics_comparison_multiclass(spark, d):
    summary = multiclass_summary(confusion_matrix(aligned(spark, d), v.CLASSES))
    return rounded(metrics_comparison(metrics_long(summary, _MULTI[:4]), _MULTI[:4]), *_MULTI[:4])


_LEVEL_PARTS = """
    , v_levels AS (
      SELECT CAST(GROUPING_ID(model_name, iteration) AS INTEGER) AS level, model_name, iteration, count(*) AS n,
        CAST(count(*) FILTER (is_safe AND actual_safe) AS BIGINT) AS tp,
        CAST(count(*) FILTER (NOT is_safe AND NOT actual_safe) AS BIGINT) AS tn,
        CAST(count(*) FILTER (is_safe AND NOT actual_safe) AS BIGINT) AS fp,
        CAST(count(*) FILTER (NOT is_safe AND actual_safe) AS BIGINT) AS fn,
        count(*) FILTER (predicted = actual) AS hit, count(predicted) AS seen,
        avg(latency) AS mean, stddev_pop(latency) AS std, min(latency) AS min, max(latency) AS max
      FROM v_responses GROUP BY GROUPING SETS ((model_name, iteration), (model_name), ()))
"""
_LEVELS_SQL = _LEVEL_PARTS + f"""
    SELECT level, model_name, iteration, n, {_R_APRF}, tp, tn, fp, fn, round(CAST(hit AS DOUBLE) / seen, 6) AS multi_accuracy,
      n - seen AS unpredicted, round(mean, 6) AS mean, round(std, 6) AS std, min, max
    FROM (SELECT *, {BINARY} FROM v_levels)
"""


@query("report_levels", _LEVELS_SQL)
def q_report_levels(spark, d):
    """Iterations, models and everything, from one aggregation by grouping sets."""
    out = report_levels(outcome_state(labelled(v.responses(spark, d), v.requests(spark, d), v.SAFE)))
    return rounded(out.drop("median", "p95"), *APRF, "multi_accuracy", "mean", "std")


@query(
    "class_levels",
    f"""
    , v_pairs AS (
      SELECT r.model_name, r.iteration, c.class, CAST(r.actual = c.class AS BIGINT) AS support, CAST(r.predicted = c.class AS BIGINT) AS picked,
        CAST(r.actual = c.class AND r.predicted = c.class AS BIGINT) AS tp
      FROM v_responses r CROSS JOIN v_classes c WHERE r.predicted IS NOT NULL),
    v_sums AS (
      SELECT CAST(GROUPING_ID(model_name, iteration) AS INTEGER) AS level, model_name, iteration, class, CAST(sum(support) AS BIGINT) AS support,
        CAST(sum(picked) AS BIGINT) AS picked, CAST(sum(tp) AS BIGINT) AS tp
      FROM v_pairs GROUP BY GROUPING SETS ((model_name, iteration, class), (model_name, class), (class)))
    SELECT level, model_name, iteration, class, {_R_PRF}, support, tp
    FROM (SELECT *, {ratio("tp", "picked")} AS "precision", {ratio("tp", "support")} AS recall,
            {f1(ratio("tp", "picked"), ratio("tp", "support"))} AS f1 FROM v_sums)
    """,
)
def q_class_levels(spark, d):
    state = outcome_state(labelled(v.responses(spark, d), v.requests(spark, d), v.SAFE))
    return rounded(class_levels(state, v.CLASSES), *PRF)


def stage_state(spark, d) -> str:
    """Run state of five parts, one of them written twice."""
    path = scratch_path(spark, "run-state")
    responses, requests = v.responses(spark, d), v.requests(spark, d)
    for part in (*range(5), 3):
        add_part(path, f"part-{part}", responses.where(F.col("instance_index") % 5 == part), requests, v.SAFE)
    return path


@query("merged_state_levels", _LEVELS_SQL)
def q_merged_state_levels(spark, d):
    """The same levels from stored parts that were reduced one by one."""
    outcomes, _ = read_state(spark, stage_state(spark, d))
    return rounded(report_levels(outcomes).drop("median", "p95"), *APRF, "multi_accuracy", "mean", "std")


@query("state_report", _REPORT_SQL.replace(", round(l.median, 6) AS latency_median", ""))
def q_state_report(spark, d):
    """The full report from stored parts; its latency median is a sketch's, so it is not compared."""
    outcomes, instances = read_state(spark, stage_state(spark, d))
    report = state_report(outcomes, instances, v.requests(spark, d), v.CLASSES, v.SAFE, v.ITERATIONS, "documents")
    return _flat_report(report).drop("latency_median")


# Order lines as answers: the part is the label, and two in three lines name it.
_MANY_SQL = f"""
    , v_lines AS (
      SELECT l_returnflag AS model_name, 'p' || l_partkey AS actual,
        CASE WHEN l_linenumber % 7 = 6 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'p' || (1 + l_suppkey) ELSE 'p' || l_partkey END AS predicted
      FROM lineitem),
    v_names AS (SELECT DISTINCT 'p' || p_partkey AS class FROM part UNION SELECT 'p' || (1 + s_suppkey) FROM supplier),
    v_rows AS (SELECT model_name, actual AS class, count(*) AS support FROM v_lines WHERE predicted IS NOT NULL GROUP BY ALL),
    v_cols AS (SELECT model_name, predicted AS class, count(*) AS picked FROM v_lines WHERE predicted IS NOT NULL GROUP BY ALL),
    v_diag AS (SELECT model_name, actual AS class, count(*) AS tp FROM v_lines WHERE predicted = actual GROUP BY ALL),
    v_many AS (
      SELECT g.model_name, c.class, coalesce(t.tp, 0) AS tp, coalesce(r.support, 0) AS support, coalesce(p.picked, 0) AS picked
      FROM (SELECT DISTINCT model_name FROM v_lines) g CROSS JOIN v_names c
      LEFT JOIN v_rows r ON r.model_name = g.model_name AND r.class = c.class
      LEFT JOIN v_cols p ON p.model_name = g.model_name AND p.class = c.class
      LEFT JOIN v_diag t ON t.model_name = g.model_name AND t.class = c.class),
    v_many_metrics AS (
      SELECT *, {ratio("tp", "picked")} AS "precision", {ratio("tp", "support")} AS recall,
        {f1(ratio("tp", "picked"), ratio("tp", "support"))} AS f1 FROM v_many)
"""


def many_class_rows(spark, d):
    """(aligned rows, class table): as many classes as there are parts."""
    part = F.concat(F.lit("p"), "l_partkey")
    other = F.concat(F.lit("p"), F.col("l_suppkey") + 1)
    line = F.col("l_linenumber")
    rows = v.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model_name"), part.alias("actual"),
        F.when(line % 7 == 6, None).when(line % 3 == 0, other).otherwise(part).alias("predicted"),
    )
    names = v.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("class")).union(
        v.table(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") + 1))
    )
    return rows, names


@query("many_class_metrics", _MANY_SQL + f"SELECT model_name, class, {_R_PRF}, support, tp FROM v_many_metrics")
def q_many_class_metrics(spark, d):
    """Per-class metrics of thousands of classes."""
    return rounded(sparse_class_metrics(*many_class_rows(spark, d)), *PRF)


@query(
    "many_class_summary",
    _MANY_SQL + """
    SELECT model_name, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
      round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
      round(sum("precision" * support) / sum(support), 6) AS weighted_precision,
      round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1
    FROM v_many_metrics GROUP BY model_name
    """,
)
def q_many_class_summary(spark, d):
    return rounded(sparse_summary(*many_class_rows(spark, d)), *_MULTI)
