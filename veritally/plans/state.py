"""Run state that merges: reports of growing runs without their old responses.

A part (a day, a batch of a run) is reduced to two small tables.  ``outcomes``
has per group and outcome the number of responses and, of their latencies,
count, mean, sum of squared deviations, extremes and a quantile sketch.
``instances`` has per instance the safe answers, all answers, and the number
and sum of latencies.  Both merge by addition: counts exactly, moments up to
rounding, quantiles within the sketch's rank error.  Writing a part again
replaces it, so a repeated or late part counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import array_literal, class_names, primary_category, truth_is_safe
from ..functions.ratios import binary_ratios, harmonic, ratio
from ..operators.binary import COUNTS, confusion_counts
from ..operators.counts import OUTCOME
from ..operators.quantiles import attach

MODEL = "model_name"
# Size of a quantile sketch; its ranks are off by less than 1 % of the rows.
SKETCH = 1_000
MOMENTS = ("v_n", "v_mean", "v_m2", "v_min", "v_max", "v_sketch")


def labelled(
    responses: DataFrame, requests: DataFrame, safe: Sequence[str], on: Sequence[str] = ("instance_index",)
) -> DataFrame:
    """Every response with its label and ``matched``, in the columns that metrics read.

    One join; a response without a request has ``matched`` false.
    """
    predicted = F.col("category") if "category" in responses.columns else F.lit(None).cast("string")
    if "categories" in responses.columns:
        predicted = F.coalesce(primary_category("categories"), predicted)
    names = ("category", "categories", "raw_response", "text", "metadata", "score", "timestamp")
    left = responses.withColumn("predicted", predicted).drop(*names)
    right = requests.select(*on, F.col("category").alias("actual"), F.lit(True).alias("_hit"))
    return (
        left.join(right, list(on), "left")
        .withColumn("matched", F.coalesce("_hit", F.lit(False)))
        .withColumn("actual_safe", truth_is_safe("actual", safe))
        .withColumnRenamed("is_safe", "predicted_safe")
        .drop("_hit")
    )


def _sketch(value: Column, k: int = SKETCH) -> Column:
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(k))


def outcome_state(rows: DataFrame, by: Sequence[str] = (MODEL, "iteration"), value: str = "latency") -> DataFrame:
    """The outcomes of labelled rows.  One aggregation, combined before the shuffle."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by, "matched", *OUTCOME).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("v_n"), F.avg(v).alias("v_mean"),
        (F.var_pop(v) * F.count(v)).alias("v_m2"), F.min(v).alias("v_min"), F.max(v).alias("v_max"),
        _sketch(v).alias("v_sketch"),
    )


def _merged() -> list[Column]:
    """Aggregates that merge moments, as deviations from ``_c``, a number near the mean."""
    shift = F.col("v_mean") - F.col("_c")
    return [
        F.sum("v_n").alias("v_n"), F.sum(F.col("v_n") * shift).alias("_d1"),
        F.sum(F.col("v_m2") + F.col("v_n") * shift * shift).alias("_d2"), F.min("v_min").alias("v_min"),
        F.max("v_max").alias("v_max"), F.kll_merge_agg_double("v_sketch", F.lit(SKETCH)).alias("v_sketch"),
    ]


def _settled(df: DataFrame) -> DataFrame:
    """``v_mean`` and ``v_m2`` from the merged deviations."""
    d1, n = F.col("_d1"), F.col("v_n")
    return df.withColumns({
        "v_mean": F.col("_c") + F.try_divide(d1, n), "v_m2": F.greatest(F.col("_d2") - F.try_divide(d1 * d1, n), F.lit(0.0)),
    }).drop("_d1", "_d2")


def _near(df: DataFrame) -> DataFrame:
    """Adds ``_c``, the mean of all values, as one value for all rows."""
    total = df.agg(F.coalesce(F.try_divide(F.sum(F.col("v_n") * F.col("v_mean")), F.sum("v_n")), F.lit(0.0)).alias("_c"))
    return attach(df, total, (), ["_c"])


def merge_outcomes(states: DataFrame, by: Sequence[str] = (MODEL, "iteration")) -> DataFrame:
    """One state from many: the same columns, a row per group and outcome."""
    keys = [*by, "matched", *OUTCOME]
    merged = _near(states).groupBy(*keys).agg(F.sum("n").alias("n"), F.first("_c").alias("_c"), *_merged())
    return _settled(merged).select(*keys, "n", *MOMENTS)


def instance_state(rows: DataFrame, by: Sequence[str] = (MODEL,), on: Sequence[str] = ("instance_index",)) -> DataFrame:
    keys = list(dict.fromkeys((*by, *on)))
    return rows.where("matched").groupBy(*keys).agg(
        F.count_if("predicted_safe").alias("_safe"), F.count(F.lit(1)).alias("_all"),
        F.count("latency").alias("_n"), F.sum("latency").alias("_sum"),
    )


def merge_instances(states: DataFrame, by: Sequence[str] = (MODEL,), on: Sequence[str] = ("instance_index",)) -> DataFrame:
    keys = list(dict.fromkeys((*by, *on)))
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_safe", "_all", "_n", "_sum")])


def instances_of(state: DataFrame) -> DataFrame:
    """Merged instances as the summaries that reports read: with mean latencies."""
    return state.withColumn("latency", F.try_divide("_sum", "_n")).drop("_n", "_sum")


def add_part(
    path: str,
    part: str,
    responses: DataFrame,
    requests: DataFrame,
    safe: Sequence[str],
    by: Sequence[str] = (MODEL,),
    on: Sequence[str] = ("instance_index",),
) -> None:
    """Reduces the responses of one part and stores it under ``path``.

    A part that is there already is replaced.  The join runs once for each of
    the two tables, over the narrow columns only.
    """
    rows = labelled(responses, requests, safe, on)
    for name, state in (("outcomes", outcome_state(rows, (*by, "iteration"))), ("instances", instance_state(rows, by, on))):
        state.withColumn("part", F.lit(part)).hint("rebalance").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("part").parquet(f"{path}/{name}")


def read_state(
    spark: SparkSession, path: str, by: Sequence[str] = (MODEL,), on: Sequence[str] = ("instance_index",)
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, instances) of all parts, merged."""
    return (
        merge_outcomes(spark.read.parquet(f"{path}/outcomes"), (*by, "iteration")),
        merge_instances(spark.read.parquet(f"{path}/instances"), by, on),
    )


def _sets(by: Sequence[str], nested: Sequence[str], more: Sequence[str] = ()) -> list[list[str]]:
    return [[*by, *nested, *more], [*by, *more], [*more]]


def report_levels(state: DataFrame, by: Sequence[str] = (MODEL,), nested: Sequence[str] = ("iteration",)) -> DataFrame:
    """Metrics of every iteration, of every model, and of all together.

    One aggregation by grouping sets over outcomes; ``level`` is the grouping
    id over ``(by, nested)``: 0 for the finest.  ``multi_accuracy`` is that of
    the classes, NaN without any prediction; ``median`` and ``p95`` come from the
    sketch, the other latency numbers are exact.
    """
    hit = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0))
    seen = F.sum(F.when(F.col("predicted").isNotNull(), F.col("n")).otherwise(0))
    grouped = _near(state.where("matched")).groupingSets([[F.col(c) for c in s] for s in _sets(by, nested)], *[F.col(c) for c in (*by, *nested)])
    levels = _settled(grouped.agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), *confusion_counts(F.col("n")),
        hit.alias("_hit"), seen.alias("_seen"), F.first("_c").alias("_c"), *_merged(),
    ))
    return levels.select(
        "level", *by, *nested, "n", *binary_ratios(), *COUNTS,
        F.when(F.col("_seen") > 0, ratio("_hit", "_seen")).otherwise(F.lit(float("nan"))).alias("multi_accuracy"),
        (F.col("n") - F.col("_seen")).alias("unpredicted"),
        F.col("v_mean").alias("mean"), F.sqrt(F.try_divide("v_m2", "v_n")).alias("std"), F.col("v_min").alias("min"), F.col("v_max").alias("max"),
        *[F.when(F.col("v_n") > 0, F.kll_sketch_get_quantile_double("v_sketch", F.lit(q))).alias(c) for q, c in ((0.5, "median"), (0.95, "p95"))],
    )


def class_levels(state: DataFrame, classes, by: Sequence[str] = (MODEL,), nested: Sequence[str] = ("iteration",)) -> DataFrame:
    """Per-class metrics at the same levels, from one aggregation by grouping sets.

    Every level has every class of the list; a class without rows has zeros.
    """
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    parts = F.array(
        F.struct(F.col("actual").alias("class"), n.alias("support"), zero.alias("picked"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), n.alias("picked"), zero.alias("tp")),
    )
    names = class_names(classes)
    # Every group begins with a row of zeros per class.
    groups = state.where("matched").select(*by, *nested).distinct()
    zeros = groups.select(*by, *nested, F.explode(array_literal(names)).alias("class"), *[zero.alias(c) for c in ("support", "picked", "tp")])
    rows = state.where("matched AND predicted IS NOT NULL").select(*by, *nested, F.inline(parts)).where(F.col("class").isin(names)).unionByName(zeros)
    totals = rows.groupingSets(
        [[F.col(c) for c in s] for s in _sets(by, nested, ["class"])], *[F.col(c) for c in (*by, *nested, "class")]
    ).agg(F.grouping_id().alias("_g"), *[F.sum(c).alias(c) for c in ("support", "picked", "tp")])
    precision, recall = ratio("tp", "picked"), ratio("tp", "support")
    return totals.select(
        F.shiftright("_g", 1).cast("int").alias("level"), *by, *nested, "class",
        precision.alias("precision"), recall.alias("recall"), harmonic(precision, recall).alias("f1"), "support", "tp",
    )
