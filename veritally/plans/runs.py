"""Whole runs: evaluate a dataset, replay saved predictions, compare models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.align import align_predictions, dedupe_slots, failed_requests
from ..operators.binary import binary_accumulative, binary_metrics
from ..operators.counts import outcome_counts
from ..operators.latency import latency_stats
from ..operators.quantiles import attach
from ..operators.requests import cross_models, expand_iterations, invalid_requests, valid_requests
from ..operators.scoring import score_requests, scored_failures, scored_responses
from ..sources.result_files import RUN_KEY, scan_results, split_results
from .report import full_report
from .shared import scratch_path


@dataclass(frozen=True)
class RunTables:
    """Lazy tables of a run."""

    requests: DataFrame
    responses: DataFrame
    failures: DataFrame
    invalid: DataFrame


def _stored(scored: DataFrame, path: str | None) -> DataFrame:
    """Scored rows through a written table: a classifier is expensive and may
    not be deterministic, so it must run once and not again for each reader
    or lost block."""
    spark = scored.sparkSession
    path = path or scratch_path(spark, "scored")
    scored.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def evaluate_run(
    requests: DataFrame,
    models: Mapping[str, Callable[[], Callable]],
    iterations: int = 1,
    batch_size: int = 64,
    max_concurrency: int | None = None,
    store: str | None = None,
) -> RunTables:
    """Score every request with every model and split off the failures."""
    good = valid_requests(requests)
    expanded = expand_iterations(good, iterations)
    scored = None
    for name, make in models.items():
        one = score_requests(expanded, name, make, batch_size, max_concurrency)
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        raise ValueError("no model given")
    rows = _stored(scored, store)
    responses = dedupe_slots(scored_responses(rows))
    return RunTables(good, responses, scored_failures(rows), invalid_requests(requests))


def missing_slots(
    requests: DataFrame, responses: DataFrame, models: Sequence[str], iterations: int
) -> DataFrame:
    """Every expected call that has no response."""
    expected = expand_iterations(
        cross_models(requests.select("instance_index"), models), iterations
    ).drop("exp_index")
    return failed_requests(expected, responses)


def replay_run(
    spark: SparkSession, path: str, classes, safe: Sequence[str], iterations: int, lines: bool = False
) -> DataFrame:
    """The report recomputed from saved predictions, one row per model,
    dataset and run; needs no model.

    The JSON is parsed once into a columnar table in the shared folder, without
    texts: requests are told by their key and label.
    """
    table = scratch_path(spark, "replayed")
    scan_results(spark, path, lines).drop("raw_response", "metadata", "text").write.parquet(table)
    requests, responses = split_results(spark.read.parquet(table))
    return full_report(
        responses, requests, classes, safe, iterations, by=("model_name", "dataset", "run"), on=RUN_KEY
    )


def compare_models(
    responses: DataFrame, requests: DataFrame, classes, safe: Sequence[str], iterations: int = 1
) -> DataFrame:
    """The headline numbers of all models: binary metrics from the outcome
    counts, joined with latency statistics; nothing per class or instance."""
    counts = outcome_counts(align_predictions(responses, requests, safe))
    parts = ("accuracy", "precision", "recall", "f1")
    if iterations > 1:
        binary = binary_accumulative(counts, iterations).select("model_name", *[F.col(f"macro_{m}").alias(m) for m in parts])
    else:
        binary = binary_metrics(counts).select("model_name", *parts)
    latency = latency_stats(responses).select(
        "model_name", F.col("mean").alias("mean_latency"), F.col("median").alias("median_latency")
    )
    return attach(binary, latency, ["model_name"], ["mean_latency", "median_latency"], "left")
