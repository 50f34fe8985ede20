"""Scoring, monitoring and streaming."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from veritally.functions.keywords import KEYWORD_RULES, NO_HIT
from veritally.operators.align import align_predictions
from veritally.operators.binary import binary_metrics
from veritally.operators.monitoring import (
    classify_failures,
    failure_summary,
    peak_concurrency,
    run_log_summary,
)
from veritally.operators.parsing import keyword_classify
from veritally.operators.requests import expand_iterations
from veritally.operators.scoring import score_requests, scored_failures, scored_responses
from veritally.plans.resume import resume_run
from veritally.plans.runs import evaluate_run
from veritally.plans.shared import scratch_path
from veritally.sources.run_logs import scan_run_logs
from veritally.streaming.stateful import ROCKSDB, slot_changes, slot_counts, stream_peak_concurrency
from veritally.streaming.progress import (
    latest_complete,
    run_progress,
    start_append,
    start_complete,
    windowed_confusion,
)

from . import views as v
from .file_queries import errors, run_of, stage_logs
from .registry import query, rounded
from .request_queries import _KEYWORD_SQL
from .sql import BINARY

# The Python classifier below travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FLAGSHIP_SQL = f"""
    , v_kw AS (
      SELECT 'keyword' AS model_name, p = 'none' AS is_safe, category = 'safe' AS actual_safe
      FROM (SELECT category, {_KEYWORD_SQL} AS p FROM (SELECT category, lower(text) AS t FROM v_requests)))
    SELECT model_name, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
      round(recall, 6) AS recall, round(f1, 6) AS f1, tp, tn, fp, fn
    FROM (SELECT *, {BINARY} FROM (
      SELECT model_name, count(*) FILTER (is_safe AND actual_safe) AS tp,
        count(*) FILTER (NOT is_safe AND NOT actual_safe) AS tn, count(*) FILTER (is_safe AND NOT actual_safe) AS fp,
        count(*) FILTER (NOT is_safe AND actual_safe) AS fn FROM v_kw GROUP BY model_name))
"""


@query("evaluate_keywords", _FLAGSHIP_SQL)
def q_evaluate_keywords(spark, d) -> DataFrame:
    """Flagship: labelled documents, keyword verdicts on whole texts, keyed
    pairing and binary metrics."""
    requests = v.requests(spark, d)
    verdicts = keyword_classify(requests.select("instance_index", "text")).select(
        F.lit("keyword").alias("model_name"), "instance_index", "is_safe", F.col("predicted").alias("category")
    )
    rows = align_predictions(verdicts, requests, v.SAFE)
    return rounded(binary_metrics(rows), "accuracy", "precision", "recall", "f1")


def make_keyword_classifier():
    """The keyword rules as a plain Python classifier; an empty text is an error."""

    def one(text: str) -> dict:
        if not text:
            raise ValueError("empty text")
        low = text.lower()
        name = next((n for n, words in KEYWORD_RULES if any(w in low for w in words)), NO_HIT)
        return {"is_safe": name == NO_HIT, "category": name}

    return lambda texts: [one(t) for t in texts]


def _prompts(spark, d) -> DataFrame:
    """Whole texts; the requests without one fail."""
    return v.prompts(spark, d).select(
        "instance_index", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("category")
    )


_SCORED_SQL = """
    , v_p AS (SELECT instance_index, iteration, coalesce(text, '') AS text
              FROM v_prompts CROSS JOIN (VALUES (0), (1)) i(iteration))
"""


@query(
    "score_requests",
    _SCORED_SQL + f"""
    SELECT 'keyword' AS model_name, instance_index, iteration, category,
      coalesce(category = 'none', false) AS is_safe, CASE WHEN category IS NULL THEN NULL ELSE -1.0::DOUBLE END AS score,
      CASE WHEN category IS NULL THEN 'ValueError: empty text' END AS error
    FROM (SELECT instance_index, iteration, CASE WHEN text = '' THEN NULL ELSE {_KEYWORD_SQL} END AS category
          FROM (SELECT *, lower(text) AS t FROM v_p))
    """,
)
def q_score_requests(spark, d):
    expanded = expand_iterations(_prompts(spark, d), 2)
    return score_requests(expanded, "keyword", make_keyword_classifier, batch_size=16).select(
        "model_name", "instance_index", "iteration", "category",
        F.coalesce("is_safe", F.lit(False)).alias("is_safe"), "score", "error",
    )


@query(
    "evaluate_run",
    _SCORED_SQL + f"""
    SELECT 'keyword' AS model_name, instance_index, iteration, {_KEYWORD_SQL} AS category
    FROM (SELECT *, lower(text) AS t FROM v_p WHERE text <> '')
    """,
)
def q_evaluate_run(spark, d):
    """Prompts without text are quarantined, the rest scored once and stored."""
    run = evaluate_run(_prompts(spark, d), {"keyword": make_keyword_classifier}, iterations=2)
    return run.responses.select("model_name", "instance_index", "iteration", "category")


@query(
    "run_log_summary",
    """
    SELECT run, max(split_part(run, '-', 1)) AS model_name, (SELECT count(*) FROM v_all_requests) AS samples,
      CAST(max(regexp_extract(message, 'Got (\\d+) responses', 1)) FILTER (message LIKE 'Completed%') AS BIGINT) AS responses,
      max(ts_s) FILTER (message LIKE 'Completed%') - max(ts_s) FILTER (message LIKE 'Evaluating%') AS seconds,
      count(*) FILTER (level = 'ERROR') AS errors
    FROM v_log GROUP BY run
    """,
)
def q_run_log_summary(spark, d):
    lines = run_of(scan_run_logs(spark, stage_logs(spark, d)))
    return run_log_summary(lines, ("run",)).drop("per_second")


_FAILURES_SQL = """
    , v_f AS (
      SELECT *, regexp_matches(error, '^(429 RESOURCE_EXHAUSTED|Quota exceeded)') AS quota FROM v_errors),
    v_c AS (
      SELECT model_name, instance_index, iteration, quota AND attempt < 3 AS retryable,
        CASE WHEN quota THEN 'quota' ELSE trim(split_part(error, ':', 1)) END AS error_class,
        CASE WHEN quota AND attempt < 3 THEN
          CASE WHEN error LIKE '%retry in %' THEN CAST(regexp_extract(error, 'retry in (\\d+\\.?\\d*)s', 1) AS DOUBLE) + 1
               ELSE greatest(5.0, least(60.0, power(2.0, attempt - 1))) END END AS wait_seconds
      FROM v_f)
"""


@query(
    "failure_summary",
    _FAILURES_SQL + """
    SELECT model_name, error_class, retryable, count(*) AS failures, CAST(max(wait_seconds) AS DOUBLE) AS max_wait_seconds
    FROM v_c GROUP BY ALL
    """,
)
def q_failure_summary(spark, d):
    return failure_summary(errors(spark, d))


@query(
    "classify_failures",
    _FAILURES_SQL + """
    SELECT model_name, instance_index, iteration, error_class, retryable, CAST(wait_seconds AS DOUBLE) AS wait_seconds FROM v_c
    """,
)
def q_classify_failures(spark, d):
    return classify_failures(errors(spark, d)).drop("attempt", "error")


@query(
    "peak_concurrency",
    """
    SELECT model_name, CAST(max(running) AS BIGINT) AS peak_calls FROM (
      SELECT model_name, sum(step) OVER (PARTITION BY model_name ORDER BY t, step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM (SELECT model_name, ts_s * 1000000 AS t, -1 AS step FROM v_all_responses
            UNION ALL SELECT model_name, ts_s * 1000000 - CAST(latency * 1000 AS BIGINT), 1 FROM v_all_responses))
    GROUP BY model_name
    """,
)
def q_peak_concurrency(spark, d):
    return peak_concurrency(v.all_responses(spark, d))


@query(
    "stream_run_progress",
    """
    SELECT model_name, count(*) AS finished, count(*) FILTER (is_safe) AS safe, epoch_us(max(ts)) AS last_us
    FROM v_events GROUP BY model_name
    """,
)
def q_stream_run_progress(spark, d):
    out, checkpoint = scratch_path(spark, "progress"), scratch_path(spark, "progress-checkpoint")
    start_complete(run_progress(v.event_stream(spark, d)), out, checkpoint).awaitTermination()
    return latest_complete(spark, out).select(
        "model_name", "finished", "safe", F.unix_micros("last_seen").alias("last_us")
    )


@query(
    "stream_windowed_confusion",
    """
    , v_joined AS (
      SELECT e.model_name, CAST(floor(epoch(e.ts) / 3600) AS BIGINT) * 3600 AS start_s, e.is_safe,
        q.category = 'safe' AS actual_safe
      FROM v_events e JOIN v_requests q ON e.instance_index = q.instance_index)
    SELECT model_name, start_s, count(*) FILTER (is_safe AND actual_safe) AS tp,
      count(*) FILTER (NOT is_safe AND NOT actual_safe) AS tn, count(*) FILTER (is_safe AND NOT actual_safe) AS fp,
      count(*) FILTER (NOT is_safe AND actual_safe) AS fn
    FROM v_joined GROUP BY model_name, start_s
    HAVING start_s + 3600 <= (SELECT epoch(max(ts)) - 600 FROM v_events)
    """,
)
def q_stream_windowed_confusion(spark, d):
    """Closed windows only: the watermark holds the last ones back."""
    out, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-checkpoint")
    stream = windowed_confusion(
        v.event_stream(spark, d).drop("latency"), v.requests(spark, d), v.SAFE, width="1 hour", delay="10 minutes"
    )
    start_append(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(
        "model_name", F.unix_seconds("window_start").alias("start_s"), "tp", "tn", "fp", "fn"
    )


@query(
    "resume_run",
    _SCORED_SQL + f"""
    SELECT 'keyword' AS model_name, instance_index, iteration, {_KEYWORD_SQL} AS category, 1::BIGINT AS writes
    FROM (SELECT *, lower(text) AS t FROM v_p WHERE text <> '')
    """,
)
def q_resume_run(spark, d):
    """A run over half of the prompts, taken up again with all: every slot is scored once."""
    path, prompts = scratch_path(spark, "slots"), _prompts(spark, d)
    resume_run(prompts.where("instance_index % 2 = 0"), {"keyword": make_keyword_classifier}, path, 2)
    store = resume_run(prompts, {"keyword": make_keyword_classifier}, path, 2)
    writes = spark.read.parquet(path).groupBy("instance_index", "iteration").agg(F.count(F.lit(1)).alias("writes"))
    return store.join(writes, ["instance_index", "iteration"]).select(
        "model_name", "instance_index", "iteration", "category", "writes"
    )


def run_stateful(spark, stream: DataFrame, name: str) -> DataFrame:
    """What a stream with state of its own emits until its input is read."""
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, x in ROCKSDB.items():
        spark.conf.set(k, x)
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n={n:06d}")
        ).start().awaitTermination()
    finally:
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    return spark.read.parquet(out)


@query(
    "stream_slot_counts",
    """
    SELECT model_name, category, count(*) AS slots, CAST(count(*) FILTER (is_safe) AS BIGINT) AS safe FROM (
      SELECT model_name, CASE WHEN h % 4 = 0 THEN 'rewritten' ELSE predicted END AS category,
        CASE WHEN h % 4 = 0 THEN NOT is_safe ELSE is_safe END AS is_safe
      FROM v_responses) GROUP BY ALL
    """,
)
def q_stream_slot_counts(spark, d):
    """Every slot is written, every fourth branch again later; an old write comes last."""
    path = scratch_path(spark, "writes")
    base = v.responses(spark, d, keep_branch=True).select("model_name", "instance_index", "iteration", "is_safe", "category", "timestamp", "h")
    again = base.where("h % 4 = 0").withColumns({"is_safe": ~F.col("is_safe"), "category": F.lit("rewritten")})
    shifted = lambda df, s: df.withColumn("timestamp", F.timestamp_seconds(F.unix_seconds("timestamp") + s))
    files = spark.sparkContext.defaultParallelism
    for part in (base, shifted(again, 60), shifted(again.withColumn("category", F.lit("old")), -60)):
        part.drop("h").repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    return slot_counts(run_stateful(spark, slot_changes(stream), "slot-changes"))


@query(
    "stream_peak_concurrency",
    """
    SELECT model_name, CAST(max(running) AS BIGINT) AS peak_calls FROM (
      SELECT model_name, sum(step) OVER (PARTITION BY model_name ORDER BY t, step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM (SELECT model_name, epoch_us(ts) AS t, -1 AS step FROM v_events
            UNION ALL SELECT model_name, epoch_us(ts) - CAST(round(latency * 60000 * 1000) AS BIGINT), 1 FROM v_events))
    GROUP BY model_name
    """,
)
def q_stream_peak_concurrency(spark, d):
    """Events as calls of so many minutes, out of order within two files; two late rows let the watermark pass all."""
    path = scratch_path(spark, "calls")
    calls = v.event_responses(v.table(spark, d, "events")).select("model_name", (F.col("latency") * 60_000).alias("latency"), "timestamp")
    for part in (calls.orderBy(F.xxhash64("timestamp")), *[
        calls.groupBy("model_name").agg(F.lit(0.0).alias("latency"), (F.max("timestamp") + F.make_interval(days=F.lit(9_000 + k))).alias("timestamp"))
        for k in range(2)
    ]):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    peaks = run_stateful(spark, stream_peak_concurrency(stream, "10 minutes"), "peaks")
    return peaks.groupBy("model_name").agg(F.max("peak_calls").alias("peak_calls"))
