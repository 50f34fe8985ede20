"""Operating a run: logs, failures, calls in flight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ratios import ratio

# Fixed patterns of the quota rule; the first must match from the start.
QUOTA_PATTERN = r"\A(429 RESOURCE_EXHAUSTED|Quota exceeded)"
RETRY_HINT = r"retry in (\d+\.?\d*)s"
ATTEMPTS = 3
BACKOFF_MIN, BACKOFF_MAX = 5.0, 60.0


def run_log_summary(lines: DataFrame, by: Sequence[str] = ("source_file",)) -> DataFrame:
    """Per log: model, samples, responses, evaluation seconds, rate, errors.

    Input is the output of ``scan_run_logs``; every field is a conditional
    maximum or count, combined before the shuffle.
    """
    msg = F.col("message")

    def number(pattern: str):
        return F.max(
            F.when(msg.rlike(pattern), F.regexp_extract(msg, pattern, 1).cast("long"))
        )

    start = r"\AEvaluating (.+) on \d+ samples\z"
    done = r"\ACompleted evaluation\. Got (\d+) responses\z"
    started = F.max(F.when(msg.rlike(start), F.col("ts")))
    ended = F.max(F.when(msg.rlike(done), F.col("ts")))
    seconds = F.unix_timestamp(ended) - F.unix_timestamp(started)
    return lines.groupBy(*by).agg(
        F.max(F.when(msg.rlike(start), F.regexp_extract(msg, start, 1))).alias("model_name"),
        number(r"\ALoaded (\d+) samples from dataset\z").alias("samples"),
        number(done).alias("responses"),
        seconds.alias("seconds"),
        F.when(seconds > 0, ratio(number(done), seconds)).alias("per_second"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
    )


def classify_failures(failures: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Error class and advised wait per failure.

    Only quota errors are worth retrying, and only until ``attempts`` calls
    were made: the wait is the hinted time plus one second, else exponential
    in the attempt, between 5 and 60 seconds.
    """
    error = F.coalesce("error", F.lit(""))
    quota = error.rlike(QUOTA_PATTERN)
    hint = F.nullif(F.regexp_extract(error, RETRY_HINT, 1), F.lit("")).cast("double")
    attempt = F.col("attempt") if "attempt" in failures.columns else F.lit(1)
    # The exponent is bounded first: 2^6 is already past the longest wait.
    doubling = F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(6)).cast("double"))
    backoff = F.greatest(F.lit(BACKOFF_MIN), F.least(F.lit(BACKOFF_MAX), doubling))
    name = F.trim(F.substring_index(error, ":", 1))
    again = quota & (attempt < int(attempts))
    return failures.withColumns(
        {
            "error_class": F.when(quota, F.lit("quota")).otherwise(name),
            "retryable": again,
            "wait_seconds": F.when(again, F.coalesce(hint + 1.0, backoff)),
        }
    )


def failure_summary(failures: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    return (
        classify_failures(failures)
        .groupBy(*by, "error_class", "retryable")
        .agg(F.count(F.lit(1)).alias("failures"), F.max("wait_seconds").alias("max_wait_seconds"))
    )


def peak_concurrency(
    responses: DataFrame, by: Sequence[str] = ("model_name",), bucket_seconds: int = 60
) -> DataFrame:
    """Most calls in flight at once per group.

    A call lasts from ``timestamp - latency`` to ``timestamp``; a call ending
    at an instant is over before one starting then, so the count after all
    changes of an instant is the highest within it.  The running count is
    split by time bucket so that a group with most of the rows is still many
    tasks: equal instants are counted together first, each bucket is swept on
    its own, and the count carried in from earlier buckets is a running sum
    over one row per bucket.
    """
    by = list(by)
    end = F.unix_micros("timestamp")
    start = end - F.round(F.col("latency") * 1000.0).cast("long")
    steps = (
        responses.select(
            *by,
            F.inline(
                F.array(
                    F.struct(start.alias("t"), F.lit(1).alias("step")),
                    F.struct(end.alias("t"), F.lit(-1).alias("step")),
                )
            ),
        )
        .withColumn("bucket", F.floor(F.col("t") / F.lit(bucket_seconds * 1_000_000)))
        .groupBy(*by, "bucket", "t")
        .agg(F.sum("step").alias("d"))
    )
    inside = Window.partitionBy(*by, "bucket").orderBy("t")
    earlier = (
        Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        steps.withColumn("running", F.sum("d").over(inside))
        .groupBy(*by, "bucket")
        .agg(F.max("running").alias("peak"), F.sum("d").alias("net"))
        .withColumn("carried", F.coalesce(F.sum("net").over(earlier), F.lit(0)))
        .groupBy(*by)
        .agg(F.max(F.col("carried") + F.col("peak")).alias("peak_calls"))
    )
