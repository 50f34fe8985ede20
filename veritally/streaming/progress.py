"""Running progress and windowed confusion of a response stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import truth_is_safe
from ..operators.binary import binary_confusion
from ..plans.shared import hadoop_path


def run_progress(stream: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Finished and safe responses so far; state is one row per group."""
    return stream.groupBy(*by).agg(
        F.count(F.lit(1)).alias("finished"),
        F.count_if(F.col("is_safe")).alias("safe"),
        F.max("timestamp").alias("last_seen"),
    )


def windowed_confusion(
    stream: DataFrame,
    requests: DataFrame,
    safe: Sequence[str],
    by: Sequence[str] = ("model_name",),
    width: str = "5 minutes",
    delay: str = "10 minutes",
    salts: int = 8,
) -> DataFrame:
    """tp, tn, fp and fn per group and tumbling event-time window.

    Labels are joined as a static table by key; rows later than the watermark
    are dropped and closed windows leave the state, which holds one row per
    open window and group.

    Adaptive skew handling does not apply to stateful streams, so the join is
    salted: responses of one instance are spread over ``salts`` copies of its
    label (key and class only).  ``salts=1`` joins plainly.
    """
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    labels = requests.select(
        "instance_index", F.col("category").alias("actual"), copies.alias("_salt")
    )
    spread = F.pmod(F.xxhash64("timestamp", *by), F.lit(salts).cast("long"))
    joined = (
        stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", delay)
        .withColumn("_salt", spread)
        .join(labels, ["instance_index", "_salt"], "inner")
        .withColumn("actual_safe", truth_is_safe("actual", safe))
        .withColumnRenamed("is_safe", "predicted_safe")
        .withColumn("window", F.window("timestamp", width))
    )
    counts = binary_confusion(joined, (*by, "window"))
    return counts.select(
        *by,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "tp", "tn", "fp", "fn",
    )


def start_append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append mode to a Parquet folder, exactly once, until the input is read."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )


def start_complete(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Complete mode: each batch replaces the table of its batch number.

    Rewriting a batch after a failure writes the same folder again, so the
    result does not double; the latest folder is the current table.  The
    newest two are kept: a reader of the one before is not cut off.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")
        fs, _ = hadoop_path(batch.sparkSession, out)
        for old in _generations(batch.sparkSession, out)[:-2]:
            fs.delete(old, True)

    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )


def _generations(spark, out: str) -> list:
    """Complete tables under a complete-mode folder, oldest first."""
    fs, where = hadoop_path(spark, out)
    done = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")]
    done = [p for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done, key=lambda p: p.getName())


def latest_complete(spark, out: str) -> DataFrame:
    """The table of the newest complete batch, read by its path."""
    return spark.read.parquet(_generations(spark, out)[-1].toString())
