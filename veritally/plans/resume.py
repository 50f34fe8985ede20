"""Long evaluations that can be stopped and taken up again.

Scored slots are appended to a slot store, a folder of files.  A task's file
is there as soon as the task has ended (not only with the whole job), so what
was scored before a run was stopped is not scored again: the next run calls
only the slots that the store lacks, and those that failed for their quota
and have calls left.

Which slots are done is known from bitmaps, 32,768 slot numbers to 4 KiB.  Up
to ``MOST_BITMAPS`` of them, a checked number, are broadcast, and the texts are
not shuffled; beyond (slot numbers that are far apart), slots are joined by key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.align import dedupe_slots
from ..operators.monitoring import ATTEMPTS, classify_failures
from ..operators.requests import expand_iterations, valid_requests
from ..operators.scoring import score_slots
from ..schema import SCORED, SLOT
from .shared import hadoop_path

MOST_BITMAPS = 8_192
STORED = T.StructType([*SCORED.fields, T.StructField("attempt", T.IntegerType())])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per slot of the store: the response if there is one, else the last failure."""
    fs, where = hadoop_path(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(path)
    # A response counts more than any failure; among failures the one after most calls.
    return dedupe_slots(rows.withColumn("_good", F.col("error").isNull()), SLOT, ("_good", "attempt", "timestamp")).drop("_good")


def settled_slots(store: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Slots that need no call: answered, or failed for good."""
    # Scoring puts the error's class before the provider's message, which the rule looks at.
    message = F.regexp_replace("error", r"\A[A-Za-z_][A-Za-z0-9_.]*: ", "")
    judged = classify_failures(store.withColumns({"_kept": F.col("error").isNull(), "error": message}), attempts)
    return judged.where(F.col("_kept") | ~F.col("retryable")).select(*SLOT)


def _slot_number(iterations: int) -> Column:
    return F.col("instance_index") * F.lit(int(iterations)) + F.col("iteration")


def _not_done(expanded: DataFrame, done: DataFrame, iterations: int) -> DataFrame:
    """The slots of one model that are not in ``done(instance_index, iteration)``."""
    number = _slot_number(iterations)
    bits = done.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits")
    )
    if bits.limit(MOST_BITMAPS + 1).count() > MOST_BITMAPS:
        return expanded.join(done.distinct(), ["instance_index", "iteration"], "left_anti")
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1))
    return (
        expanded.withColumn("_number", F.bitmap_bucket_number(number))
        .join(F.broadcast(bits), F.col("_number") == F.col("_bucket"), "left")
        .where(F.coalesce(bit, F.lit(0)) == 0)
        .drop("_number", "_bucket", "_bits")
    )


def resume_run(
    requests: DataFrame,
    models: Mapping[str, Callable[[], Callable]],
    path: str,
    iterations: int = 1,
    batch_size: int = 64,
    max_concurrency: int | None = None,
    calls_per_second: float | None = None,
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Scores what the slot store under ``path`` lacks and returns the whole store.

    Requests need a key; texts that are missing are left out, as
    ``invalid_requests`` shows them.  A response is stored once: a task that
    is repeated after its file was kept writes its slots again, and the store
    is read with one row per slot.
    """
    spark = requests.sparkSession
    keyed = valid_requests(requests).where(F.col("instance_index").isNotNull())
    expanded = expand_iterations(keyed, iterations).select("instance_index", "iteration", "text")
    for name, make in models.items():
        store = read_store(spark, path).where(F.col("model_name") == name)
        todo = _not_done(expanded, settled_slots(store, attempts).select("instance_index", "iteration"), iterations)
        # Calls made before: only slots that failed for their quota, which are few beside the rest.
        tried = store.where(F.col("error").isNotNull()).select("instance_index", "iteration", "attempt")
        if not tried.isEmpty():
            todo = todo.join(tried, ["instance_index", "iteration"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        scored = score_slots(todo, name, make, batch_size, max_concurrency, calls_per_second, attempts)
        # Version 2 of the committer keeps the file of a task that has ended, whatever becomes of the job.
        scored.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return read_store(spark, path)
