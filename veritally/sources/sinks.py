"""Writers of run results and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shared import hadoop_path

ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def json_record(columns: Sequence[str]) -> Column:
    """Nested columns as one JSON object: ISO times, structs and maps as objects."""
    return F.to_json(F.struct(*columns), ISO)


def to_json_record(df: DataFrame, columns: Sequence[str] | None = None, name: str = "record") -> DataFrame:
    return df.select(json_record(columns or df.columns).alias(name))


def _write(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str, mode: str, rebalance: bool = True) -> None:
    """Rebalanced by size alone: AQE merges small tasks and splits large ones,
    so no run is written by one task, and no key decides where rows go."""
    (
        (df.hint("rebalance") if rebalance else df)
        .write.partitionBy(*partition_by)
        .mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .format(fmt)
        .save(path)
    )


def write_results(
    reports: DataFrame,
    path: str,
    experiment: str,
    experiment_index: int,
    dataset: str,
    system_prompt: str = "unknown",
    classes: dict[str, str] | None = None,
    fmt: str = "parquet",
    mode: str = "append",
) -> None:
    """One row per model with its metrics, in one folder per experiment index.

    ``mode="overwrite"`` replaces only that folder, which makes a rerun safe.
    """
    described = F.create_map(
        *[F.lit(x) for pair in (classes or {"unknown": ""}).items() for x in pair]
    )
    rows = reports.withColumns(
        {
            "experiment": F.lit(experiment),
            "experiment_index": F.lit(int(experiment_index)),
            "ts": F.current_timestamp(),
            "dataset": F.lit(dataset),
            "system_prompt": F.lit(system_prompt),
            "classes": described,
        }
    )
    _write(rows, path, ("experiment", "experiment_index"), fmt, mode)


def prediction_records(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """One record per response with its request, joined by key."""
    prediction = [
        c for c in ("is_safe", "score", "category", "categories", "latency", "model_name",
                    "timestamp", "instance_index", "iteration", "raw_response")
        if c in responses.columns
    ]
    right = requests.select(
        F.col("instance_index").alias("_key"),
        F.col("text").alias("request_text"),
        *([F.col("metadata").alias("request_metadata")] if "metadata" in requests.columns else []),
        F.col("category").alias("request_category"),
    )
    joined = responses.join(right, F.col("instance_index") == F.col("_key"), "inner")
    return joined.select(
        *[c for c in right.columns if c != "_key"], F.struct(*prediction).alias("prediction")
    )


def write_predictions(
    responses: DataFrame,
    requests: DataFrame,
    path: str,
    experiment: str,
    experiment_index: int,
    fmt: str = "parquet",
    mode: str = "append",
) -> None:
    rows = prediction_records(responses, requests).withColumns(
        {"experiment": F.lit(experiment), "experiment_index": F.lit(int(experiment_index))}
    )
    # The join has dealt the rows, and a request's stay together: its text is moved once and not with each response.
    _write(rows, path, ("experiment", "experiment_index"), fmt, mode, rebalance=False)


def _claim(spark: SparkSession, path: str) -> bool:
    """Creates the file unless it is there; only one of several writers succeeds."""
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where.getParent())
    try:
        if fs.getScheme() == "file":
            # The local file system looks first and creates then; the operating system does both at once.
            jvm = spark._jvm
            jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(where.toUri()), _no_attributes(spark))
        else:
            fs.create(where, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
            return False
        raise
    return True


def _no_attributes(spark: SparkSession):
    return spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)


def _taken(spark: SparkSession, folder: str) -> int:
    """The highest index that is claimed or written under ``folder``, -1 for none."""
    fs, where = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return max((int(n.rpartition("=")[2]) for n in names if n.rpartition("=")[2].isdigit()), default=-1)


def claim_experiment_index(spark: SparkSession, path: str, experiment: str, first: int = 0) -> int:
    """The next run number of an experiment, for this writer alone.

    A number is claimed by creating a file that must not be there yet, which
    the file system lets one writer do.  A writer that fails keeps its
    number, and no other run gets it.
    """
    name = quote(experiment, safe="")
    claims = f"{path.rstrip('/')}/_claims/{name}"
    index = max(first - 1, _taken(spark, claims), _taken(spark, f"{path.rstrip('/')}/experiment={name}")) + 1
    while not _claim(spark, f"{claims}/{index}"):
        index += 1
    return index


def save_run(
    reports: DataFrame, path: str, experiment: str, dataset: str, requests: DataFrame | None = None,
    responses: DataFrame | None = None, predictions_path: str | None = None, **options,
) -> int:
    """Writes a run's results, and its predictions if given, under a number of its own; returns the number.

    Predictions come first: results that can be read have all of theirs.
    Spark shows what a job wrote only when all of it is there.
    """
    index = claim_experiment_index(reports.sparkSession, path, experiment)
    if predictions_path is not None:
        write_predictions(responses, requests, predictions_path, experiment, index, mode="overwrite")
    write_results(reports, path, experiment, index, dataset, mode="overwrite", **options)
    return index


def next_experiment_index(runs: DataFrame, experiments: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Next run number per experiment: highest so far plus one.

    ``experiments`` adds names without any run yet, which get ``first``.
    """
    top = runs.groupBy("experiment").agg((F.max("experiment_index") + 1).alias("next_index"))
    if experiments is None:
        return top
    return experiments.join(top, "experiment", "left").select(
        "experiment", F.coalesce("next_index", F.lit(first)).alias("next_index")
    )
