"""Shared scratch folder, size-checked small tables and session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Most rows a table may have to be taken to the driver and broadcast.
SMALL_TABLE_ROWS = 10_000

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="veritally-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, qualified path) of Hadoop, which knows every store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def clean_scratch(spark: SparkSession) -> bool:
    """Deletes this application's intermediate tables.

    Results that were not written or collected read them, so this is for the
    end of an application; no other application's folder is touched.
    """
    fs, where = hadoop_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    return bool(fs.delete(where, True))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table or folder that nothing reads any more."""
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


def small_rows(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> list | None:
    """All rows when there are at most ``limit``, else None.

    At most ``limit + 1`` rows reach the driver whatever the input size.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` computed once, into a table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tuned_builder(input_bytes: int | None = None, cores: int | None = None):
    """Session builder with adaptive settings sized to the input.

    Shuffle tasks start at about 128 MiB of input each; AQE merges small ones
    and splits skewed join partitions.
    """
    wanted = max((input_bytes or 0) // (128 << 20), (cores or 8))
    return (
        SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(int(wanted)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Hash instead of sort for a join whose measured partitions all fit.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(64 << 20))
        .config("spark.sql.files.maxPartitionBytes", str(128 << 20))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture for every column expression slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
