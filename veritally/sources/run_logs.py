"""Run logs: ``YYYY-MM-DD HH:mm:ss | LEVEL    | message`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed format of a log line.
LOG_LINE = r"\A(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+) *\| (.*)\z"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """``value`` to ts, level and message; other lines are continuations."""
    v = F.col("value")
    matched = v.rlike(LOG_LINE)

    def part(i: int):
        return F.when(matched, F.regexp_extract(v, LOG_LINE, i))

    return lines.select(
        *[c for c in lines.columns if c != "value"],
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        part(2).alias("level"),
        F.when(matched, part(3)).otherwise(v).alias("message"),
    )


def scan_run_logs(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.input_file_name().alias("source_file"), "value")
    return parse_log_lines(lines)
