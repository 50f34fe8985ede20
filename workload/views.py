"""Requests and responses derived from the given tables.

The responses come from an arithmetic classifier: integers only, so any engine
computes the same rows, and every branch occurs (right class, each wrong
class, no class, no response at all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASSES = {
    "safe": "on topic and harmless",
    "unethical": "ethically risky",
    "off-topic": "unrelated to the subject",
}
NAMES = list(CLASSES)
SAFE = ["safe"]
MODELS = ("model_a", "model_b", "model_c")
ITERATIONS = 5
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per process, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


LABEL = (
    "CASE WHEN toxic = 1 THEN 'unethical' WHEN quality = 0 THEN 'off-topic' ELSE 'safe' END AS category"
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; unused columns, texts first of all, are pruned from the scan."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", LABEL)
    return table(spark, sf_dir, "documents").join(labels, "doc_id").selectExpr(
        "doc_id AS instance_index", "text", "n_chars", "lang", "source", "category"
    )


def all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those without a label count as safe."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", LABEL)
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(
        "doc_id AS instance_index", "text", "n_chars", "lang", "source", "coalesce(category, 'safe') AS category"
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document, and orders that have no document: requests without a text."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(orders, "doc_id", "full").selectExpr(
        "doc_id AS instance_index", "text", "lang"
    )


def slots(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Every expected call with its branch number ``h``; for metrics, those of labelled documents."""
    given = requests(spark, sf_dir) if labelled else all_requests(spark, sf_dir)
    models = ", ".join(f"struct('{m}' AS model_name, {i} AS ord)" for i, m in enumerate(MODELS))
    return (
        given
        .selectExpr("instance_index", "n_chars", "category", f"inline(array({models}))")
        .selectExpr("*", f"explode(sequence(0, {ITERATIONS - 1})) AS iteration")
        .selectExpr("*", "(instance_index * 31 + iteration * 17 + ord * 7 + n_chars) % 20 AS h")
    )


_VERDICT = (
    "CASE WHEN h <= 11 THEN category = 'safe' WHEN h <= 14 THEN true WHEN h <= 17 THEN false "
    "ELSE instance_index % 2 = 0 END AS is_safe"
)
_PREDICTED = (
    "CASE WHEN h <= 11 THEN category WHEN h <= 14 THEN 'safe' WHEN h <= 16 THEN 'unethical' "
    "WHEN h = 17 THEN 'off-topic' END AS category"
)


def responses(spark: SparkSession, sf_dir: str, keep_branch: bool = False, labelled: bool = True) -> DataFrame:
    extra = ["ord", "h", "n_chars"] if keep_branch else []
    return slots(spark, sf_dir, labelled).where("h <> 19").selectExpr(
        "model_name",
        "instance_index",
        "iteration",
        _VERDICT,
        "-1.0D AS score",
        _PREDICTED,
        "CAST(50 + (n_chars * 13 + iteration * 29 + ord * 101) % 1000 AS DOUBLE) AS latency",
        f"timestamp_seconds({EPOCH} + instance_index * 5 + iteration) AS timestamp",
        *extra,
    )


def all_responses(spark: SparkSession, sf_dir: str, keep_branch: bool = False) -> DataFrame:
    """Responses to every document, for what needs no label."""
    return responses(spark, sf_dir, keep_branch, labelled=False)


def event_responses(events: DataFrame) -> DataFrame:
    """The event table as arriving responses (batch or stream)."""
    return events.selectExpr(
        "event_type AS model_name",
        "user_id AS instance_index",
        "(event_id * 7 + user_id) % 3 <> 0 AS is_safe",
        "value AS latency",
        "CAST(ts AS TIMESTAMP) AS timestamp",
    )


EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_responses(
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
