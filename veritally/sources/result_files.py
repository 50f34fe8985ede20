"""Saved result files: run metrics and per-request predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shared import written
from ..schema import RESPONSES
from .json_blocks import first_member, split_items

_FILE = (
    "model string, dataset string, total_samples long, metrics string, "
    "predictions array<struct<request_text:string, request_metadata:map<string,string>, "
    "prediction:string, response:string, result:string>>, "
    # A line may also be one record by itself, as the predictions sink writes it.
    "request_text string, request_metadata map<string,string>, request_category string, prediction string"
)
_RUN = "model string, dataset string, total_samples long, metrics string"
_PREDICTION = (
    "is_safe boolean, score double, category string, latency double, model_name string, "
    "timestamp string, instance_index long, iteration int, raw_response string"
)


def _result_documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    reader = spark.read.text(path, wholetext=not lines)
    return reader.where(F.trim("value") != "").select(
        F.input_file_name().alias("source_file"), "value"
    )


def scan_result_metrics(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per file: model, dataset and the metrics object as JSON text.

    ``metrics`` may be at any depth, inside objects and lists: the first one
    in depth-first order that is not null is read.  An object that has the key
    is not searched further.  A file without any raises.
    """
    docs = _result_documents(spark, path, lines).withColumn("_f", F.from_json("value", _RUN))
    f = F.col("_f")
    # Both writers put it at the top, where it is read without a search.
    docs = docs.withColumn("_found", first_member(F.when(f["metrics"].isNull(), F.col("value")), "metrics"))
    metrics = F.coalesce(
        f["metrics"], "_found", F.raise_error(F.concat(F.lit("no metrics in "), F.col("source_file"))).cast("string")
    )
    return docs.select(
        "source_file", f["model"].alias("model"), f["dataset"].alias("dataset"),
        f["total_samples"].alias("total_samples"), metrics.alias("metrics"),
    )


def category_list(category: Column) -> Column:
    """``"x"`` or ``["x", "y"]`` text to an array; NULL stays NULL."""
    listed = F.when(category.startswith("["), F.from_json(category, "array<string>"))
    return F.when(category.isNotNull(), F.coalesce(listed, F.array(category)))


def prediction_fields(raw: Column, p: Column) -> dict[str, Column]:
    """Response columns of one saved prediction: its text and its parsed form.

    A prediction that lacks a required field or is no object falls back to an
    unsafe verdict of model ``unknown`` that keeps the raw content.
    """
    complete = (
        p["is_safe"].isNotNull() & p["score"].isNotNull()
        & p["latency"].isNotNull() & p["model_name"].isNotNull()
    )
    good = F.coalesce(raw.startswith("{") & complete, F.lit(False))
    categories = F.when(good, category_list(p["category"]))

    def field(name: str, default) -> Column:
        return F.when(good, p[name]).otherwise(default)

    return {
        "model_name": field("model_name", F.lit("unknown")),
        "instance_index": field("instance_index", F.lit(None).cast("long")),
        "iteration": field("iteration", F.lit(None).cast("int")),
        "is_safe": field("is_safe", F.lit(False)),
        "score": field("score", F.lit(0.0)),
        "category": F.get(categories, F.lit(0)),
        "categories": categories,
        "latency": field("latency", F.lit(0.0)),
        "timestamp": F.when(good, F.try_to_timestamp(p["timestamp"])),
        "raw_response": F.when(good, p["raw_response"]).otherwise(raw),
    }


_RECORD = "request_text string, request_metadata map<string,string>, prediction string, response string, result string"


def _whole_records(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    # Each parse is a projection of its own: used by several columns, it is
    # evaluated once per row and not once per column.
    docs = _result_documents(spark, path, lines).select("source_file", "value", F.from_json("value", _FILE).alias("_f"))
    f = F.col("_f")
    nothing = F.lit(None).cast("string")
    alone = F.array(F.struct(
        f["request_text"].alias("request_text"), f["request_metadata"].alias("request_metadata"),
        f["prediction"].alias("prediction"), nothing.alias("response"), nothing.alias("result"),
    ))
    here = F.coalesce(f["predictions"], F.when(f["prediction"].isNotNull(), alone))
    # Predictions that are not at the top are searched for in the files without.
    docs = docs.withColumn("_found", first_member(F.when(here.isNull(), F.col("value")), "predictions"))
    records = F.coalesce(here, F.from_json("_found", f"array<struct<{_RECORD}>>"))
    return docs.select(
        "source_file", F.col("_f.model").alias("run_model"), F.col("_f.dataset").alias("dataset"),
        F.col("_f.request_category").alias("_category"), F.posexplode(records).alias("position", "p"),
    )


def _split_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of large files, cut out by many tasks."""
    found = split_items(spark, path)

    def top(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.get_json_object(F.concat(F.lit('{"x":'), F.col("item"), F.lit("}")), "$.x")))

    # One row a file; written, so that its size is known before the join and the records need not be moved for it.
    files = written(
        found.where("kind = 's' AND key IN ('model', 'dataset')").groupBy(F.col("source_file").alias("of")).agg(
            top("model").alias("run_model"), top("dataset").alias("dataset")
        ),
        "result-files",
    )
    bad = F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("source_file"))).cast("string")
    text = F.when(F.try_parse_json("item").isNull(), bad).otherwise(F.col("item"))
    return found.where("kind = '[' AND key = 'predictions'").join(files, F.col("source_file") == F.col("of"), "left").select(
        "source_file", "run_model", "dataset", F.lit(None).cast("string").alias("_category"),
        F.col("item_index").cast("int").alias("position"), text.alias("item"),
    ).withColumn("p", F.from_json("item", _RECORD)).drop("item")


def scan_results(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """One row per saved prediction: request and response side by side.

    Older files that use ``response`` or ``result`` instead of ``prediction``
    are accepted, and files that hold ``predictions`` at any depth.
    ``lines=True`` reads one result object per line; ``split=True`` reads large
    files with ``predictions`` at the top by byte ranges, many tasks to a file;
    what the result needs of them is stored before this returns.
    """
    each = (_split_records(spark, path) if split else _whole_records(spark, path, lines)).select(
        "source_file", "run_model", "dataset", "position", "_category",
        F.col("p.request_text").alias("text"),
        F.col("p.request_metadata").alias("metadata"),
        F.coalesce("p.prediction", "p.response", "p.result").alias("_raw"),
    )
    parsed = each.withColumn("_p", F.from_json("_raw", _PREDICTION))
    fields = prediction_fields(F.col("_raw"), F.col("_p"))
    return parsed.select(
        "source_file", "run_model", "dataset", "position", "text", "metadata",
        F.coalesce(F.try_element_at("metadata", F.lit("category")), "_category").alias("actual"),
        *[c.alias(n) for n, c in fields.items()],
    )


# Key of a request among several saved runs.
RUN_KEY = ("dataset", "run", "instance_index")


def split_results(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and responses of a replay, both with ``dataset`` and ``run``.

    A run is the folder its files are in.  Records of older files without an
    index are told apart by their place in the file.  A request is stored once
    per iteration, so requests are made distinct by key, combined before the
    shuffle.  Records read without ``text`` give requests without it.
    """
    keyed = saved.withColumns({
        "dataset": F.coalesce("dataset", F.lit("")),
        "run": F.regexp_extract(F.coalesce("source_file", F.lit("")), r"([^/]*)/[^/]*$", 1),
        "instance_index": F.coalesce("instance_index", F.col("position").cast("long")),
        "iteration": F.coalesce("iteration", F.lit(0)),
    })
    text = [c for c in ("text",) if c in saved.columns]
    requests = (
        keyed.groupBy(*RUN_KEY)
        .agg(F.max(F.struct(*text, F.col("actual").alias("category"))).alias("_r"))
        .select(*RUN_KEY, "_r.*")
    )
    fields = {f.name for f in RESPONSES.fields} | {"dataset", "run"}
    return requests, keyed.select(*[c for c in keyed.columns if c in fields])
