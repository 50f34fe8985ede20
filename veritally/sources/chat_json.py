"""Chat items: a JSON array, one object, or an object with a ``data`` array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .category_json import _check_suffix
from .json_blocks import split_items


def chat_items(documents: DataFrame) -> DataFrame:
    """Whole JSON documents in ``value`` to one JSON object string per item."""
    text = F.trim(F.col("value"))
    parsed_ok = F.try_parse_json(text).isNotNull()
    checked = F.when(parsed_ok, text).otherwise(
        F.raise_error(F.lit("invalid JSON in chat file")).cast("string")
    )
    docs = documents.select(
        *[c for c in documents.columns if c != "value"], checked.alias("value")
    )
    data = F.get_json_object("value", "$.data")
    # An object that has "data" is unwrapped; other objects are one item.
    listing = (
        F.when(F.col("value").startswith("["), F.col("value"))
        .when(data.startswith("["), data)
        .otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    )
    return docs.select(
        *[c for c in documents.columns if c != "value"],
        F.posexplode(F.from_json(listing, "array<string>")).alias("item_index", "item"),
    )


def scan_chat_json(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Items of chat files as JSON object strings in ``item``.

    With ``lines=True`` every line is one item; the other shapes are one
    document per file and read whole.  With ``split=True`` arrays and objects
    with a ``data`` array are read by byte ranges, many tasks to a file (one
    object alone is one item: read it whole).
    """
    _check_suffix(path, (".json", ".jsonl"))
    if split:
        found = split_items(spark, path).where("kind = '[' AND (key IS NULL OR key = 'data')")
        bad = F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("source_file"))).cast("string")
        return found.select(
            "source_file", F.col("item_index").cast("int").alias("item_index"),
            F.when(F.try_parse_json("item").isNull(), bad).otherwise(F.trim("item")).alias("item"),
        )
    if lines:
        return (
            spark.read.text(path)
            .where(F.trim("value") != "")
            .select(F.input_file_name().alias("source_file"), F.col("value").alias("item"))
        )
    documents = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source_file"), "value"
    )
    return chat_items(documents)
