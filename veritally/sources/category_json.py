"""JSON objects keyed by class, each class an array of items."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .json_blocks import split_items

# The class keys that are read, in this order.
CATEGORY_KEYS = ("safe", "unethical", "off-topic", "unsafe")
_CORRUPT = "_corrupt_record"


def _check_suffix(path: str, allowed: tuple[str, ...]) -> None:
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix and "*" not in suffix and suffix not in allowed:
        raise ValueError(f"expected a JSON file, got {suffix}")


def flatten_categories(objects: DataFrame) -> DataFrame:
    """Rows of ``source_file`` and one ``ARRAY<VARIANT>`` per class to items.

    Missing classes, other keys and classes that are not arrays give no rows;
    an array entry that is not an object becomes an empty item.
    ``item_index`` is dense within its object in class order.
    """
    sizes = [F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) for c in CATEGORY_KEYS]
    offset = F.lit(0)
    groups = []
    for name, size in zip(CATEGORY_KEYS, sizes):
        groups.append(
            F.struct(
                F.lit(name).alias("category"),
                offset.alias("offset"),
                F.coalesce(F.col(f"`{name}`"), F.array().cast("array<variant>")).alias("items"),
            )
        )
        offset = offset + F.when(size > 0, size).otherwise(0)
    per_class = objects.select("source_file", F.inline(F.array(*groups)))
    items = per_class.select(
        "source_file", "category", "offset", F.posexplode("items").alias("pos", "item")
    )

    return _item_fields(items, (F.col("offset") + F.col("pos")).cast("long"))


def _item_fields(items: DataFrame, index: Column) -> DataFrame:
    """Columns of ``item`` (VARIANT) beside its file, place and class."""

    def field(path: str):
        return F.try_variant_get("item", path, "string")

    return items.select(
        "source_file",
        index.alias("item_index"),
        "category",
        field("$.id").alias("id"),
        field("$.message").alias("message"),
        field("$.parameters.aspect").alias("aspect"),
        field("$.parameters.style").alias("style"),
        field("$.explanation").alias("explanation"),
    )


def _split_categories(spark: SparkSession, path: str) -> DataFrame:
    """The items of large objects, cut out by many tasks."""
    found = split_items(spark, path).where(F.col("key").isin(*CATEGORY_KEYS) & (F.col("kind") == "["))
    # A class begins after the items of the classes before it in the same file.
    sizes = [F.count_if(F.col("key") == c) for c in CATEGORY_KEYS]
    starts = found.groupBy(F.col("source_file").alias("of")).agg(F.array(*sizes).alias("sizes"))
    place = F.array_position(F.lit(list(CATEGORY_KEYS)), F.col("key")).cast("int") - 1
    before = F.aggregate(F.slice("sizes", F.lit(1), place), F.lit(0).cast("long"), lambda acc, n: acc + n)
    item = F.try_parse_json("item")
    checked = F.when(item.isNull(), F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("source_file"))).cast("variant")).otherwise(item)
    items = found.join(starts, F.col("source_file") == F.col("of")).select(
        "source_file", (before + F.col("item_index")).alias("index"), F.col("key").alias("category"), checked.alias("item")
    )
    return _item_fields(items, F.col("index"))


def scan_category_json(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Items of category-keyed objects under a file, folder or glob.

    By default one (possibly pretty-printed) object per file is read by one
    task.  ``split=True`` reads such files by byte ranges, many tasks to a
    file; a class that is given twice in an object keeps the items of both.
    ``lines=True`` reads one object per line, which any reader splits.
    Malformed JSON raises.
    """
    _check_suffix(path, (".json", ".jsonl"))
    if split:
        return _split_categories(spark, path)
    schema = ", ".join(f"`{c}` array<variant>" for c in CATEGORY_KEYS)
    raw = (
        spark.read.schema(f"{schema}, {_CORRUPT} string")
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )
    # A class that is not an array also lands in the corrupt column; only text
    # that is no JSON at all is an error.
    broken = F.col(_CORRUPT).isNotNull() & F.try_parse_json(F.col(_CORRUPT)).isNull()
    file = F.when(
        broken,
        F.raise_error(F.concat(F.lit("invalid JSON in "), F.input_file_name())).cast("string"),
    ).otherwise(F.input_file_name())
    return flatten_categories(
        raw.select(*[F.col(f"`{c}`") for c in CATEGORY_KEYS], file.alias("source_file"))
    )


def with_instance_index(items: DataFrame, single_object: bool = True) -> DataFrame:
    """Adds the request key.

    For one object the dense ``item_index`` is the key.  For many, items are
    numbered in scan order: position within the scan partition plus the number
    of items in earlier partitions.  Only one count per partition is ordered,
    never the items.  File partitions are cut the same way each time, so a
    retried task numbers its rows as before.
    """
    if single_object:
        return items.withColumn("instance_index", F.col("item_index"))
    tagged = items.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        tagged.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("instance_index", F.col("_start") + place)
        .drop("_id", "_part", "_start")
    )
