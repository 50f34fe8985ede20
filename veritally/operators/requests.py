"""Building the request side: normalise, expand, batch, sample, render."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chat import chat_fields, chat_map, chat_text
from ..functions.labels import array_literal
from ..functions.prompts import guard_prompt, system_prompt


def normalize_academic(items: DataFrame, source: str) -> DataFrame:
    """Category-keyed items to requests.

    Keeps the columns the scan produced for ordering, sets ``text`` from
    ``message`` and collects the descriptive fields in ``metadata``.
    """
    keys = ("source", "original_id", "category", "aspect", "style", "explanation")
    values = (
        F.lit(source),
        F.col("id").cast("string"),
        F.col("category"),
        F.col("aspect"),
        F.col("style"),
        F.coalesce("explanation", F.lit("")),
    )
    metadata = F.map_from_arrays(
        F.array(*[F.lit(k) for k in keys]), F.array(*values)
    )
    return items.select(
        F.col("instance_index"),
        F.coalesce("message", F.lit("")).alias("text"),
        "category",
        metadata.alias("metadata"),
    )


# Chat fields that hold the text itself and stay out of metadata.
_TEXT_FIELDS = ("id", "messages", "content", "text")


def normalize_chat(
    items: DataFrame, source: str, category: Column | None = None, typed: bool = False
) -> DataFrame:
    """Chat items (JSON object strings in ``item``) to requests.

    Extra fields become metadata unless they start with an underscore.  The
    items carry no class of their own, so ``category`` may be given as an
    expression over ``toxic`` (BOOLEAN) and ``metadata``; by default it is the
    field of that name.  Metadata are texts; ``typed=True`` adds ``extra``, the
    same extra fields as one VARIANT object with their numbers, booleans,
    lists and objects as they were (NULL when there are none).
    """
    # Parsed once per item, in a projection of its own.
    parsed = items.withColumns({"_map": chat_map("item"), "_fields": chat_fields("item")})
    fields = F.col("_map")

    def extra_field(k: Column, v: Column) -> Column:
        return ~k.isin(list(_TEXT_FIELDS)) & ~k.startswith("_")

    extra = F.map_filter(fields, extra_field)
    toxic = F.coalesce(F.try_element_at(fields, F.lit("toxic")), F.lit("false"))
    base = F.create_map(
        F.lit("source"), F.lit(source),
        F.lit("original_id"), F.try_element_at(fields, F.lit("id")),
        F.lit("toxic"), toxic,
    )
    # A field repeated in the item replaces the base entry of the same name.
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    columns = [
        *[c for c in items.columns if c != "item"],
        chat_text("item", "_fields", "_map").alias("text"),
        (F.lower(toxic) == "true").alias("toxic"),
        F.map_concat(kept, extra).alias("metadata"),
    ]
    if typed:
        values = F.map_filter(F.try_variant_get(F.try_parse_json("item"), "$", "map<string,variant>"), extra_field)
        columns.append(F.when(F.size(values) > 0, F.to_variant_object(values)).alias("extra"))
    out = parsed.select(*columns)
    label = category if category is not None else F.try_element_at("metadata", F.lit("category"))
    return out.withColumn("category", label)


def conversation_texts(turns: DataFrame) -> DataFrame:
    """``(conv_id, text)``: every conversation whole, in turn order, joined by newline.

    One value holds the text, so a conversation beyond the size of one value
    (2 GiB) raises; turns without text are left out.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (
        turns.where(F.col("text").isNotNull())
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(ordered, lambda t: t["text"]), "\n").alias("text"))
    )


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Quarantine: rows whose text is missing or empty."""
    return requests.where(F.coalesce("text", F.lit("")) == "")


def valid_requests(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with text.  ``strict`` raises in the task that meets a bad row."""
    bad = F.coalesce("text", F.lit("")) == ""
    if not strict:
        return requests.where(~bad)
    message = F.concat(
        F.lit("missing text in item "), F.coalesce(F.col("instance_index").cast("string"), F.lit("?"))
    )
    return requests.withColumn(
        "text", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("text"))
    )


def expand_iterations(requests: DataFrame, iterations: int) -> DataFrame:
    """Every request once per iteration 0..n-1; narrow, no shuffle.

    ``exp_index`` is the position in the expanded order, derived from the key,
    so no global window is needed.
    """
    n = max(1, int(iterations))
    return requests.withColumn(
        "iteration", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ).withColumn("exp_index", F.col("instance_index") * n + F.col("iteration"))


def assign_batches(expanded: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive chunks of ``batch_size`` in expanded order."""
    return expanded.withColumn(
        "batch_no", F.floor(F.col("exp_index") / F.lit(int(batch_size))).cast("long")
    )


def stride_sample(requests: DataFrame, k: int) -> DataFrame:
    """Every k-th instance: the sampling operator itself."""
    return requests.where(F.col("instance_index") % int(k) == 0)


def cross_models(requests: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every model against every request.

    The model list is a literal array, so this is a narrow generate over the
    request partitions and not a join.
    """
    return requests.withColumn("model_name", F.explode(array_literal(list(models))))


def render_prompts(
    requests: DataFrame,
    classes: Mapping[str, str],
    base: str | None = None,
    explain: bool = False,
) -> DataFrame:
    """System prompt of the run and the user text, one row per request."""
    return requests.withColumn("system_prompt", F.lit(system_prompt(classes, base, explain)))


def render_guard_prompts(requests: DataFrame) -> DataFrame:
    return requests.withColumn("prompt", guard_prompt("text"))
