"""Pairing responses with requests, always by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import map_literal, primary_category, truth_is_safe
from ..schema import SLOT


def align_predictions(
    responses: DataFrame,
    requests: DataFrame,
    safe: Sequence[str],
    on: Sequence[str] = ("instance_index",),
    request_columns: Sequence[str] = (),
) -> DataFrame:
    """Each response with its label.

    Only the key, the label and the columns asked for leave the request side,
    so texts are not shuffled.  Requests are unique per key; when one key holds
    many responses AQE splits that partition of the response side.  The
    optimizer broadcasts the request side only under its size threshold.
    """
    if "categories" in responses.columns:
        predicted = primary_category("categories")
        if "category" in responses.columns:
            predicted = F.coalesce(predicted, F.col("category"))
    else:
        predicted = F.col("category")
    left = responses.withColumn("predicted", predicted)
    left = left.drop(*[c for c in ("category", "categories") if c in left.columns])
    right = requests.select(
        *on, F.col("category").alias("actual"), *request_columns
    )
    return (
        left.join(right, list(on), "inner")
        .withColumn("actual_safe", truth_is_safe("actual", safe))
        .withColumnRenamed("is_safe", "predicted_safe")
    )


def unmatched_responses(
    responses: DataFrame, requests: DataFrame, on: Sequence[str] = ("instance_index",)
) -> DataFrame:
    """Responses that no request explains: a NULL or unknown key."""
    return responses.join(requests.select(*on).distinct(), list(on), "left_anti")


def failed_requests(
    expanded: DataFrame, responses: DataFrame, keys: Sequence[str] = SLOT
) -> DataFrame:
    """Expected calls with no response.

    Responses are reduced to distinct slots first (combined before the
    shuffle), so repeated slots cannot pile up on one side of the anti join,
    which reuses the same key partitioning.
    """
    done = responses.select(*keys).distinct()
    return expanded.join(done, list(keys), "left_anti")


def answered_requests(
    expanded: DataFrame, responses: DataFrame, keys: Sequence[str] = SLOT
) -> DataFrame:
    done = responses.select(*keys).distinct()
    return expanded.join(done, list(keys), "left_semi")


def dedupe_slots(
    responses: DataFrame,
    keys: Sequence[str] = SLOT,
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """One response per slot, the latest write wins.

    The ordered maximum of the whole row is combined before the shuffle: a
    slot with very many writes leaves one row per input task.  Equal times are
    decided by the remaining columns, so the result does not depend on task
    order.
    """
    rest = [c for c in responses.columns if c not in keys and c not in order]
    winner = F.max(F.struct(*order, *rest)).alias("_last")
    return (
        responses.groupBy(*keys)
        .agg(winner)
        .select(*keys, "_last.*")
        .select(*responses.columns)
    )


def map_taxonomy(
    rows: DataFrame, mapping: Mapping[str, str], column: str = "category", to: str = "standard"
) -> DataFrame:
    """Provider class names to standard ones; unmapped names are kept.

    The mapping is a fixed list of a dozen names, so it is a MAP literal in
    the projection and no join is planned.
    """
    found = F.try_element_at(map_literal(mapping), F.col(column))
    return rows.withColumn(to, F.coalesce(found, F.col(column)))


def map_taxonomy_table(
    rows: DataFrame, mapping: DataFrame, column: str = "category", to: str = "standard"
) -> DataFrame:
    """The same with the mapping as a table ``(raw, standard)`` of any size."""
    m = mapping.select(F.col("raw").alias(column), F.col("standard").alias("_std"))
    return (
        rows.join(m, column, "left")
        .withColumn(to, F.coalesce("_std", column))
        .drop("_std")
    )


def class_universe(
    aligned: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Sorted distinct labels seen on either side; NULL is not a class.

    One pass: both labels leave a row together and duplicates are combined
    before the shuffle.
    """
    return (
        aligned.select(F.explode(F.array(actual, predicted)).alias("class"))
        .where(F.col("class").isNotNull())
        .distinct()
        .orderBy("class")
    )
