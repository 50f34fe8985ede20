"""Raw outputs to verdict rows, with failures split off by a predicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import verdicts as V
from ..functions.keywords import KEYWORD_RULES, NO_HIT, keyword_category
from ..functions.labels import class_names


def _spread(df: DataFrame, verdict: Column, drop: Sequence[str] = ()) -> DataFrame:
    """Verdict struct fields as columns beside the input columns."""
    keep = [F.col(c) for c in df.columns if c not in drop]
    return df.select(*keep, verdict.alias("_verdict")).select(
        *[c for c in df.columns if c not in drop], "_verdict.*"
    )


def parse_guard_output(raw: DataFrame, classes, text: str = "raw_response") -> DataFrame:
    """Complete generations; the others are :func:`guard_output_failures`."""
    split = raw.withColumn("_lines", V.guard_lines(text)).where(V.guard_complete("_lines"))
    return _spread(split, V.guard_verdict("_lines", class_names(classes)), drop=["_lines"])


def guard_output_failures(raw: DataFrame, text: str = "raw_response") -> DataFrame:
    """Generations with fewer than 3 lines."""
    return raw.where(~V.guard_complete(V.guard_lines(text))).withColumn(
        "error", F.lit("Invalid response format: fewer than 3 lines")
    )


def parse_label_output(
    raw: DataFrame, label: str = "label", score: str = "label_score", output: str = "raw_response"
) -> DataFrame:
    return _spread(raw, V.label_verdict(label, score, output))


def parse_moderation_scores(
    raw: DataFrame, flagged: str = "flagged", scores: str = "category_scores",
    names: Mapping[str, str] = V.MODERATION_CLASSES,
) -> DataFrame:
    return _spread(raw, V.moderation_verdict(flagged, scores, names))


def parse_safety_ratings(
    raw: DataFrame, ratings: str = "ratings", names: Mapping[str, str] = V.HARM_CLASSES
) -> DataFrame:
    return _spread(raw, V.rating_verdict(ratings, names))


def _listed(chosen: str, classes) -> Column:
    return F.coalesce(F.col(chosen).isin(class_names(classes)), F.lit(False))


def parse_structured_category(
    raw: DataFrame, classes, safe: Sequence[str], chosen: str = "chosen"
) -> DataFrame:
    """Rows whose class is in the list; the others are failures."""
    return _spread(raw.where(_listed(chosen, classes)), V.structured_verdict(chosen, safe))


def structured_category_failures(raw: DataFrame, classes, chosen: str = "chosen") -> DataFrame:
    return raw.where(~_listed(chosen, classes)).withColumn(
        "error", F.lit("Invalid response format: class not in list")
    )


def keyword_classify(
    requests: DataFrame, rules=KEYWORD_RULES, default: str = NO_HIT, text: str = "text"
) -> DataFrame:
    """Keyword verdict per row: class, is_safe and the score of -1."""
    keep = [F.col(c) for c in requests.columns if c not in ("predicted", "is_safe", "score")]
    return requests.select(
        *keep, keyword_category(text, rules, default).alias("predicted")
    ).withColumns({"is_safe": F.col("predicted") == default, "score": F.lit(-1.0)})
