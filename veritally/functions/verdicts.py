"""Raw model output to verdict, one expression per output format.

Each function returns a plain STRUCT column, whose fields the optimizer takes
apart, so a caller adds all verdict fields in one projection.  Nothing here
shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .labels import mapped_or_same
from .ratios import _col

# Hazard code to class name of label-output guards.
HAZARD_CODES = {
    "S1": "violence",
    "S2": "sexual_content",
    "S3": "hate_speech",
    "S4": "misinformation",
    "S5": "self_harm",
    "S6": "harassment",
    "S7": "illegal_activities",
    "S8": "specialized_advice",
    "S9": "privacy",
    "S10": "intellectual_property",
    "S11": "indiscriminate_weapons",
    "S12": "sexual_content_minors",
}

# Moderation score names to class names.
MODERATION_CLASSES = {
    "harassment": "harassment",
    "harassment/threatening": "harassment",
    "hate": "hate_speech",
    "hate/defamatory": "hate_speech",
    "self-harm": "self_harm",
    "self-harm/intent": "self_harm",
    "self-harm/instructions": "self_harm",
    "sexual": "sexual_content",
    "sexual/minors": "sexual_content",
    "violence": "violence",
    "violence/graphic": "violence",
}

# Harm rating names to class names.
HARM_CLASSES = {
    "HARM_CATEGORY_HARASSMENT": "harassment",
    "HARM_CATEGORY_HATE_SPEECH": "hate_speech",
    "HARM_CATEGORY_SEXUALLY_EXPLICIT": "sexual_content",
    "HARM_CATEGORY_DANGEROUS_CONTENT": "violence",
    "HARM_CATEGORY_CIVIC_INTEGRITY": "misinformation",
}
HARM_LEVELS = 4.0
HARM_THRESHOLD = 0.5

# "safe" alone on its line, any Unicode or control whitespace around it.
_SAFE_LINE = r"(?U)\A[\s\x1c-\x1f]*safe[\s\x1c-\x1f]*\z"


def guard_lines(text) -> Column:
    return F.split(_col(text), "\n")


def guard_complete(lines) -> Column:
    """Whether a generation has the verdict line; fewer than 3 lines is a failure."""
    return F.coalesce(F.size(_col(lines)) >= 3, F.lit(False))


def guard_verdict(lines, classes: Sequence[str]) -> Column:
    """Line 3 is the verdict, later lines hold codes A1..An of the class list.

    A code counts only as a whole line.  Defined for complete generations.
    """
    lines = _col(lines)
    tail = F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(0)))
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.array_contains(tail, f"A{i}"), F.lit(name))
                for i, name in enumerate(classes, start=1)
            ]
        ).cast("array<string>")
    )
    return F.struct(
        F.get(lines, F.lit(2)).rlike(_SAFE_LINE).alias("is_safe"),
        F.lit(-1.0).alias("score"),
        F.get(hits, F.lit(0)).alias("category"),
        F.when(F.size(hits) > 0, hits).alias("categories"),
    )


def label_verdict(label, score, output) -> Column:
    """Unsafe only when the lowercased label is ``unsafe``.

    The class comes from the first S-code of the model *output*; an unmapped
    code is kept, no code gives an empty string.  (Reading the code from the
    prompt would always find the first listed hazard.)
    """
    is_safe = F.lower(F.coalesce(_col(label), F.lit(""))) != "unsafe"
    code = F.regexp_extract(F.coalesce(_col(output), F.lit("")), r"(S\d+)", 1)
    name = mapped_or_same(code, HAZARD_CODES)
    category = F.when(~is_safe, name)
    return F.struct(
        is_safe.alias("is_safe"),
        F.coalesce(_col(score).cast("double"), F.lit(0.0)).alias("score"),
        category.alias("category"),
    )


def moderation_verdict(
    flagged, scores, names: Mapping[str, str] = MODERATION_CLASSES
) -> Column:
    """Flag and score map to verdict; the first maximum wins a tie."""
    safe = ~F.coalesce(_col(flagged), F.lit(False))
    ranked = F.transform(
        F.map_entries(_col(scores)),
        lambda e, i: F.struct(
            e["value"].cast("double").alias("score"), (-i).alias("rank"), e["key"].alias("name")
        ),
    )
    top = F.array_max(ranked)
    return F.struct(
        safe.alias("is_safe"),
        F.coalesce(top["score"], F.lit(0.0)).alias("score"),
        F.when(~safe, mapped_or_same(top["name"], names)).alias("category"),
    )


def rating_verdict(ratings, names: Mapping[str, str] = HARM_CLASSES) -> Column:
    """Level 1..4 ratings to verdict.

    A strict running maximum keeps the first rating that reaches the overall
    maximum, so one ordered maximum gives the same answer as the fold.
    """
    ranked = F.transform(
        _col(ratings),
        lambda r, i: F.struct(
            (r["probability"].cast("double") / F.lit(HARM_LEVELS)).alias("score"),
            (-i).alias("rank"),
            r["category"].alias("name"),
        ),
    )
    top = F.array_max(ranked)
    score = F.greatest(F.coalesce(top["score"], F.lit(0.0)), F.lit(0.0))
    unsafe = score > F.lit(HARM_THRESHOLD)
    return F.struct(
        (~unsafe).alias("is_safe"),
        score.alias("score"),
        F.when(unsafe, mapped_or_same(top["name"], names)).alias("category"),
    )


def structured_verdict(category, safe: Sequence[str]) -> Column:
    """One chosen class of the list to verdict."""
    c = _col(category)
    return F.struct(
        c.isin(list(safe)).alias("is_safe"), F.lit(-1.0).alias("score"), c.alias("category")
    )


__all__ = [
    "HAZARD_CODES",
    "MODERATION_CLASSES",
    "HARM_CLASSES",
    "guard_lines",
    "guard_complete",
    "guard_verdict",
    "label_verdict",
    "moderation_verdict",
    "rating_verdict",
    "structured_verdict",
]
