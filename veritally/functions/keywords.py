"""Deterministic keyword classifier as one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .ratios import _col

# Rule order and keywords; the first rule with a hit wins.
KEYWORD_RULES = (
    ("violence", ("kill", "hurt", "attack")),
    ("hate_speech", ("hate", "despise", "detest")),
    ("sexual_content", ("sex", "nude", "explicit")),
    ("harassment", ("bully", "harass", "mock")),
    ("misinformation", ("fake", "false", "lie")),
)
NO_HIT = "none"


def keyword_category(text, rules: Sequence = KEYWORD_RULES, default: str = NO_HIT) -> Column:
    """First class with a substring hit in the lowercased text, else default."""
    low = F.lower(_col(text))
    verdict = F.lit(default)
    for name, words in reversed(list(rules)):
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        verdict = F.when(hit, F.lit(name)).otherwise(verdict)
    return verdict
