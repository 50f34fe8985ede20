"""Prompt rendering from constants and the text column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .ratios import _col

# The default classifier instruction around the class list.
DEFAULT_PROMPT_HEAD = (
    "You are a content safety classifier. Evaluate the provided text and "
    "classify it into one of these categories:\n\n"
)
DEFAULT_PROMPT_TAIL = (
    "\n\nRespond ONLY with valid JSON in the following format (no markdown, "
    'no code blocks, just raw JSON):\n{"category": "<category_name>"}'
)
# The variant for models that also answer with an explanation.
EXPLAINED_PROMPT_TAIL = (
    "\n\nRespond ONLY with valid JSON in the following format (no markdown, "
    'no code blocks, just raw JSON):\n{"category": "<category_name>", '
    '"explanation": "<brief explanation>"}'
)

# The instruction text a fixed-taxonomy guard model expects.
GUARD_HEAD = """[INST] Task: Check if there is unsafe content in the user message.
<BEGIN UNSAFE CONTENT CATEGORIES>
S1: Violence and Hate.
S2: Sexual content.
S3: Criminal activity.
S4: Guns and Illegal Weapons.
S5: Controlled Substances.
S6: Self-Harm.
S7: Animal Abuse.
S8: Hate Speech and Bullying.
S9: Dark web marketplaces.
S10: Regulated or Controlled commodities.
S11: Weapons trafficking and stashing.
S12: Extreme violence and gore.
<END UNSAFE CONTENT CATEGORIES>

User message: \""""
GUARD_TAIL = """\"

Provide the safety assessment as a single word: either "safe" or "unsafe". If unsafe, specify the category.
[/INST]"""


def class_list_text(classes: Mapping[str, str]) -> str:
    return "\n".join(f"- {name}: {text}" for name, text in classes.items())


def system_prompt(
    classes: Mapping[str, str], base: str | None = None, explain: bool = False
) -> str:
    """The run-constant system prompt: base prompt plus class list, or the default."""
    listing = class_list_text(classes)
    if base is not None:
        return f"{base}\n\nCategories:\n{listing}"
    return DEFAULT_PROMPT_HEAD + listing + (EXPLAINED_PROMPT_TAIL if explain else DEFAULT_PROMPT_TAIL)


def guard_prompt(text) -> Column:
    return F.concat(F.lit(GUARD_HEAD), _col(text), F.lit(GUARD_TAIL))
