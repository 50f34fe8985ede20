"""Label handling: safe set, list predictions, class names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .ratios import _col


def class_names(classes) -> list[str]:
    """Ordered class names of a ``name -> description`` mapping or a sequence."""
    return list(classes.keys()) if isinstance(classes, Mapping) else list(classes)


def truth_is_safe(category, safe: Sequence[str]) -> Column:
    """Whether a label is in the safe set; a missing label counts as unsafe."""
    return F.coalesce(_col(category).isin(list(safe)), F.lit(False))


def primary_category(categories) -> Column:
    """First class of a list prediction; NULL for a NULL or empty list."""
    return F.get(_col(categories), F.lit(0))


def known_class(category, classes: Sequence[str]) -> Column:
    """True for NULL or a name in the class list."""
    c = _col(category)
    return c.isNull() | c.isin(list(classes))


def checked_class(category, classes: Sequence[str], what: str) -> Column:
    """The label itself, raising on the executor when it is outside the list."""
    c = _col(category)
    message = F.concat(F.lit(f"{what} label outside the class list: "), c)
    return F.when(known_class(c, classes), c).otherwise(
        F.raise_error(message).cast("string")
    )


def array_literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def map_literal(mapping: Mapping[str, str]) -> Column:
    """A small fixed mapping as a constant-folded MAP literal."""
    parts = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*parts)


def mapped_or_same(name, mapping: Mapping[str, str]) -> Column:
    """Provider class name to the standard one; unmapped names stay."""
    c = _col(name)
    return F.coalesce(F.try_element_at(map_literal(mapping), c), c)
