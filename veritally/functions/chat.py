"""Text of one chat item held as a JSON object string."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ratios import _col

_FIELDS = (
    "messages array<struct<role:string,content:string>>, "
    "text string, content string, message string"
)


def chat_fields(item) -> Column:
    """The typed text fields of an item."""
    return F.from_json(_col(item), _FIELDS)


def chat_map(item) -> Column:
    """All fields of an item as text."""
    return F.from_json(_col(item), "map<string,string>")


def messages_text(messages) -> Column:
    """Message contents joined by newline, NULL when no message has content."""
    parts = F.filter(
        F.transform(_col(messages), lambda m: m["content"]), lambda c: c.isNotNull()
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def all_string_fields(item, plain) -> Column:
    """Every string-valued field in document order, joined by a space."""
    raw, plain = _col(item), _col(plain)
    typed = F.try_variant_get(F.parse_json(raw), "$", "map<string,variant>")
    keys = F.filter(
        F.json_object_keys(raw),
        lambda k: F.schema_of_variant(F.element_at(typed, k)) == "STRING",
    )
    values = F.transform(keys, lambda k: F.element_at(plain, k))
    return F.when(F.size(values) > 0, F.array_join(values, " "))


def chat_text(item, fields, plain) -> Column:
    """messages, then text, content, message, then all string fields; NULL if none.

    ``fields`` and ``plain`` are the parsed forms of ``item``.
    """
    f = _col(fields)
    return F.coalesce(
        messages_text(f["messages"]),
        f["text"],
        f["content"],
        f["message"],
        all_string_fields(item, plain),
    )
