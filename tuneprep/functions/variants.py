"""Column functions over VARIANT values, whose type may differ from row to row.

A field of a preference row is text in one row and a message list in the next. Every
function decides per row: text stays text, a list that is empty or starts with an
object is a message list, anything else counts as ``str(value)``. Numbers print as in
JSON, lists and objects as their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.messages import last_assistant


def is_variant(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, T.VariantType)


def _items(value: Column) -> Column:
    """The elements of a list, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _is_scalar(value: Column) -> Column:
    return _items(value).isNull() & ~_is_object(value)


def variant_is_text(value: Column) -> Column:
    """Whether the value is a string; false for NULL."""
    kind = F.when(_is_scalar(value), F.schema_of_variant(value))
    return F.coalesce(kind == "STRING", F.lit(False))


def variant_text(value: Column) -> Column:
    """``str(value)``: missing values and JSON's null are the text ``None``."""
    text = F.try_variant_get(value, "$", "string")
    is_boolean = F.coalesce(F.when(_is_scalar(value), F.schema_of_variant(value)) == "BOOLEAN", F.lit(False))
    return F.coalesce(F.when(is_boolean, F.initcap(text)).otherwise(text), F.lit("None"))


def variant_is_messages(value: Column) -> Column:
    """Whether the value is a message list: empty, or its first element is an object."""
    items = _items(value)
    return F.coalesce((F.size(items) == 0) | _is_object(F.get(items, F.lit(0))), F.lit(False))


def _field(message: Column, name: str, default: str) -> Column:
    value = F.try_variant_get(message, f"$.{name}", "variant")
    return F.when(value.isNull(), default).otherwise(variant_text(value))


def variant_messages(value: Column) -> Column:
    """A message list as ``ARRAY<STRUCT<role, content>>``; elements that are no messages are NULL."""

    def clean(item: Column) -> Column:
        fields = F.struct(_field(item, "role", "user").alias("role"), _field(item, "content", "").alias("content"))
        return F.when(_is_object(item), fields)

    return F.transform(_items(value), clean)


def variant_reply(value: Column) -> Column:
    """The last assistant message of a list, else its last element; other values as text."""
    messages, items = variant_messages(value), _items(value)
    answered = F.exists(messages, lambda message: message["role"] == "assistant")
    last = F.try_element_at(items, F.lit(-1))
    stray = ~F.coalesce(answered, F.lit(False)) & (F.size(items) > 0) & ~_is_object(last)
    reply = F.when(stray, variant_text(last)).otherwise(last_assistant(messages))
    return F.when(variant_is_messages(value), reply).otherwise(variant_text(value))


def variant_exchange(prompt: Column, value: Column) -> Column:
    """A message list as it is; anything else as the assistant's answer to the prompt."""
    answer = F.array(
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
        F.struct(F.lit("assistant").alias("role"), variant_text(value).alias("content")),
    )
    return F.when(variant_is_messages(value), variant_messages(value)).otherwise(answer)
