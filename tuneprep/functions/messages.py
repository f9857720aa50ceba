"""Column functions over chat message lists, ``ARRAY<STRUCT<role, content>>``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.text import none_str, py_capitalize, py_strip

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def is_messages(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)


def _getter(dtype: T.DataType, name: str, default: str):
    """Text of one message field; ``default`` only where the type has no such field."""
    if not is_messages(dtype):
        raise TypeError(f"Expected an array of role/content structs, not {dtype.simpleString()}.")
    fields = {f.name: f.dataType for f in dtype.elementType.fields}
    if name not in fields:
        return lambda message: F.lit(default)
    return lambda message: none_str(message[name], fields[name])


def to_messages(prompt: Column, response: Column, response_type: T.DataType) -> Column:
    """A message list as it is; text as a user/assistant exchange.

    A NULL list is wrapped like the text ``None``. Lists of anything but messages
    are refused when the plan is built.
    """
    if is_messages(response_type):
        names = response_type.elementType.names
        role, content = _getter(response_type, "role", "user"), _getter(response_type, "content", "")

        def clean(message: Column) -> Column:
            fields = [
                (message["role"] if "role" in names else role(message)).cast("string").alias("role"),
                (message["content"] if "content" in names else content(message)).cast("string").alias("content"),
            ]
            return F.when(message.isNotNull(), F.struct(*fields))

        return F.when(response.isNotNull(), F.transform(response, clean)).otherwise(_exchange(prompt, F.lit("None")))
    if isinstance(response_type, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"A response must be text or a message list, not {response_type.simpleString()}.")
    return _exchange(prompt, none_str(response, response_type))


def _exchange(prompt: Column, answer: Column) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )


def last_assistant(messages: Column, dtype: T.DataType = MESSAGES) -> Column:
    """Content of the last ``assistant`` message, else of the last message, else empty text.

    Branches on list size rather than on NULLs: a NULL content counts as ``None``.
    """
    content = _getter(dtype, "content", "")

    def last(items: Column) -> Column:
        item = F.try_element_at(items, F.lit(-1))
        return F.when(item.isNull(), "None").otherwise(content(item))

    fallback = F.when(F.size(messages) > 0, last(messages)).otherwise("")
    if "role" not in dtype.elementType.names:
        return fallback
    replies = F.filter(messages, lambda message: message["role"] == "assistant")
    return F.when(F.size(replies) > 0, last(replies)).otherwise(fallback)


def role_transcript(messages: Column, dtype: T.DataType = MESSAGES, add_generation_prompt: bool = False) -> Column:
    """One ``Role: content`` line per message, NULL messages skipped, ends stripped."""
    role, content = _getter(dtype, "role", "user"), _getter(dtype, "content", "")

    def line(message: Column) -> Column:
        name = py_strip(role(message))
        return F.concat(py_capitalize(F.when(name == "", "user").otherwise(name)), F.lit(": "), content(message))

    lines = F.transform(F.filter(messages, lambda message: message.isNotNull()), line)
    if add_generation_prompt:
        lines = F.concat(lines, F.array(F.lit("Assistant:")))
    return py_strip(F.array_join(lines, "\n"))


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative chat markup: what stands before and after a message of each role."""

    prefixes: Mapping[str, str] = field(
        default_factory=lambda: {
            "system": "<|system|>\n",
            "user": "<|user|>\n",
            "assistant": "<|assistant|>\n",
        }
    )
    suffix: str = "<|end|>\n"
    other_prefix: str = "<|user|>\n"
    begin: str = ""
    generation_prompt: str = "<|assistant|>\n"


def render_chat(
    messages: Column,
    template: ChatTemplate,
    dtype: T.DataType = MESSAGES,
    add_generation_prompt: bool = False,
) -> Column:
    """Message list to text through a template, with native expressions only."""
    role, content = _getter(dtype, "role", "user"), _getter(dtype, "content", "")

    def block(message: Column) -> Column:
        prefix = F.lit(template.other_prefix)
        for name, text in template.prefixes.items():
            prefix = F.when(role(message) == name, text).otherwise(prefix)
        return F.concat(prefix, content(message), F.lit(template.suffix))

    blocks = F.transform(F.filter(messages, lambda message: message.isNotNull()), block)
    end = template.generation_prompt if add_generation_prompt else ""
    return F.concat(F.lit(template.begin), F.array_join(blocks, ""), F.lit(end))
