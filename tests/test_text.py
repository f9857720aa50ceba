"""Python text rules, each against Python itself or a hand-made value."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions import (
    ChatTemplate,
    csv_list,
    last_assistant,
    none_str,
    py_capitalize,
    py_strip,
    render_chat,
    role_transcript,
    to_messages,
    word_tokens,
)
from tuneprep.functions.messages import MESSAGES
from tuneprep.functions.text import PYTHON_WHITESPACE


def apply(spark, value, column, dtype):
    schema = T.StructType([T.StructField("v", dtype)])
    return spark.createDataFrame([(value,)], schema).select(column.alias("out")).first()["out"]


TEXTS = ["", " ", "tool CALL", "élan VITAL", " x ", "​x​", "﻿x", "a b", PYTHON_WHITESPACE + "y"]


def test_strip_and_capitalize_equal_python(spark):
    df = spark.createDataFrame([(text,) for text in TEXTS], "v string")
    for row in df.select("v", py_strip(F.col("v")).alias("s"), py_capitalize(F.col("v")).alias("c")).collect():
        assert row.s == row.v.strip()
        assert row.c == row.v.capitalize()


def test_every_letter_and_space(spark):
    """All characters up to U+1C7F at the start, the end and inside of a text."""
    characters = [chr(i) for i in range(1, 0x1C80)] + [chr(i) for i in range(0x1E00, 0x3100)]
    unknown_to_python = {"\u019b", "\u0264"}  # their capitals are newer than Python's tables
    texts = [(c + "aB" + c + "C" + c,) for c in characters if c not in unknown_to_python]
    df = spark.createDataFrame(texts, "v string")
    for row in df.select("v", py_strip(F.col("v")).alias("s"), py_capitalize(F.col("v")).alias("c")).collect():
        assert row.s == row.v.strip()
        assert row.c == row.v.capitalize()


@pytest.mark.parametrize(
    "value, dtype, expected",
    [
        (None, T.StringType(), "None"),
        ("x", T.StringType(), "x"),
        (7, T.LongType(), "7"),
        (True, T.BooleanType(), "True"),
        (None, T.BooleanType(), "None"),
    ],
)
def test_none_str(spark, value, dtype, expected):
    assert apply(spark, value, none_str(F.col("v"), dtype), dtype) == expected


@pytest.mark.parametrize("dtype", [T.DoubleType(), T.ArrayType(T.StringType()), T.DateType()])
def test_none_str_refuses_types_printed_differently(spark, dtype):
    with pytest.raises(TypeError):
        none_str(F.col("v"), dtype)


@pytest.mark.parametrize(
    "value, expected", [("a, b,,c ", ["a", "b", "c"]), ("", None), (" , ,", None), (None, None), (" q_proj", ["q_proj"])]
)
def test_csv_list(spark, value, expected):
    assert apply(spark, value, csv_list(F.col("v")), T.StringType()) == expected


@pytest.mark.parametrize("text", ["", "  ", " a  b\tc\nd ", "one", "a b c d e f g h", None])
@pytest.mark.parametrize("n", [None, 1, 3, 100])
def test_word_tokens(spark, text, n):
    assert apply(spark, text, word_tokens(F.col("v"), n), T.StringType()) == (text or "").split()[:n]


def transcript_of(messages, prompt):
    lines = []
    for message in messages:
        if message is None:
            continue
        role = str(message[0]).strip() or "user"
        lines.append(f"{role.capitalize()}: {message[1]}")
    return "\n".join(lines + ["Assistant:"] * prompt).strip()


LISTS = [
    [],
    [None],
    [(" tool CALL ", "x"), ("", " y "), (None, "z"), None, ("assistant", None)],
    [("user", "  first"), ("assistant", "last \n")],
    [("Assistant", "capital"), ("user", "u")],
    [("assistant", "one"), ("user", "u"), ("assistant", "two"), ("user", "v")],
    [("assistant", None), ("user", "u")],
    [("user", "u"), None],
    [("user", None)],
]


@pytest.mark.parametrize("messages", LISTS)
@pytest.mark.parametrize("prompt", [False, True])
def test_role_transcript(spark, messages, prompt):
    text = apply(spark, messages, role_transcript(F.col("v"), add_generation_prompt=prompt), MESSAGES)
    assert text == transcript_of(messages, prompt)


@pytest.mark.parametrize("messages, expected", list(zip(LISTS, ["", "None", "None", "last \n", "u", "two", "None", "None", "None"])))
def test_last_assistant(spark, messages, expected):
    assert apply(spark, messages, last_assistant(F.col("v")), MESSAGES) == expected


def test_messages_without_role_or_content(spark):
    only_content = T.ArrayType(T.StructType([T.StructField("content", T.StringType())]))
    assert apply(spark, [("a",), ("b",)], last_assistant(F.col("v"), only_content), only_content) == "b"
    assert apply(spark, [("a",)], role_transcript(F.col("v"), only_content), only_content) == "User: a"
    only_role = T.ArrayType(T.StructType([T.StructField("role", T.StringType())]))
    assert apply(spark, [("assistant",)], last_assistant(F.col("v"), only_role), only_role) == ""


def test_chat_template(spark):
    template = ChatTemplate({"user": "U:", "assistant": "A:"}, ";", "?:", "<s>", "A:")
    messages = [("user", "hi"), None, ("tool", "t"), ("assistant", None)]
    assert apply(spark, messages, render_chat(F.col("v"), template), MESSAGES) == "<s>U:hi;?:t;A:None;"
    assert apply(spark, [], render_chat(F.col("v"), template, add_generation_prompt=True), MESSAGES) == "<s>A:"


def test_to_messages(spark):
    def pairs(value, dtype):
        rows = apply(spark, value, to_messages(F.lit("q"), F.col("v"), dtype), dtype)
        return [tuple(row) for row in rows]

    assert pairs("a", T.StringType()) == [("user", "q"), ("assistant", "a")]
    assert pairs(None, T.StringType()) == [("user", "q"), ("assistant", "None")]
    assert pairs([], MESSAGES) == []
    assert pairs([("system", "s")], MESSAGES) == [("system", "s")]
    assert pairs(None, MESSAGES) == [("user", "q"), ("assistant", "None")]
    with pytest.raises(TypeError):
        to_messages(F.lit("q"), F.col("v"), T.ArrayType(T.StringType()))
