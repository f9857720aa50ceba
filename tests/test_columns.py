"""Choice of columns by schema: every branch and its precedence."""

import pytest
from pyspark.sql import functions as F

from tuneprep.functions import ChatTemplate
from tuneprep.operators.columns import (
    format_text,
    needs_text_formatting,
    pair_texts,
    prepare_text,
    prompt_texts,
    prune_chat_columns,
)

CHAT = "array<struct<role:string,content:string>>"


def texts(df, **options):
    return [row[0] for row in format_text(df, **options).collect()]


def test_question_and_answer_come_first(spark):
    df = spark.createDataFrame(
        [("q", "j", "p", "c", "r")], "question string, response_j string, prompt string, chosen string, response string"
    )
    assert texts(df) == ["Question: q\n\nAnswer: j"]
    assert texts(df.drop("question")) == ["Question: p\n\nAnswer: c"]
    assert texts(df.drop("question", "chosen")) == ["Question: p\n\nAnswer: r"]
    assert format_text(df, ["prompt"]).columns == ["prompt", "text"]


def test_missing_values(spark):
    df = spark.createDataFrame([(None, "j")], "question string, response_j string")
    assert texts(df) == ["Question: None\n\nAnswer: j"]
    chosen = spark.createDataFrame([("p", None, "r"), ("p", "c", "r")], "prompt string, chosen string, response string")
    assert sorted(texts(chosen)) == ["Question: p\n\nAnswer: c", "Question: p\n\nAnswer: r"]
    with pytest.raises(Exception, match="Unsupported columns"):
        texts(chosen.drop("response"))


def test_chosen_messages_are_not_text(spark):
    df = spark.createDataFrame([("p", [("user", "u")], "r")], f"prompt string, chosen {CHAT}, response string")
    assert texts(df) == ["Question: p\n\nAnswer: r"]
    with pytest.raises(KeyError):
        format_text(df.drop("response"))
    with pytest.raises(KeyError):
        format_text(df.select("prompt"))


def test_pairs(spark):
    df = spark.createDataFrame(
        [("q", "j", "k", "p", "c", "r")],
        "question string, response_j string, response_k string, prompt string, chosen string, rejected string",
    )

    def both(frame, **options):
        return tuple(pair_texts(frame, **options).first())

    assert both(df) == ("Question: q\n\nAnswer: j", "Question: q\n\nAnswer: k")
    assert both(df.drop("question")) == ("Question: p\n\nAnswer: c", "Question: p\n\nAnswer: r")
    assert both(df.select("prompt", "response_j", "response_k")) == ("Question: p\n\nAnswer: j", "Question: p\n\nAnswer: k")
    with pytest.raises(KeyError):
        pair_texts(df.select("prompt", "chosen"))


def test_pair_sides_of_different_type(spark):
    df = spark.createDataFrame(
        [(None, [("user", "u"), ("assistant", "good"), ("user", "v")], None)], f"prompt string, chosen {CHAT}, rejected string"
    )
    assert tuple(pair_texts(df).first()) == ("Question: None\n\nAnswer: good", "Question: None\n\nAnswer: None")
    template = ChatTemplate({"user": "U:", "assistant": "A:"}, ";", "?:", "", "A:")
    assert tuple(pair_texts(df, template).first()) == ("U:u;A:good;U:v;", "U:None;A:None;")


def test_prompts(spark):
    df = spark.createDataFrame([("p", "q")], "prompt string, question string")
    assert prompt_texts(df).first()[0] == "Question: p\n\nAnswer: "
    assert prompt_texts(df.drop("prompt")).first()[0] == "Question: q\n\nAnswer: "
    numbers = spark.createDataFrame([(5,), (None,)], "prompt int")
    assert {row[0] for row in prompt_texts(numbers).collect()} == {"Question: 5\n\nAnswer: ", "Question: None\n\nAnswer: "}
    with pytest.raises(KeyError):
        prompt_texts(df.select(F.lit("x").alias("other")))


def test_pruning_and_formatting(spark):
    chat = spark.createDataFrame([([("user", "u")], "p", "t", 1)], f"messages {CHAT}, prompt string, tools string, n int")
    assert prune_chat_columns(chat).columns == ["messages", "tools"]
    assert prune_chat_columns(chat.withColumn("completion", F.lit("c"))).columns[-1] == "completion"
    assert prune_chat_columns(chat.drop("prompt")).columns == ["messages", "tools", "n"]
    assert not needs_text_formatting(chat)
    plain = spark.createDataFrame([("q", "a")], "prompt string, response string")
    assert needs_text_formatting(plain)
    assert not needs_text_formatting(plain.withColumn("text", F.lit("t")))
    # The training columns decide for both parts.
    train, evaluation = prepare_text(plain, plain.withColumn("text", F.lit("t")))
    assert train.columns == evaluation.columns == ["text"]
    assert evaluation.first()[0] == "Question: q\n\nAnswer: a"
    kept, pruned = prepare_text(plain.withColumn("text", F.lit("t")), chat)
    assert kept.columns == ["prompt", "response", "text"] and pruned.columns == ["messages", "tools"]
