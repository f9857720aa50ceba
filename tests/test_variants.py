"""Rows whose fields are text in one row and lists in the next, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tuneprep.functions import ChatTemplate, role_transcript
from tuneprep.functions.variants import variant_exchange, variant_is_messages, variant_is_text, variant_messages, variant_reply, variant_text
from tuneprep.operators.columns import chat_texts, format_text, pair_texts

U, A = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
VALUES = [
    "text", "", "None", 5, -1, True, False, None, [], [U, A], [A, U], [U], [U, "stray"], [A, "stray", 7, None], [U, None], [{}], [{"role": None}],
    [{"role": "assistant"}], [{"role": "assistant", "content": None}], [{"content": 5, "role": " tool CALL "}], [{"role": "", "content": True}],
    [{"role": "Assistant", "content": "x"}], ["a", "b"], [None], [[U]], {"role": "user"}, [A, {"role": "assistant", "content": "é\n\"last\""}],
]


def text(value):
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True) if isinstance(value, (list, dict)) else str(value)


def is_list(value):
    return isinstance(value, list) and (not value or isinstance(value[0], dict))


def messages(value):
    return [m if isinstance(m, dict) else None for m in value]


def reply(value):
    if not is_list(value):
        return text(value)
    for message in reversed(value):
        if isinstance(message, dict) and message.get("role") == "assistant":
            return text(message.get("content", ""))
    if not value:
        return ""
    return text(value[-1].get("content", "")) if isinstance(value[-1], dict) else text(value[-1])


def transcript(value):
    lines = [f"{(text(m.get('role', 'user')).strip() or 'user').capitalize()}: {text(m.get('content', ''))}" for m in value if isinstance(m, dict)]
    return "\n".join(lines).strip()


def table(spark):
    rows = [(i, json.dumps(value)) for i, value in enumerate(VALUES)] + [(len(VALUES), None)]
    return spark.createDataFrame(rows, "i int, json string").select("i", F.parse_json("json").alias("v"))


@pytest.mark.parametrize("stored", ["memory", "parquet", "json"])
def test_rows(spark, out_dir, stored):
    df = table(spark)
    if stored != "memory":
        df.write.format(stored).save(out_dir)
        df = spark.read.schema(df.schema).format(stored).load(out_dir)
    v = F.col("v")
    found = df.select("i", variant_text(v), variant_is_text(v), variant_is_messages(v), variant_reply(v), role_transcript(variant_messages(v))).collect()
    assert len(found) == len(VALUES) + 1
    for i, as_text, is_text, is_messages, answer, lines in found:
        value = VALUES[i] if i < len(VALUES) else None
        assert (as_text, is_text, is_messages) == (text(value), isinstance(value, str), is_list(value)), value
        assert answer == reply(value), value
        if is_list(value):
            assert lines == transcript(value), value


def test_pairs(spark):
    df = table(spark).select("i", F.lit("p").alias("prompt"), F.col("v").alias("chosen"), F.lit("worse").alias("rejected"))
    for row in pair_texts(df, keep=["i"]).collect():
        value = VALUES[row.i] if row.i < len(VALUES) else None
        assert row.text_j == f"Question: p\n\nAnswer: {reply(value)}" and row.text_k == "Question: p\n\nAnswer: worse"
    plain = ChatTemplate({"user": "U:", "assistant": "A:"}, ";", "O:", "", "")
    for row in pair_texts(df, plain, ["i"]).collect():
        value = VALUES[row.i] if row.i < len(VALUES) else None
        wanted = value if is_list(value) else [{"role": "user", "content": "p"}, {"role": "assistant", "content": text(value)}]
        marks = {"user": "U:", "assistant": "A:"}
        parts = [marks.get(text(m.get("role", "user")), "O:") + text(m.get("content", "")) + ";" for m in wanted if isinstance(m, dict)]
        assert row.text_j == "".join(parts), value


def test_tuning_text(spark):
    df = table(spark).select("i", F.lit("p").alias("prompt"), F.col("v").alias("chosen"), F.lit("r").alias("response"))
    for row in format_text(df, ["i"]).collect():
        value = VALUES[row.i] if row.i < len(VALUES) else None
        assert row.text == f"Question: p\n\nAnswer: {value if isinstance(value, str) else 'r'}"
    with pytest.raises(Exception, match="Unsupported columns"):
        format_text(df.drop("response"), ["i"]).collect()


def test_chats(spark):
    lists = table(spark).where(variant_is_messages(F.col("v"))).withColumnRenamed("v", "messages")
    assert chat_texts(lists, ChatTemplate(), ["i"]).count() == sum(map(is_list, VALUES))
    wrapped = table(spark).where("i = 0").select(variant_exchange(F.lit("p"), F.col("v")).alias("m")).first().m
    assert [tuple(m) for m in wrapped] == [("user", "p"), ("assistant", "text")]
