"""Chat, prompt and preference tables derived from the given tables.

Joins go by (conversation, turn), which is unique: a conversation that holds a third
of all rows spreads like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_KEY = ("conv_id", "turn")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user turn: the turn before it, the turn itself and the turn after it.

    ``messages`` holds what there is of the three, in order; ``prompt`` is the user
    text. Lists are put together by joins on the turn number, not by gathering a
    whole conversation.
    """
    turns = table(spark, sf_dir, "conversations")
    message = F.struct("role", F.col("text").alias("content"))

    def neighbour(distance: int, name: str) -> DataFrame:
        return turns.select("conv_id", (F.col("turn") - distance).alias("turn"), message.alias(name))

    users = turns.where(F.col("role") == "user").select(*TURN_KEY, message.alias("_user"), F.col("text").alias("prompt"))
    return (
        users.join(neighbour(-1, "_before"), list(TURN_KEY), "left")
        .join(neighbour(1, "_after"), list(TURN_KEY), "left")
        .select(*TURN_KEY, "prompt", F.array_compact(F.array("_before", "_user", "_after")).alias("messages"))
    )


def _replies(turns: DataFrame, to_turn: int, name: str) -> DataFrame:
    """Assistant texts keyed by the turn that lies ``to_turn`` after their own."""
    replies = turns.where(F.col("role") == "assistant")
    return replies.select("conv_id", (F.col("turn") + to_turn).alias("turn"), F.col("text").alias(name))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn answered in the next turn: (conv_id, turn, question, answer)."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(*TURN_KEY, F.col("text").alias("question"))
    return asked.join(_replies(turns, -1, "answer"), list(TURN_KEY))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, response_j, response_k): the worse reply repeats the one just before the question.

    Where there is none, the worse reply only echoes the question.
    """
    before = _replies(table(spark, sf_dir, "conversations"), 1, "earlier")
    return exchanges(spark, sf_dir).join(before, list(TURN_KEY), "left").select(
        *TURN_KEY,
        "question",
        F.col("answer").alias("response_j"),
        F.coalesce("earlier", "question").alias("response_k"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).withColumnsRenamed(
        {"question": "prompt", "response_j": "chosen", "response_k": "rejected"}
    )


def pairs_jk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).withColumnRenamed("question", "prompt")


def pairs_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    def exchange(answer: str):
        return F.array(
            F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("content")),
        )

    return pairs(spark, sf_dir).select(
        *TURN_KEY, "prompt", exchange("chosen").alias("chosen"), exchange("rejected").alias("rejected")
    )


# How the sides of mixed pairs are put, by the remainder of (conv_id + turn).
MIXED_KINDS = 10


def mixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt, chosen, rejected) whose sides are VARIANT: text, message lists with and without stray
    elements or missing fields, empty lists, numbers, null, booleans and lists of text."""

    def message(role: str, content: str | None):
        fields = [F.lit(role).alias("role"), *([F.col(content).alias("content")] if content else [])]
        return F.to_json(F.struct(*fields))

    def listed(*parts):
        return F.concat(F.lit("["), *[p for part in parts for p in (F.lit(","), part)][1:], F.lit("]"))

    def side(answer: str, other: str, shift: int):
        text = F.to_json(F.array(answer))
        kinds = [
            F.substring(text, F.lit(2), F.length(text) - 2),
            listed(message("user", "question"), message("assistant", answer)),
            listed(message("assistant", other), F.lit('"stray"'), message("assistant", answer), F.lit("7")),
            listed(message("user", "question"), F.lit('"stray"')),
            F.lit("[]"),
            F.length(answer).cast("string"),
            F.lit("null"),
            listed(message("assistant", None), message("user", "question")),
            F.lit("true"),
            F.lit('["a","b"]'),
        ]
        return F.parse_json(F.get(F.array(*kinds), F.pmod(F.col("conv_id") + F.col("turn") + shift, F.lit(MIXED_KINDS)).cast("int")))

    return qa(spark, sf_dir).select(
        *TURN_KEY,
        F.col("question").alias("prompt"),
        side("response_j", "response_k", 0).alias("chosen"),
        side("response_k", "response_j", 3).alias("rejected"),
        F.col("response_k").alias("response"),
    )


def doc_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("lang", F.lit("/"), "source").alias("prompt"), F.col("text").alias("response")
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return users.select(*TURN_KEY, F.col("text").alias("prompt"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_discount").alias("rewards_j"), F.col("l_tax").alias("rewards_k")
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors 2i and 2i+1 with different labels; x_j has the larger label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("pair_id", F.expr("vec_id div 2"))
    return (
        vectors.groupBy("pair_id")
        .agg(
            F.max_by("embedding", "label").alias("x_j"),
            F.min_by("embedding", "label").alias("x_k"),
            F.max("label").alias("_high"),
            F.min("label").alias("_low"),
        )
        .where(F.col("_high") != F.col("_low"))
        .drop("_high", "_low")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"),
        F.col("p_size").alias("numel"),
        (F.col("p_brand") == "Brand#1").alias("requires_grad"),
    )
