"""Reading splits and writing results."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tuneprep.operators.columns import format_text
from tuneprep.queries import sql
from tuneprep.queries.registry import query
from tuneprep.sources import (
    layout_path,
    read_arrow,
    read_split,
    read_stream,
    read_train_eval,
    views,
    write_arrow,
    write_prepared,
)
from tuneprep.storage import scratch_path


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang", "read_split")
def split_folder(spark, sf_dir):
    documents = read_split(spark, sf_dir, "documents.parquet")
    return documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "read_split_data_dir")
def split_data_dir(spark, sf_dir):
    base, data_dir = os.path.split(sf_dir.rstrip("/"))
    return (
        read_split(spark, base, "orders.parquet", data_dir=data_dir)
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "SELECT turn, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations "
    "WHERE role = 'assistant' GROUP BY turn",
    "read_split_column",
)
def split_column(spark, sf_dir):
    replies = read_split(spark, f"{sf_dir}/conversations.parquet", "assistant", split_column="role")
    return replies.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "SELECT CASE role WHEN 'user' THEN 'train' ELSE 'eval' END AS part, count(*) AS n FROM conversations "
    "WHERE role IN ('user', 'assistant') GROUP BY role",
    "read_train_eval",
)
def train_and_eval(spark, sf_dir):
    train, evaluation = read_train_eval(
        spark, f"{sf_dir}/conversations.parquet", "user", "assistant", split_column="role"
    )
    counted = [
        part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, part in (("train", train), ("eval", evaluation))
    ]
    return counted[0].union(counted[1])


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def read_split_json(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    base = scratch_path(spark, "json")
    write_prepared(turns, base, "train_sft", fmt="json")
    copy = read_split(spark, base, "train_sft", fmt="json", schema=turns.schema)
    return copy.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {sql.QA} SELECT conv_id, turn, {sql.qa_text('question', 'response_j')} AS text FROM qa", "write_prepared")
def prepared_table(spark, sf_dir):
    texts = format_text(views.qa(spark, sf_dir), views.TURN_KEY)
    return spark.read.parquet(write_prepared(texts, scratch_path(spark, "prepared")))


@query("SELECT role, turn % 2 AS half, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL")
def write_prepared_replaced(spark, sf_dir):
    """A result made from the one that it replaces, partitioned anew."""
    base = scratch_path(spark, "replaced")
    earlier = spark.read.parquet(write_prepared(views.table(spark, sf_dir, "conversations"), base))
    halves = earlier.withColumn("half", F.col("turn") % 2)
    later = spark.read.parquet(write_prepared(halves, base, partition_by=("role",)))
    return later.groupBy("role", "half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def read_split_arrow(spark, sf_dir):
    """Written by the sink in two commits, read back with two of four columns."""
    turns = views.table(spark, sf_dir, "conversations")
    base = scratch_path(spark, "arrow")
    path = write_prepared(turns.where("conv_id % 2 = 0"), base, "train_sft", fmt="arrow")
    write_arrow(turns.where("conv_id % 2 <> 0 OR conv_id IS NULL"), path, "append")
    copy = read_arrow(spark, path, turns.schema, columns=["role", "text"])
    return copy.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, lang, source, length(text) AS n FROM documents WHERE source = 'src1' AND doc_id >= 10")
def read_split_arrow_column(spark, sf_dir):
    """A split column and a comparison that the reader decides where the session lets it."""
    documents = views.table(spark, sf_dir, "documents")
    base = scratch_path(spark, "arrow")
    write_prepared(documents.withColumn("split", F.col("source")), base, "all", fmt="arrow")
    part = read_split(spark, f"{base}/all", "src1", split_column="split", fmt="arrow")
    return part.where("doc_id >= 10").select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM documents")
def read_stream_arrow(spark, sf_dir):
    """A stream over files that arrive in two commits, run twice from one checkpoint, holds what a batch does."""
    documents = views.table(spark, sf_dir, "documents")
    base, out = scratch_path(spark, "arrow-stream"), scratch_path(spark, "arrow-rows")
    first = F.coalesce(F.pmod("doc_id", F.lit(3)) == 0, F.lit(True))
    for part in (documents.where(first), documents.where(~first)):
        write_arrow(part, base, "append")
        stream = read_stream(spark, base, documents.schema, fmt="arrow")
        writer = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log")
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(documents.schema).parquet(f"{out}/rows")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"))


@query(
    "SELECT CASE role WHEN 'user' THEN 'finetune' WHEN 'assistant' THEN 'reward' ELSE 'rl' END AS folder, "
    "count(*) AS n FROM conversations GROUP BY 1",
    "layout_path",
)
def dataset_layout(spark, sf_dir):
    """One table per stage of a local dataset, written to and read from its fixed folder."""
    turns, root = views.table(spark, sf_dir, "conversations"), scratch_path(spark, "layout")
    parts = {"sft": F.col("role") == "user", "reward_train": F.col("role") == "assistant", "prompts": ~F.col("role").isin("user", "assistant")}
    counts = []
    for stage, where in parts.items():
        folder, name = os.path.split(layout_path(root, stage))
        write_prepared(turns.where(where), folder, name)
        part = read_split(spark, layout_path(root, stage)).groupBy(F.lit(name).alias("folder"))
        counts.append(part.agg(F.count(F.lit(1)).alias("n")))
    return counts[0].union(counts[1]).union(counts[2])
