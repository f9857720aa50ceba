"""The end-to-end preparations, and what physical plans read."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tuneprep.functions import ChatTemplate
from tuneprep.operators.encoding import Vocabulary, build_vocab
from tuneprep.plans import ppo_prepare, rm_prepare, sft_prepare
from tuneprep.sources import views

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40).select(
        F.col("id").alias("k"),
        F.format_string("what is %d", "id").alias("prompt"),
        F.format_string("it is %d indeed", "id").alias("chosen"),
        F.format_string("no %d", "id").alias("rejected"),
    )


def test_tuning_blocks(spark, rows):
    out = sft_prepare(rows, ["k"], size_valid_set=8, max_train_samples=30, seq_length=10, batch_size=2, eos_id=1)
    assert out.columns == ["split", "block_id", "batch_id", "input_ids"]
    collected = out.collect()
    sizes = {split: [r for r in collected if r.split == split] for split in ("train", "test")}
    # "Question: what is n Answer: it is n indeed" and an end mark: 10 ids a row.
    assert {split: len(part) for split, part in sizes.items()} == {"train": 22, "test": 8}
    assert all(len(r.input_ids) == 10 and r.input_ids[-1] == 1 and r.batch_id == r.block_id // 2 for r in collected)


def test_tuning_on_given_text_and_chat(spark, rows):
    text = rows.select("k", F.lit("a b c").alias("text"))
    assert sft_prepare(text, ["k"], 10, seq_length=6, batch_size=1).count() == 20
    chat = rows.select("k", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    with pytest.raises(ValueError, match="template"):
        sft_prepare(chat, ["k"], 10)
    template = ChatTemplate({"user": "U "}, " E ", "? ", "", "A ")
    assert sft_prepare(chat, ["k"], 10, seq_length=5, batch_size=1, template=template).count() == 40


def test_reward_batches(spark, rows):
    vocab = Vocabulary(build_vocab(rows.select(F.col("chosen").alias("text")), 100, first_id=2))
    train, evaluation = rm_prepare(
        rows.where("k < 30"), rows.where("k >= 30"), ["k"], vocab, 1, train_subset=21, eval_subset=0, batch_size=4, accumulation=2
    )
    assert (train.count(), evaluation.count()) == (21, 10)
    batches = {}
    for r in train.collect():
        assert r.batch_id == r.k // 8
        batches.setdefault(r.batch_id, set()).add((len(r.input_ids_j), len(r.attention_mask_j), len(r.input_ids_k)))
    assert all(len(lengths) == 1 for lengths in batches.values())
    assert {r.batch_id for r in evaluation.collect()} == {0, 1, 2}


def test_policy_prompts(spark, rows):
    vocab = build_vocab(rows.select(F.col("prompt").alias("text")), 100)
    out = ppo_prepare(rows, ["k"], vocab, max_train_samples=7, max_prompt_length=3)
    assert out.columns == ["input_ids"] and out.count() == 7
    assert all(len(r.input_ids) == 3 for r in out.collect())


@pytest.mark.parametrize(
    "name, columns",
    [
        ("pairwise_accuracy", {"l_discount", "l_tax"}),
        ("flagged_share", {"p_size", "p_brand"}),
        ("assign_batches", {"doc_id"}),
        ("csv_list", {"doc_id", "text"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    plan = entry_module.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"testdata.*?ReadSchema: struct<(.*?)>", plan)
    assert schemas and {part.split(":")[0] for schema in schemas for part in schema.split(",")} == columns


def test_roles_are_filtered_in_the_scan(spark):
    plan = entry_module.queries()["ppo_prompt_text"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan


@pytest.mark.parametrize("view", [views.chat, views.exchanges, views.qa])
def test_hot_conversations_are_spread(spark, view):
    """Conversations are joined turn by turn and gathered nowhere."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        plan = view(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(name)
    shuffles = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert shuffles and all("conv_id" in keys and "turn" in keys for keys in shuffles)
    assert "collect_list" not in plan
