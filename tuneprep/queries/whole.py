"""The three preparations from input table to batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneprep.operators.splits import exact_split
from tuneprep.plans import ppo_prepare, rm_evaluate, rm_prepare, sft_prepare
from tuneprep.queries import sql
from tuneprep.queries.metrics import FIT_STEPS, LOSS_SQL, REG_PARAM
from tuneprep.queries.registry import query
from tuneprep.queries.texts import TEMPLATE
from tuneprep.queries.tokens import (
    CHAT_VOCAB,
    EOS,
    FIRST_ID,
    KEY,
    PAIR_IDS,
    WORDS,
    chat_vocab,
    collate_sql,
    shown,
)
from tuneprep.sources import views
from tuneprep.storage import materialize

VALID, SEED, SEQ_LENGTH, BATCH = 100, 11, 128, 4

SFT_SQL = f"""
WITH {sql.split('marked', 'documents', ['doc_id'], VALID, SEED)},
texts AS (SELECT doc_id, split, split_hash, {sql.qa_text("lang || '/' || source", 'text')} AS text FROM marked),
{sql.words('all_words', 'texts', 'doc_id, split, split_hash')},
train_words AS (SELECT * FROM all_words WHERE split = 'train'),
{sql.vocab('train_words', WORDS, FIRST_ID - 1)},
ids AS (
  SELECT split, coalesce(id, 0) AS id,
    row_number() OVER (PARTITION BY split ORDER BY split_hash, doc_id, pos) - 1 AS place
  FROM all_words LEFT JOIN vocab USING (token)
),
blocks AS (
  SELECT split, place // {SEQ_LENGTH} AS block_id, string_agg(id, ' ' ORDER BY place) AS input_ids
  FROM ids GROUP BY split, place // {SEQ_LENGTH}
)
SELECT split, block_id, block_id // {BATCH} AS batch_id, input_ids FROM blocks"""


@query(SFT_SQL, "sft_prepare")
def prepared_for_tuning(spark, sf_dir):
    blocks = sft_prepare(
        views.doc_response(spark, sf_dir),
        ["doc_id"],
        size_valid_set=VALID,
        seed=SEED,
        seq_length=SEQ_LENGTH,
        batch_size=BATCH,
        vocab_size=WORDS,
    )
    return blocks.select("split", "block_id", "batch_id", shown("input_ids"))


CHAT_SQL = f"""
WITH {sql.CHAT},
texts AS (
  SELECT conv_id, turn, string_agg({sql.template_message('role', 'text')}, '' ORDER BY message_turn) AS text
  FROM chat GROUP BY conv_id, turn
),
{sql.split('marked', 'texts', ['conv_id', 'turn'], VALID, SEED)},
{CHAT_VOCAB}, {sql.words('all_words', 'marked', 'conv_id, turn, split, split_hash')},
ids AS (
  SELECT split, split_hash, conv_id, turn, pos, coalesce(id, 0) AS id FROM all_words LEFT JOIN vocab USING (token)
  UNION ALL SELECT split, split_hash, conv_id, turn, 1000000000, {EOS} FROM marked
),
placed AS (
  SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY split_hash, conv_id, turn, pos) - 1 AS place FROM ids
),
blocks AS (
  SELECT split, place // {SEQ_LENGTH} AS block_id, string_agg(id, ' ' ORDER BY place) AS input_ids
  FROM placed GROUP BY split, place // {SEQ_LENGTH}
),
counted AS (SELECT *, count(*) OVER (PARTITION BY split) AS n FROM blocks)
SELECT split, block_id, block_id // {BATCH} AS batch_id, input_ids
FROM counted WHERE block_id // {BATCH} < n // {BATCH}"""


@query(CHAT_SQL, "sft_prepare_chat")
def prepared_chats(spark, sf_dir):
    blocks = sft_prepare(
        materialize(views.chat(spark, sf_dir), "chat"),
        KEY,
        size_valid_set=VALID,
        seed=SEED,
        seq_length=SEQ_LENGTH,
        batch_size=BATCH,
        vocab=chat_vocab(spark, sf_dir),
        eos_id=EOS,
        template=TEMPLATE,
        drop_last=True,
    )
    return blocks.select("split", "block_id", "batch_id", shown("input_ids"))


RM_SQL = f"""
WITH {PAIR_IDS}, {sql.split('marked', 'pair_ids', ['conv_id', 'turn'], VALID, SEED)},
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1) // {BATCH} AS batch_id FROM marked
),
measured AS (
  SELECT *, max(len(ids_j)) OVER (PARTITION BY split, batch_id) AS longest_j,
    max(len(ids_k)) OVER (PARTITION BY split, batch_id) AS longest_k FROM batched
)
{collate_sql('measured', EOS)}"""


@query(RM_SQL, "rm_prepare")
def prepared_for_rewards(spark, sf_dir):
    pairs = materialize(views.pairs(spark, sf_dir), "pairs")  # joined once, read by every pass
    marked = exact_split(pairs, VALID, SEED, KEY)
    train, evaluation = (marked.where(F.col("split") == part).drop("split", "split_hash") for part in ("train", "test"))
    parts = rm_prepare(
        train, evaluation, KEY, chat_vocab(spark, sf_dir), EOS, batch_size=BATCH
    )
    both = parts[0].union(parts[1])
    names = [name for name in both.columns if name.startswith(("input_ids", "attention_mask"))]
    return both.select(*KEY, "batch_id", *[shown(name) for name in names], "return_loss")


EVALUATE_SQL = f"""
WITH RECURSIVE {PAIR_IDS}, {sql.split('marked', 'pair_ids', ['conv_id', 'turn'], VALID, SEED)},
numbered AS (SELECT row_number() OVER () AS pair, split, ids_j, ids_k FROM marked),
terms AS (
  SELECT pair, split, unnest(ids_j) AS i, 1 / sqrt(len(ids_j)) AS x FROM numbered
  UNION ALL SELECT pair, split, unnest(ids_k), -1 / sqrt(len(ids_k)) FROM numbered
),
differences AS (SELECT pair, split, i, sum(x) AS x FROM terms GROUP BY pair, split, i),
features AS MATERIALIZED (SELECT pair, i, x FROM differences WHERE split = 'train'),
{sql.fit('fitted', 'features', REG_PARAM, FIT_STEPS)},
margins AS (
  SELECT coalesce(sum(x * w), 0) AS rewards_j, 0.0::DOUBLE AS rewards_k
  FROM differences LEFT JOIN fitted USING (i) WHERE split = 'test' GROUP BY pair
)
SELECT avg(CASE WHEN rewards_j > rewards_k THEN 1.0 ELSE 0.0 END) AS accuracy, round(avg({LOSS_SQL}), 3) AS loss FROM margins"""


@query(EVALUATE_SQL, "rm_evaluate")
def measured_preferences(spark, sf_dir):
    """From pairs of texts to accuracy and loss on held-out pairs, on all words of the vocabulary."""
    marked = exact_split(materialize(views.pairs(spark, sf_dir), "pairs"), VALID, SEED, KEY)
    train, evaluation = (marked.where(F.col("split") == part).drop("split", "split_hash") for part in ("train", "test"))
    found, _ = rm_evaluate(train, evaluation, chat_vocab(spark, sf_dir), REG_PARAM)
    return found.select("accuracy", F.round("loss", 3).alias("loss"))


@query(
    f"""
WITH {CHAT_VOCAB},
prompts AS (
  SELECT conv_id, turn, {sql.template_message('role', 'text')} || '<|assistant|>' || chr(10) AS prompt
  FROM conversations WHERE role = 'user'
), {sql.words('prompt_words', 'prompts', 'conv_id, turn', 'prompt')}
SELECT conv_id, turn, string_agg(coalesce(id, 0), ' ' ORDER BY pos) AS input_ids
FROM prompt_words LEFT JOIN vocab USING (token) GROUP BY conv_id, turn""",
    "ppo_prepare",
)
def prepared_for_policy(spark, sf_dir):
    ids = ppo_prepare(
        views.prompts(spark, sf_dir),
        KEY,
        chat_vocab(spark, sf_dir),
        template=TEMPLATE,
        keep=KEY,
    )
    return ids.select(*KEY, shown("input_ids"))
