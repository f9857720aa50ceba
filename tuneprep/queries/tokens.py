"""Vocabulary, ids, packing, batches and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneprep.operators.batching import assign_batches, collate_pairs, pack_wrapped
from tuneprep.operators.encoding import (
    Vocabulary,
    attention_mask,
    build_vocab,
    encode,
    encode_pairs,
    encode_prompts,
    encode_with,
    pad_or_eos,
)
from tuneprep.operators.mapping import map_batches
from tuneprep.queries import sql
from tuneprep.queries.registry import query
from tuneprep.sources import views

KEY = list(views.TURN_KEY)
WORDS, EOS, FIRST_ID = 2000, 1, 2
MAX_LENGTH = 512  # of encode_truncated alone; all other queries take whole texts
BLOCK, BATCH = 128, 8
MULTIPLE, PAD_LENGTH = 8, 64  # of the padding options

DOC_WORDS = sql.words("doc_words", "documents", "doc_id, lang")
DOC_VOCAB = f"{DOC_WORDS}, {sql.vocab('doc_words', WORDS, FIRST_ID)}"
CHAT_VOCAB = f"{sql.words('chat_words', 'conversations', 'conv_id, turn')}, {sql.vocab('chat_words', WORDS, FIRST_ID)}"


def documents_text(spark, sf_dir, *columns):
    return views.table(spark, sf_dir, "documents").select("doc_id", *columns, "text")


def doc_vocab(spark, sf_dir):
    return build_vocab(documents_text(spark, sf_dir), WORDS, first_id=FIRST_ID)


def chat_vocab(spark, sf_dir):
    return build_vocab(views.table(spark, sf_dir, "conversations"), WORDS, first_id=FIRST_ID)


def shown(name: str):
    """An id array as text, to be compared with SQL."""
    return F.array_join(name, " ").alias(name)


@query(f"WITH {DOC_VOCAB} SELECT token, id, n FROM vocab", "build_vocab")
def document_words(spark, sf_dir):
    return doc_vocab(spark, sf_dir)


def _encode_sql(condition: str = "") -> str:
    return f"""
WITH {DOC_VOCAB},
ids AS (
  SELECT doc_id, count(*) AS n_ids, string_agg(coalesce(id, 0), ' ' ORDER BY pos) AS input_ids
  FROM doc_words LEFT JOIN vocab USING (token) {condition} GROUP BY doc_id
)
SELECT doc_id, coalesce(n_ids, 0) AS n_ids, coalesce(input_ids, '') AS input_ids
FROM documents LEFT JOIN ids USING (doc_id)"""


ENCODE_SQL = _encode_sql()


def _encoded(documents, vocab, max_length=None):
    ids = encode(documents, vocab, max_length=max_length)
    return ids.select("doc_id", F.size("input_ids").cast("bigint").alias("n_ids"), shown("input_ids"))


@query(ENCODE_SQL, "encode")
def encoded_documents(spark, sf_dir):
    documents = documents_text(spark, sf_dir)
    return _encoded(documents, doc_vocab(spark, sf_dir))


@query(_encode_sql(f"WHERE pos <= {MAX_LENGTH}"), "encode_truncated")
def truncated_documents(spark, sf_dir):
    return _encoded(documents_text(spark, sf_dir), doc_vocab(spark, sf_dir), MAX_LENGTH)


@query(
    f"""
WITH {DOC_VOCAB}, ids AS (
  SELECT doc_id, string_agg(pos * 31 + length(token), ' ' ORDER BY pos) AS input_ids FROM doc_words GROUP BY doc_id
)
SELECT doc_id, coalesce(input_ids, '') AS input_ids FROM documents LEFT JOIN ids USING (doc_id)""",
    "encode_with",
)
def encoded_by_caller(spark, sf_dir):
    """A caller's own tokenizer, here one that needs no vocabulary."""

    def tokenize(texts):
        return [[i * 31 + len(word) for i, word in enumerate(text.split(), 1)] for text in texts]

    return encode_with(documents_text(spark, sf_dir), tokenize).select("doc_id", shown("input_ids"))


@query(ENCODE_SQL, "encode_large_vocab")
def encoded_with_joined_rest(spark, sf_dir):
    """The way for vocabularies beyond the broadcast bound."""
    documents = documents_text(spark, sf_dir)
    return _encoded(documents, Vocabulary(doc_vocab(spark, sf_dir), broadcast_words=100))


@query(
    f"WITH {DOC_WORDS}, counted AS (SELECT doc_id, count(*) AS n FROM doc_words GROUP BY doc_id) "
    "SELECT doc_id, coalesce(n, 0) AS ones, coalesce(n, 0) AS length FROM documents LEFT JOIN counted USING (doc_id)",
    "attention_mask",
)
def document_masks(spark, sf_dir):
    documents = documents_text(spark, sf_dir)
    ids = encode(documents, doc_vocab(spark, sf_dir))
    mask = ids.select("doc_id", attention_mask(F.col("input_ids")).alias("mask"))
    return mask.select(
        "doc_id",
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, one: n + one).alias("ones"),
        F.size("mask").cast("bigint").alias("length"),
    )


PAIR_IDS = f"""
{CHAT_VOCAB}, {sql.QA},
sides AS (
  SELECT conv_id, turn, 'j' AS side, {sql.qa_text('question', 'response_j')} AS text FROM qa
  UNION ALL
  SELECT conv_id, turn, 'k', {sql.qa_text('question', 'response_k')} FROM qa
), {sql.words('side_words', 'sides', 'conv_id, turn, side')},
side_ids AS (
  SELECT conv_id, turn, side, list(coalesce(id, 0) ORDER BY pos) AS ids
  FROM side_words LEFT JOIN vocab USING (token) GROUP BY conv_id, turn, side
),
pair_ids AS (
  SELECT conv_id, turn, max(ids) FILTER (WHERE side = 'j') AS ids_j, max(ids) FILTER (WHERE side = 'k') AS ids_k
  FROM side_ids GROUP BY conv_id, turn
)"""


def _joined(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


PAIRS_SQL = (
    f"WITH {PAIR_IDS} SELECT conv_id, turn, {_joined('ids_j')} AS input_ids_j, {_joined('ids_k')} AS input_ids_k, "
    f"{_joined('list_transform(ids_j, lambda x: 1)')} AS attention_mask_j, "
    f"{_joined('list_transform(ids_k, lambda x: 1)')} AS attention_mask_k FROM pair_ids"
)


def _encoded_pairs(spark, sf_dir, vocab):
    ids = encode_pairs(views.pairs(spark, sf_dir), vocab, keep=KEY)
    return ids.select(*KEY, *[shown(name) for name in ids.columns if name not in KEY])


@query(PAIRS_SQL, "encode_pairs")
def encoded_pairs(spark, sf_dir):
    return _encoded_pairs(spark, sf_dir, chat_vocab(spark, sf_dir))


@query(PAIRS_SQL, "encode_pairs_large_vocab")
def encoded_pairs_with_joined_rest(spark, sf_dir):
    return _encoded_pairs(spark, sf_dir, Vocabulary(chat_vocab(spark, sf_dir), broadcast_words=100))


@query(
    f"""
WITH {CHAT_VOCAB},
prompts AS (
  SELECT conv_id, turn, {sql.qa_text('text', "''")} AS prompt FROM conversations WHERE role = 'user'
), {sql.words('prompt_words', 'prompts', 'conv_id, turn', 'prompt')}
SELECT string_agg(coalesce(id, 0), ' ' ORDER BY pos) AS input_ids
FROM prompt_words LEFT JOIN vocab USING (token) GROUP BY conv_id, turn""",
    "encode_prompts",
)
def encoded_prompts(spark, sf_dir):
    ids = encode_prompts(views.prompts(spark, sf_dir), chat_vocab(spark, sf_dir))
    return ids.select(shown("input_ids"))


def _pack_sql(group: str, keep_tail: bool) -> str:
    """Words and one end mark per document, numbered and cut."""
    columns = "lang, " if group else ""
    partition = "PARTITION BY lang " if group else ""
    return f"""
WITH {DOC_VOCAB},
marked AS (
  SELECT lang, doc_id, pos, coalesce(id, 0) AS id FROM doc_words LEFT JOIN vocab USING (token)
  UNION ALL SELECT lang, doc_id, 1000000000, {EOS} FROM documents
),
placed AS (SELECT *, row_number() OVER ({partition}ORDER BY doc_id, pos) - 1 AS place FROM marked)
SELECT {columns}place // {BLOCK} AS block_id, count(*) AS n_ids, string_agg(id, ' ' ORDER BY place) AS input_ids
FROM placed GROUP BY {columns}place // {BLOCK}{'' if keep_tail else f' HAVING count(*) = {BLOCK}'}"""


def _packed(spark, sf_dir, groups, drop_tail):
    documents = documents_text(spark, sf_dir, "lang")
    ids = encode(documents, doc_vocab(spark, sf_dir))
    blocks = pack_wrapped(ids, BLOCK, ["doc_id"], group_by=groups, eos_id=EOS, drop_tail=drop_tail)
    return blocks.select(
        *groups, "block_id", F.size("input_ids").cast("bigint").alias("n_ids"), shown("input_ids")
    )


@query(_pack_sql("", True), "pack_wrapped")
def packed_documents(spark, sf_dir):
    return _packed(spark, sf_dir, [], False)


@query(_pack_sql("lang", False), "pack_wrapped_by_group")
def packed_by_language(spark, sf_dir):
    return _packed(spark, sf_dir, ["lang"], True)


@query(
    f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM documents",
    "assign_batches",
)
def batched_documents(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id")
    return assign_batches(documents, BATCH, ["doc_id"])


@query(
    f"""
WITH placed AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS rows FROM documents
)
SELECT doc_id, lang, place // {BATCH} AS batch_id FROM placed WHERE place // {BATCH} < rows // {BATCH}""",
)
def assign_batches_drop_last(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return assign_batches(documents, BATCH // 2, ["doc_id"], group_by=["lang"], accumulation=2, drop_last=True)


def collate_sql(pairs: str, pad: int, left: bool = False) -> str:
    """Pad a table (keys, batch columns, ids_j, ids_k, longest_j, longest_k)."""

    def padded(ids: str, longest: str, value: int) -> str:
        fill = f"list_transform(range({longest} - len({ids})), lambda x: {value})"
        return _joined(f"list_concat({fill}, {ids})" if left else f"list_concat({ids}, {fill})")

    columns = []
    for side in ("j", "k"):
        ids, longest = f"ids_{side}", f"longest_{side}"
        columns.append(f"{padded(ids, longest, pad)} AS input_ids_{side}")
        columns.append(f"{padded(f'list_transform({ids}, lambda x: 1)', longest, 0)} AS attention_mask_{side}")
    return f"SELECT conv_id, turn, batch_id, {', '.join(columns)}, true AS return_loss FROM {pairs}"


def _collate_sql(longest_j: str, longest_k: str, left: bool = False) -> str:
    return f"""
WITH {PAIR_IDS},
batched AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH} AS batch_id FROM pair_ids),
longest AS (
  SELECT *, max(len(ids_j)) OVER (PARTITION BY batch_id) AS most_j,
    max(len(ids_k)) OVER (PARTITION BY batch_id) AS most_k FROM batched
),
measured AS (SELECT *, {longest_j} AS longest_j, {longest_k} AS longest_k FROM longest)
{collate_sql('measured', EOS, left)}"""


def _collated(spark, sf_dir, **options):
    batched = assign_batches(views.pairs(spark, sf_dir), BATCH, KEY)
    ids = encode_pairs(batched, chat_vocab(spark, sf_dir), keep=[*KEY, "batch_id"])
    padded = collate_pairs(ids, pad_or_eos(None, EOS), **options)
    names = [name for name in padded.columns if name.startswith(("input_ids", "attention_mask"))]
    return padded.select(*KEY, "batch_id", *[shown(name) for name in names], "return_loss")


@query(_collate_sql("most_j", "most_k"), "collate_pairs")
def collated_pairs(spark, sf_dir):
    return _collated(spark, sf_dir)


@query(_collate_sql(*[f"(most_{side} + {MULTIPLE - 1}) // {MULTIPLE} * {MULTIPLE}" for side in "jk"], left=True))
def collate_pairs_left(spark, sf_dir):
    """Filled up on the left, to a multiple of eight."""
    return _collated(spark, sf_dir, padding="longest", pad_to_multiple_of=MULTIPLE, padding_side="left")


@query(_collate_sql(f"{PAD_LENGTH}", f"{PAD_LENGTH}"))
def collate_pairs_max_length(spark, sf_dir):
    """Filled up to a fixed length; longer rows stay whole."""
    return _collated(spark, sf_dir, padding="max_length", max_length=PAD_LENGTH)


@query(_collate_sql("0", "0"))
def collate_pairs_unpadded(spark, sf_dir):
    return _collated(spark, sf_dir, padding=False)


@query("SELECT doc_id, length(text) AS length FROM documents", "map_batches")
def mapped_documents(spark, sf_dir):
    documents = documents_text(spark, sf_dir)

    def lengths(batch):
        return batch.assign(length=batch["text"].str.len())[["doc_id", "length"]]

    return map_batches(documents, lengths, "doc_id bigint, length bigint", num_proc=4)
