"""Choosing columns and rendering text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneprep.functions import (
    ChatTemplate,
    csv_list,
    last_assistant,
    none_str,
    py_capitalize,
    py_strip,
    role_transcript,
    to_messages,
)
from tuneprep.operators.columns import (
    chat_texts,
    format_text,
    pair_texts,
    prepare_text,
    prompt_texts,
    prune_chat_columns,
)
from tuneprep.functions.variants import variant_is_messages, variant_messages
from tuneprep.queries import sql
from tuneprep.queries.registry import query
from tuneprep.sources import read_split, views, write_prepared
from tuneprep.storage import scratch_path

KEY = views.TURN_KEY
TEMPLATE = ChatTemplate()

SFT_SQL = (
    f"WITH {sql.QA}, texts AS (SELECT conv_id, turn, {sql.qa_text('question', 'response_j')} AS text FROM qa) "
    "SELECT conv_id, turn, text, length(text) AS n_chars FROM texts"
)
PAIR_SQL = (
    f"WITH {sql.QA} SELECT conv_id, turn, {sql.qa_text('question', 'response_j')} AS text_j, "
    f"{sql.qa_text('question', 'response_k')} AS text_k FROM qa"
)


@query(SFT_SQL)
def sft_text_question(spark, sf_dir):
    return format_text(views.qa(spark, sf_dir), KEY).withColumn("n_chars", F.length("text").cast("bigint"))


@query(SFT_SQL)
def sft_text_chosen(spark, sf_dir):
    return format_text(views.pairs(spark, sf_dir), KEY).withColumn("n_chars", F.length("text").cast("bigint"))


@query(f"SELECT doc_id, {sql.qa_text("lang || '/' || source", 'text')} AS text FROM documents")
def sft_text_response(spark, sf_dir):
    return format_text(views.doc_response(spark, sf_dir), ["doc_id"])


@query(
    "SELECT d.doc_id, "
    + sql.qa_text("lang || '/' || source", "CASE WHEN quality = 1 THEN 'good' ELSE text END")
    + " AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def sft_text_chosen_or_response(spark, sf_dir):
    """Rows without a chosen text fall through to their response."""
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("chosen"))
    return format_text(views.doc_response(spark, sf_dir).join(labels, "doc_id", "left"), ["doc_id"])


@query(
    "SELECT doc_id, 'train' AS part, " + sql.qa_text("lang || '/' || source", "text") + " AS text FROM documents "
    "UNION ALL SELECT conv_id, 'eval', "
    + sql.qa_text("question", "answer")
    + f" FROM (WITH {sql.EXCHANGES} SELECT * FROM exchanges)",
    "prepare_text",
)
def both_parts_as_text(spark, sf_dir):
    """The training part lacks a text column, so both parts are formatted."""
    exchanges = views.exchanges(spark, sf_dir).select(
        F.col("conv_id").alias("doc_id"), F.col("question").alias("prompt"), F.col("answer").alias("response")
    )
    train, evaluation = prepare_text(views.doc_response(spark, sf_dir), exchanges, ["doc_id"])
    return train.withColumn("part", F.lit("train")).union(evaluation.withColumn("part", F.lit("eval")))


@query(
    f"WITH {sql.CHAT} SELECT conv_id, turn, string_agg(role || ':' || text, '|' ORDER BY message_turn) AS messages, "
    "'search' AS tools, 'conv_id,turn,messages,tools' AS kept FROM chat GROUP BY conv_id, turn",
    "prune_chat_columns",
)
def pruned_chat(spark, sf_dir):
    pruned = prune_chat_columns(views.chat(spark, sf_dir).withColumn("tools", F.lit("search")), KEY)
    messages = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return pruned.select(
        *KEY, F.array_join(messages, "|").alias("messages"), "tools", F.lit(",".join(pruned.columns)).alias("kept")
    )


@query(PAIR_SQL)
def rm_pair_text_strings(spark, sf_dir):
    return pair_texts(views.pairs(spark, sf_dir), keep=KEY)


@query(PAIR_SQL)
def rm_pair_text_question(spark, sf_dir):
    return pair_texts(views.qa(spark, sf_dir), keep=KEY)


@query(PAIR_SQL)
def rm_pair_text_jk(spark, sf_dir):
    return pair_texts(views.pairs_jk(spark, sf_dir), keep=KEY)


@query(PAIR_SQL)
def rm_pair_text_messages(spark, sf_dir):
    return pair_texts(views.pairs_chat(spark, sf_dir), keep=KEY)


@query(
    f"WITH {sql.QA} SELECT conv_id, turn, "
    f"{sql.template_message("'user'", 'question')} || {sql.template_message("'assistant'", 'response_j')} AS text_j, "
    f"{sql.template_message("'user'", 'question')} || {sql.template_message("'assistant'", 'response_k')} AS text_k "
    "FROM qa"
)
def rm_pair_text_template(spark, sf_dir):
    return pair_texts(views.pairs_chat(spark, sf_dir), TEMPLATE, KEY)


@query(
    "SELECT doc_id, 'user,assistant' AS roles, lang || '/' || source AS question, text AS answer FROM documents",
    "to_messages",
)
def text_to_messages(spark, sf_dir):
    documents = views.doc_response(spark, sf_dir)
    messages = to_messages(F.col("prompt"), F.col("response"), documents.schema["response"].dataType)
    return documents.select("doc_id", messages.alias("m")).select(
        "doc_id",
        F.array_join("m.role", ",").alias("roles"),
        F.col("m")[0]["content"].alias("question"),
        F.col("m")[1]["content"].alias("answer"),
    )


@query(
    f"WITH {sql.CHAT} SELECT conv_id, turn, "
    "coalesce(max_by(text, message_turn) FILTER (WHERE role = 'assistant'), max_by(text, message_turn)) AS answer "
    "FROM chat GROUP BY conv_id, turn",
    "last_assistant",
)
def last_replies(spark, sf_dir):
    return views.chat(spark, sf_dir).select(*KEY, last_assistant(F.col("messages")).alias("answer"))


@query(
    f"WITH {sql.CHAT} SELECT conv_id, turn, "
    + sql.strip(
        "string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, chr(10) ORDER BY message_turn)"
        " || chr(10) || 'Assistant:'"
    )
    + " AS text FROM chat GROUP BY conv_id, turn",
    "role_transcript",
)
def transcripts(spark, sf_dir):
    text = role_transcript(F.col("messages"), add_generation_prompt=True)
    return views.chat(spark, sf_dir).select(*KEY, text.alias("text"))


@query(
    f"WITH {sql.CHAT} SELECT conv_id, turn, "
    f"string_agg({sql.template_message('role', 'text')}, '' ORDER BY message_turn) AS text "
    "FROM chat GROUP BY conv_id, turn",
    "chat_template",
)
def templated_chats(spark, sf_dir):
    return chat_texts(views.chat(spark, sf_dir), TEMPLATE, KEY)


@query(f"SELECT conv_id, turn, {sql.qa_text('text', "''")} AS text FROM conversations WHERE role = 'user'")
def ppo_prompt_text(spark, sf_dir):
    return prompt_texts(views.prompts(spark, sf_dir), keep=KEY)


@query(
    f"SELECT conv_id, turn, {sql.template_message('role', 'text')} || '<|assistant|>' || chr(10) AS text "
    "FROM conversations WHERE role = 'user'"
)
def ppo_prompt_template(spark, sf_dir):
    return prompt_texts(views.prompts(spark, sf_dir), TEMPLATE, KEY)


@query(
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), "
    f"lambda x: {sql.strip('x')}), lambda x: x <> ''), '|') AS items FROM documents",
    "csv_list",
)
def csv_items(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", F.array_join(csv_list(F.col("text")), "|").alias("items"))


@query(
    "SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind, p_name AS name, "
    "coalesce(nullif(p_brand, 'Brand#1'), 'None') AS brand FROM part"
)
def python_text(spark, sf_dir):
    """Capitalizing, Unicode stripping and NULL as text."""
    padded = F.concat(F.lit("\u3000\xa0\t"), F.col("p_name"), F.lit("\u2003\n"))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        py_capitalize(F.col("p_type")).alias("kind"),
        py_strip(padded).alias("name"),
        none_str(F.when(F.col("p_brand") != "Brand#1", F.col("p_brand"))).alias("brand"),
    )


# What the text of each way to put a side is (see views.mixed_pairs): the reply, and the rendered list.
MIXED_REPLY = [
    "{a}", "{a}", "{a}", "'stray'", "''", "CAST(length({a}) AS VARCHAR)", "'None'", "''", "'True'", "'[\"a\",\"b\"]'",
]


def _asked(answer: str) -> str:
    return f"{sql.template_message("'user'", 'question')} || {sql.template_message("'assistant'", answer)}"


MIXED_CHAT = [
    _asked("{a}"),
    _asked("{a}"),
    f"{sql.template_message("'assistant'", '{o}')} || {sql.template_message("'assistant'", '{a}')}",
    sql.template_message("'user'", "question"),
    "''",
    *[_asked(MIXED_REPLY[kind]) for kind in (5, 6)],
    f"{sql.template_message("'assistant'", "''")} || {sql.template_message("'user'", 'question')}",
    *[_asked(MIXED_REPLY[kind]) for kind in (8, 9)],
]
MIXED_LINES = [
    "NULL",
    "'User: ' || question || chr(10) || 'Assistant: ' || {a}",
    "'Assistant: ' || {o} || chr(10) || 'Assistant: ' || {a}",
    "'User: ' || question",
    "''",
    "NULL",
    "NULL",
    "'Assistant: ' || chr(10) || 'User: ' || question",
    "NULL",
    "NULL",
]


def mixed_sql(cases: list[str]) -> str:
    sides = [sql.mixed(f"text_{k}", cases, *more) for k, *more in (("j", 0, "response_j", "response_k"), ("k", 3, "response_k", "response_j"))]
    return f"WITH {sql.QA}, sides AS (SELECT conv_id, turn, question, {', '.join(sides)} FROM qa) "


def mixed_rows(spark, sf_dir):
    """The mixed pairs from JSON lines, where a field's type differs from row to row."""
    rows = views.mixed_pairs(spark, sf_dir)
    base = scratch_path(spark, "mixed")
    write_prepared(rows, base, "train_prefs", fmt="json")
    return read_split(spark, base, "train_prefs", fmt="json", schema=rows.schema)


@query(
    mixed_sql(MIXED_REPLY)
    + f"SELECT conv_id, turn, {sql.qa_text('question', 'text_j')} AS text_j, {sql.qa_text('question', 'text_k')} AS text_k FROM sides"
)
def rm_pair_text_rows(spark, sf_dir):
    """Text or message list, decided row by row."""
    return pair_texts(mixed_rows(spark, sf_dir), keep=KEY)


@query(mixed_sql(MIXED_CHAT) + "SELECT conv_id, turn, text_j, text_k FROM sides")
def rm_pair_text_rows_template(spark, sf_dir):
    return pair_texts(mixed_rows(spark, sf_dir), TEMPLATE, KEY)


@query(
    f"WITH {sql.QA} SELECT conv_id, turn, "
    + sql.qa_text("question", "CASE WHEN (conv_id + turn) % 10 = 0 THEN response_j ELSE response_k END")
    + " AS text FROM qa"
)
def sft_text_rows(spark, sf_dir):
    """The chosen reply where it is text, else the response."""
    return format_text(mixed_rows(spark, sf_dir), KEY)


@query(
    mixed_sql(MIXED_LINES)
    + f"SELECT conv_id, turn, {sql.strip('text_j')} AS text FROM sides WHERE text_j IS NOT NULL",
    "role_transcript_rows",
)
def transcripts_with_strays(spark, sf_dir):
    """Elements that are no messages are left out."""
    lists = mixed_rows(spark, sf_dir).where(variant_is_messages(F.col("chosen")))
    return lists.select(*KEY, role_transcript(variant_messages(F.col("chosen"))).alias("text"))
