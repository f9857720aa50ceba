"""Choosing input columns by schema, once, while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.messages import (
    ChatTemplate,
    is_messages,
    last_assistant,
    render_chat,
    to_messages,
)
from tuneprep.functions.text import none_str, prompt_text, qa_text
from tuneprep.functions.variants import (
    is_variant,
    variant_exchange,
    variant_is_text,
    variant_messages,
    variant_reply,
    variant_text,
)

TEXT_FIELD = "text"
# Columns a chat dataset keeps next to its messages.
CHAT_EXTRAS = ("tools", "chat_template_kwargs")

SFT_SCHEMA_ERROR = (
    "Unsupported columns for fine-tuning text: expected messages, or one of the pairs "
    "question + response_j, prompt + response, prompt + chosen (text)."
)
PAIR_SCHEMA_ERROR = (
    "Unsupported columns for preference pairs: expected question + response_j + response_k, "
    "or prompt + chosen + rejected."
)
PROMPT_SCHEMA_ERROR = "Unsupported columns for prompts: expected prompt or question."


def _has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def _text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    return variant_text(F.col(name)) if is_variant(dtype) else none_str(F.col(name), dtype)


def sft_pair(df: DataFrame) -> tuple[Column, Column]:
    """(question, answer) columns of a prompt/response table.

    ``question + response_j`` wins, then ``prompt + chosen`` where ``chosen`` is text,
    then ``prompt + response``. Only the test "is ``chosen`` text" is made per row: a
    NULL there, or a VARIANT that holds no text, falls through to ``response``, or fails the job if there is none.
    """
    if _has(df, "question", "response_j"):
        return _text(df, "question"), _text(df, "response_j")
    chosen_type = df.schema["chosen"].dataType if _has(df, "prompt", "chosen") else None
    has_response = _has(df, "prompt", "response")
    if isinstance(chosen_type, T.StringType) or is_variant(chosen_type):
        otherwise = _text(df, "response") if has_response else F.raise_error(F.lit(SFT_SCHEMA_ERROR)).cast("string")
        chosen = F.col("chosen")
        is_text = variant_is_text(chosen) if is_variant(chosen_type) else chosen.isNotNull()
        return _text(df, "prompt"), F.when(is_text, _text(df, "chosen")).otherwise(otherwise)
    if has_response:
        return _text(df, "prompt"), _text(df, "response")
    raise KeyError(SFT_SCHEMA_ERROR)


def rm_triple(df: DataFrame) -> tuple[str, str, str]:
    """Names of the (prompt, chosen, rejected) columns."""
    for triple in (
        ("question", "response_j", "response_k"),
        ("prompt", "chosen", "rejected"),
        ("prompt", "response_j", "response_k"),
    ):
        if _has(df, *triple):
            return triple
    raise KeyError(PAIR_SCHEMA_ERROR)


def ppo_prompt(df: DataFrame) -> Column:
    """The prompt text column: ``prompt``, else ``question``."""
    for name in ("prompt", "question"):
        if _has(df, name):
            return _text(df, name)
    raise KeyError(PROMPT_SCHEMA_ERROR)


def prune_chat_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep only what chat training reads and ``keep``, if ``messages`` comes with a bare ``prompt``."""
    if _has(df, "messages", "prompt") and not _has(df, "completion"):
        read = ["messages", *[name for name in CHAT_EXTRAS if name in df.columns]]
        return df.select(*dict.fromkeys([*keep, *read]))
    return df


def needs_text_formatting(train: DataFrame, text_field: str = TEXT_FIELD) -> bool:
    """Whether a text column must be made; decided on the training columns for both parts."""
    columns = prune_chat_columns(train).columns
    return "messages" not in columns and text_field not in columns


def format_text(df: DataFrame, keep: Sequence[str] = (), text_field: str = TEXT_FIELD) -> DataFrame:
    """Prompt/response rows to one text column; ``keep`` names key columns to carry along."""
    question, answer = sft_pair(df)
    return df.select(*keep, qa_text(question, answer).alias(text_field))


def prepare_text(
    train: DataFrame, evaluation: DataFrame, keep: Sequence[str] = (), text_field: str = TEXT_FIELD
) -> tuple[DataFrame, DataFrame]:
    """Format both parts to text, or prune both, as the training columns demand."""
    if needs_text_formatting(train, text_field):
        return tuple(format_text(part, keep, text_field) for part in (train, evaluation))
    return prune_chat_columns(train, keep), prune_chat_columns(evaluation, keep)


def chat_texts(
    df: DataFrame, template: ChatTemplate, keep: Sequence[str] = (), text_field: str = TEXT_FIELD
) -> DataFrame:
    """``messages`` rows to one text column through a template."""
    dtype = df.schema["messages"].dataType
    if is_variant(dtype):
        text = render_chat(variant_messages(F.col("messages")), template)
    else:
        text = render_chat(F.col("messages"), template, dtype)
    return df.select(*keep, text.alias(text_field))


def pair_texts(df: DataFrame, template: ChatTemplate | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Preference rows to ``text_j`` (preferred) and ``text_k``.

    With a template both message lists are rendered whole. Without one each side is
    the plain question/answer text of the prompt and the side's (last assistant) reply. A
    VARIANT side may be text in one row and a message list in the next.
    """
    prompt_name, chosen, rejected = rm_triple(df)
    prompt = _text(df, prompt_name)

    def side(name: str) -> Column:
        dtype = df.schema[name].dataType
        if is_variant(dtype):
            value = F.col(name)
            if template is not None:
                return render_chat(variant_exchange(prompt, value), template)
            return qa_text(prompt, variant_reply(value))
        messages = to_messages(prompt, F.col(name), dtype)
        if template is not None:
            return render_chat(messages, template)
        return qa_text(prompt, last_assistant(messages) if is_messages(dtype) else none_str(F.col(name), dtype))

    return df.select(*keep, side(chosen).alias("text_j"), side(rejected).alias("text_k"))


def prompt_texts(
    df: DataFrame, template: ChatTemplate | None = None, keep: Sequence[str] = (), text_field: str = TEXT_FIELD
) -> DataFrame:
    """Prompt rows to the text a policy continues."""
    prompt = ppo_prompt(df)
    if template is None:
        text = prompt_text(prompt)
    else:
        message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
        text = render_chat(message, template, add_generation_prompt=True)
    return df.select(*keep, text.alias(text_field))
