"""Policy prompts end to end: cap, pick the column, format, encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tuneprep.functions.messages import ChatTemplate
from tuneprep.operators.encoding import Vocabulary, encode_prompts
from tuneprep.operators.ordering import first_n


def ppo_prepare(
    df: DataFrame,
    key: Sequence[str],
    vocab: DataFrame | Vocabulary,
    max_train_samples: int | None = None,
    max_prompt_length: int | None = None,
    template: ChatTemplate | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Encoded prompts: ``input_ids``, after any ``keep`` columns."""
    ready = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)
    return encode_prompts(first_n(df, max_train_samples, list(key)), ready, max_prompt_length, template, keep)
