"""Fine-tuning data end to end: cap, split, format, encode, pack, batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.messages import ChatTemplate
from tuneprep.operators.batching import assign_batches, pack_wrapped
from tuneprep.operators.columns import TEXT_FIELD, chat_texts, format_text, needs_text_formatting
from tuneprep.operators.encoding import UNKNOWN_ID, Vocabulary, build_vocab
from tuneprep.operators.ordering import first_n
from tuneprep.operators.splits import SPLIT, SPLIT_HASH, exact_split


def sft_prepare(
    df: DataFrame,
    key: Sequence[str],
    size_valid_set: int = 4000,
    max_train_samples: int | None = None,
    seed: int = 0,
    seq_length: int = 1024,
    batch_size: int = 4,
    accumulation: int = 1,
    vocab: DataFrame | Vocabulary | None = None,
    vocab_size: int = 32000,
    eos_id: int | None = None,
    template: ChatTemplate | None = None,
    text_field: str = TEXT_FIELD,
    drop_last: bool = False,
) -> DataFrame:
    """Blocks of both parts as (split, block_id, batch_id, input_ids).

    All rows are used unless ``max_train_samples`` cuts them in ``key`` order. They are
    split exactly and packed part by part in the split's shuffled order; ``drop_last``
    drops a last incomplete batch. Without ``vocab`` a vocabulary is built from the
    training part.
    """
    key = list(key)
    marked = exact_split(first_n(df, max_train_samples, key), size_valid_set, seed, key)
    carried = [SPLIT, SPLIT_HASH, *key]
    if needs_text_formatting(df, text_field):
        texts = format_text(marked, carried, text_field)
    elif "messages" in df.columns:
        if template is None:
            raise ValueError("Chat messages need a template.")
        texts = chat_texts(marked, template, carried, text_field)
    else:
        texts = marked.select(*carried, text_field)

    if vocab is None:
        vocab = build_vocab(texts.where(F.col(SPLIT) == "train"), vocab_size, text_field, UNKNOWN_ID + 1)
    ready = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)
    encoded = ready.encode(texts, {text_field: "input_ids"})
    blocks = pack_wrapped(encoded, seq_length, [SPLIT_HASH, *key], group_by=[SPLIT], eos_id=eos_id, blocks="blocks")
    return assign_batches(
        blocks, batch_size, position="block_id", rows="blocks", accumulation=accumulation, drop_last=drop_last
    ).select(SPLIT, "block_id", "batch_id", "input_ids")
