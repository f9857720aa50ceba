"""Preference pairs end to end: cap, pick columns, format, encode, batch, pad."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tuneprep.functions.messages import ChatTemplate
from tuneprep.operators.batching import assign_batches, collate_pairs
from tuneprep.operators.encoding import Vocabulary, encode_pairs
from tuneprep.operators.ordering import first_n
from tuneprep.operators.preference import PreferenceModel, evaluate_terms, fit_terms


def rm_prepare(
    train: DataFrame,
    evaluation: DataFrame,
    key: Sequence[str],
    vocab: DataFrame | Vocabulary,
    pad_id: int,
    train_subset: int | None = None,
    eval_subset: int | None = None,
    max_length: int | None = None,
    batch_size: int = 4,
    accumulation: int = 1,
    template: ChatTemplate | None = None,
    pad_to_multiple_of: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Padded batches of both parts, rows as (key, batch_id, ids and masks, return_loss)."""
    key = list(key)
    ready = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)

    def part(df: DataFrame, rows: int | None, steps: int) -> DataFrame:
        # Numbering touches key columns only, so it comes before the ids exist.
        batched = assign_batches(first_n(df, rows, key), batch_size, key, accumulation=steps)
        encoded = encode_pairs(batched, ready, max_length, template, keep=[*key, "batch_id"])
        return collate_pairs(encoded, pad_id, pad_to_multiple_of=pad_to_multiple_of)

    return part(train, train_subset, accumulation), part(evaluation, eval_subset, 1)


def rm_evaluate(
    train: DataFrame,
    evaluation: DataFrame,
    vocab: DataFrame | Vocabulary,
    reg_param: float = 0.01,
    max_length: int | None = None,
    template: ChatTemplate | None = None,
    max_iter: int = 200,
    tol: float = 1e-5,
) -> tuple[DataFrame, PreferenceModel]:
    """Preference pairs from text to metric: (accuracy, loss) on ``evaluation``, and the model.

    Both sides are encoded; the counts of all the vocabulary's ids, by the root of the text's
    length, are its features. The model is fitted on ``train``.
    """
    ready = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)
    model = fit_terms(encode_pairs(train, ready, max_length, template), ready.ids, reg_param=reg_param, max_iter=max_iter, tol=tol)
    return evaluate_terms(encode_pairs(evaluation, ready, max_length, template), model), model
