"""Text quality by logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Words (A-Z folded) and pairs of words fall into 2**20 places; a text's feature is its
count over the root of all its n-grams. Training takes a bounded sample of labelled rows
(``SAMPLE_ROWS``, by a hash of doc_id), dealt to learners of ``LEARNER_ROWS`` rows each;
their weights are averaged. Scoring is a sparse dot product over every whole text.

Defined cases: NULL and empty texts have no n-grams and score the intercept; rows whose label is
NULL are not learned from, and of repeated labels of one doc_id the largest counts; without any
label every score is 0.5. A column called ``score`` or ``predicted`` gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.llm.common import APPEND_BYTES, append_columns, held_out
from tuneprep.llm.words import find_words, hash_words, slices, text_bytes, windows

BITS = 20
SAMPLE_ROWS = 24_000
LEARNER_ROWS = 6_000
EPOCHS, UPDATES = 4, 10_000
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.1, 0.0
THRESHOLD = 0.3


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words and word pairs, row after row, and where each row starts."""
    data, bounds = text_bytes(column)
    starts, ends, first = find_words(data, bounds)
    words = hash_words(data, starts, ends, lower=True, seed=8)
    pairs, at = windows(words, first, 2)
    place = np.empty(len(words) + len(pairs), np.int64)
    # A row's words come first, then its pairs.
    pair_first = np.searchsorted(at, first)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    place[np.arange(len(words)) + pair_first[row]] = (words >> np.uint64(64 - BITS)).astype(np.int64)
    pair_row = np.repeat(np.arange(len(bounds) - 1), np.diff(pair_first))
    place[np.arange(len(pairs)) + first[1:][pair_row]] = (pairs >> np.uint64(64 - BITS)).astype(np.int64)
    return place, first + pair_first


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, "text", APPEND_BYTES):
            place, first = ngrams(cut.column("text"))
            grams = [place[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [cut.column("order"), cut.column("label"), pa.array(grams, pa.binary())], ["order", "label", "grams"]
            )


def ftrl(examples: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Weights after FTRL-proximal passes over (label, places) in order; the last one is the intercept.

    ``EPOCHS`` passes, and more over few examples, so that at least ``UPDATES`` updates are made.
    """
    epochs = max(EPOCHS, -(-UPDATES // max(len(examples), 1)))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    prepared = []
    for label, places in examples:
        index, counts = np.unique(places, return_counts=True)
        value = counts / np.sqrt(max(len(places), 1))
        prepared.append((label, np.append(index, size - 1), np.append(value, 1.0)))

    def weights(index) -> np.ndarray:
        shrunk = np.sign(z[index]) * L1 - z[index]
        active = np.abs(z[index]) > L1
        return np.where(active, shrunk / ((BETA + np.sqrt(n[index])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for label, index, value in prepared:
            w = weights(index)
            error = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label
            gradient = error * value
            squares = n[index] + gradient * gradient
            z[index] += gradient - (np.sqrt(squares) - np.sqrt(n[index])) / ALPHA * w
            n[index] = squares
    return weights(np.arange(size))


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "label", "grams"])
    examples = [(y, np.frombuffer(g, np.int32)) for y, g in zip(rows["label"], rows["grams"], strict=True)]
    return pd.DataFrame({"rows": [len(rows)], "weights": [ftrl(examples).astype(np.float32).tobytes()]})


def learn_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> np.ndarray:
    """Weights from the labelled rows that are not held out: at most about ``sample_rows`` of them.

    The sampled ids are few by that bound and are sent to the scan of the texts, so no text is shuffled
    but those to learn from.
    """
    known = (
        labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("double").alias("label"))
    )
    share = min(1.0, sample_rows / max(known.count(), 1))
    order = F.xxhash64("doc_id", F.lit(8))
    chosen = known.withColumn("order", order).where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", "text")
    examples = texts.mapInArrow(_examples, "order long, label double, grams binary")
    learners = max(1, round(min(sample_rows, known.count() * share) / LEARNER_ROWS))
    fitted = (
        examples.withColumn("learner", F.pmod(F.hash("order"), F.lit(learners)))
        .groupBy("learner")
        .applyInPandas(_learn, "rows long, weights binary")
        .toPandas()
    )
    total = np.zeros((1 << BITS) + 1)
    for rows, weights in zip(fitted["rows"], fitted["weights"], strict=True):
        total += rows * np.frombuffer(weights, np.float32)
    return (total / max(fitted["rows"].sum(), 1)).astype(np.float32)


def _score(batch: pa.RecordBatch, text: str, weights: np.ndarray, threshold: float) -> list[pa.Array]:
    place, first = ngrams(batch.column(text))
    n = np.diff(first)
    margin = np.full(batch.num_rows, float(weights[-1]))
    filled = np.flatnonzero(n)
    if len(filled):
        sums = np.add.reduceat(weights[place], first[:-1][filled], dtype=np.float64)
        margin[filled] += sums / np.sqrt(n[filled])
    score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
    return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]


def score_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns and ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return append_columns(docs, text, fields, lambda batch: _score(batch, text, shared.value, threshold))
