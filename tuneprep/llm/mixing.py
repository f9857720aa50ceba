"""Mixing towards target weights with soft domains.

A classifier learned from a labelled table gives every document a probability for each
domain. Rates (how often a document is used, 0 or more) are then fitted so that the
expected tokens of every domain, ``sum(rate * tokens * probability)``, match the targets:
least squares by accelerated projected gradient. An iteration is one distributed pass over
(tokens, probabilities) that sends back a few numbers per pair of domains and task. A document's rate
follows from its probabilities and the residuals of all passes, so rates are never stored
between passes nor gathered.

Steps are scaled by the measured matrix of ``sum(tokens * probability * probability)``. After ``PASSES``
accelerated passes the momentum stops and the matrix is measured anew in each pass, over the documents
still used, until every total is within ``TOLERANCE`` of all tokens. Targets that no rates reach, as of a
domain of which every document holds more than its target share, leave the nearest totals of the accelerated passes
(later ones only drive a few rates up), with a warning that names them.

Defined cases: a NULL or empty text has no tokens, so its rate moves no total; its
probabilities are those of a text without features. Rows are rated one by one, repeated rows
alike. Labels that are NULL do not count; of several labels of one doc_id the smallest name
counts. An empty table gives an empty result; without labels all rates are 1.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.llm.common import append_columns, free_name
from tuneprep.llm.quality import BITS, LEARNER_ROWS, _examples, ftrl, ngrams
from tuneprep.llm.words import find_words, text_bytes
from tuneprep.storage import materialize

SAMPLE_ROWS = 12_000
PASSES = 30
TOLERANCE = 1e-5
HALVINGS = 20
MOST_PASSES = 150
FIELDS = [T.StructField("tokens", T.LongType()), T.StructField("domains", T.ArrayType(T.DoubleType()))]


@dataclass
class DomainModel:
    """Domain names and one weight vector for each (the last place is the intercept)."""

    names: list[str]
    weights: np.ndarray


def _learn(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    rows = rows.sort_values(["order", "label", "grams"])
    places = [np.frombuffer(g, np.int32) for g in rows["grams"]]
    fitted = [
        ftrl([(float(label == name), p) for label, p in zip(rows["label"], places, strict=True)])
        for name in names
    ]
    return pd.DataFrame({"rows": [len(rows)], "weights": [np.stack(fitted).astype(np.float32).tobytes()]})


def learn_domains(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DomainModel:
    """One-against-rest weights per value of ``labels.domain``, from at most about ``sample_rows`` labelled rows."""
    known = labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("domain").alias("label"))
    rows = known.groupBy("label").count().toPandas()
    names, share = sorted(rows["label"]), min(1.0, sample_rows / max(rows["count"].sum(), 1))
    order = F.xxhash64("doc_id", F.lit(4))
    chosen = known.withColumn("order", order).where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", "text")
    learners = max(1, round(rows["count"].sum() * share / LEARNER_ROWS))
    fitted = (
        texts.mapInArrow(_examples, "order long, label string, grams binary")
        .withColumn("learner", F.pmod(F.hash("order"), F.lit(learners)))
        .groupBy("learner")
        .applyInPandas(lambda group: _learn(group, names), "rows long, weights binary")
        .toPandas()
    )
    total = np.zeros((len(names), (1 << BITS) + 1))
    for n, weights in zip(fitted["rows"], fitted["weights"], strict=True):
        total += n * np.frombuffer(weights, np.float32).reshape(total.shape)
    return DomainModel(names, (total / max(fitted["rows"].sum(), 1)).astype(np.float32))


def _posteriors(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of every row, and its probability for each domain."""
    data, bounds = text_bytes(column)
    words = np.diff(find_words(data, bounds)[2])
    place, first = ngrams(column)
    n = np.diff(first)
    filled = np.flatnonzero(n)
    if not len(weights):  # nothing was learned
        return words, np.zeros((len(n), 0))
    margin = np.repeat(weights[:, -1:].astype(np.float64), len(n), axis=1)
    for k, row in enumerate(weights):
        if len(filled):
            sums = np.add.reduceat(row[place], first[:-1][filled], dtype=np.float64)
            margin[k, filled] += sums / np.sqrt(n[filled])
    score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
    return words, (score / score.sum(axis=0)).T


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def add_domains(docs: DataFrame, model: DomainModel) -> DataFrame:
    """All columns, ``tokens`` and ``domains``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        words, domains = _posteriors(batch.column("text"), shared.value)
        return [pa.array(words), _lists(domains)]

    return append_columns(docs, "text", FIELDS, compute)


def rates(domains: np.ndarray, history: np.ndarray, accelerated: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the passes whose residuals are given, and the point where the next gradient is taken.

    Momentum counts in the first ``accelerated`` passes, or in all of them.
    """
    rate = np.ones(len(domains))
    ahead, speed = rate, 1.0
    for done, residual in enumerate(history, 1):
        moved = np.maximum(0.0, ahead - domains @ residual)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        keep = accelerated is None or done < accelerated
        ahead = moved + (speed - 1) / faster * (moved - rate) if keep else moved
        rate, speed = moved, faster
    return rate, ahead


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch], history: np.ndarray) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            tokens, domains = batch.column("tokens").to_numpy(), _matrix(batch.column("domains"))
            fitted, ahead = rates(domains, history, PASSES)
            part = np.stack([(tokens * r) @ domains for r in (np.ones(len(tokens)), fitted, ahead)])
            used = fitted > 0
            part = np.vstack([part, (domains[used] * tokens[used, None]).T @ domains[used]])
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["sums"])


def _totals(table: DataFrame, history: np.ndarray, domains: int) -> np.ndarray:
    """Domain totals over all documents: at rate 1, at the fitted rates, at the next gradient's point; below, a row
    per domain, the sums of tokens * probability * probability over documents with a rate above 0."""
    parts = table.select("tokens", "domains").mapInArrow(lambda b: _sums(b, history), "sums array<double>")
    columns = [F.sum(F.col("sums")[i]) for i in range((3 + domains) * domains)]
    return np.array([x or 0.0 for x in parts.agg(*columns).first()]).reshape(3 + domains, domains)


@dataclass
class Mixture:
    """What rates follow from, and how near the totals came."""

    names: list[str]
    history: np.ndarray
    natural: np.ndarray
    target: np.ndarray
    reached: np.ndarray

    @property
    def met(self) -> bool:
        """Whether every total is within ``TOLERANCE`` of all tokens."""
        return bool((np.abs(self.reached - self.target) <= TOLERANCE * self.natural.sum()).all())


def fit_rates(table: DataFrame, names: list[str], weights: dict[str, float], thin: tuple[str, ...] = ()) -> Mixture:
    """Fit rates to target weights over a table of ``tokens`` and ``domains``.

    The budget is the least that asks for no less than there is of any domain, but those
    in ``thin``, which may be used less than once.
    """
    d = len(names)
    first = _totals(table, np.zeros((0, d)), d) if d else np.zeros((3, 0))
    natural = first[0]
    whole = natural.sum()
    if not d or not whole:
        return Mixture(names, np.zeros((0, d)), natural, natural, natural)
    share = np.array([weights.get(name, 0.0) for name in names])
    share = share / share.sum()
    full = [i for i, name in enumerate(names) if name not in thin and share[i] > 0]
    target = share * max(natural[i] / share[i] for i in full)
    fitted = _fit(lambda history: _totals(table, history, d)[1:], first[1:], target, whole)
    mixture = Mixture(names, fitted[0], natural, target, fitted[1])
    if not mixture.met:
        shares = (f"{n} {r / whole:.5f} of {t / whole:.5f}" for n, r, t in zip(names, mixture.reached, target, strict=True))
        warnings.warn(f"target weights not reached after {len(fitted[0])} passes, in all tokens: {', '.join(shares)}", stacklevel=2)
    return mixture


def _fit(
    measure: Callable[[np.ndarray], np.ndarray], sums: np.ndarray, target: np.ndarray, whole: float
) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of all passes and the totals they reach; ``measure`` gives a history's totals and matrix."""
    history, best = np.zeros((0, len(target))), (np.inf, np.zeros((0, len(target))), sums[0])
    scale = np.linalg.pinv(sums[2:], rcond=TOLERANCE**2, hermitian=True)  # bounds the step by 1 while it covers all documents
    halved = 0
    for _ in range(MOST_PASSES):
        error = np.abs(sums[0] - target).max()
        if error < best[0] and (len(history) <= PASSES or error <= TOLERANCE * whole):
            best = error, history, sums[0]
        if error <= TOLERANCE * whole or halved > HALVINGS:
            break
        if len(history) < PASSES:
            history = np.vstack([history, scale @ (sums[1] - target)])
            sums = measure(history)
            continue
        if not halved:
            residual = sums[0] - target
            scale = np.linalg.pinv(sums[2:], rcond=TOLERANCE**2, hermitian=True)
        tried = np.vstack([history, scale @ residual / 2**halved])
        after = measure(tried)
        left = after[0] - target
        if left @ scale @ left < residual @ scale @ residual:
            history, sums, halved = tried, after, 0
        else:
            halved += 1
    return best[1:]


def _rate(batches: Iterator[pa.RecordBatch], history: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rate = rates(_matrix(batch.column("domains")), history, PASSES)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])


def add_rates(table: DataFrame, mixture: Mixture) -> DataFrame:
    """``rate`` for a table that has ``domains``."""
    history = mixture.history
    schema = T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])
    return table.mapInArrow(lambda b: _rate(b, history), schema)


def document_rates(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], thin: tuple[str, ...] = ()
) -> tuple[DataFrame, Mixture, DomainModel]:
    """(doc_id, tokens, domains, rate) of every document, and the models behind it."""
    model = learn_domains(docs, labels)
    table = materialize(add_domains(docs.select("doc_id", "text"), model).drop("text"), "domains")
    mixture = fit_rates(table, model.names, weights, thin)
    return add_rates(table, mixture), mixture, model


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], thin: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """The documents, each repeated as its rate says: the whole part, and once more by chance for the rest.

    Chance is a hash of doc_id and ``seed``, so a run can be repeated. Texts are rated where they lie.
    """
    _, mixture, model = document_rates(docs, labels, weights, thin)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, mixture.history))

    def rated(batch: pa.RecordBatch) -> list[pa.Array]:
        model_weights, history = shared.value
        return [pa.array(rates(_posteriors(batch.column("text"), model_weights)[1], history, PASSES)[0])]

    rate = free_name(docs, "rate")
    copy = free_name(docs, "copy")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col(rate) + chance).cast("int")
    mixed = append_columns(docs, "text", [T.StructField(rate, T.DoubleType())], rated).where(copies > 0)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)
