"""A linear preference model: the pairwise log-loss minimised over feature vectors."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.metrics import REWARD_J, REWARD_K, accuracy, logloss
from tuneprep.storage import materialize

# The largest entry of the loss's gradient that counts as a minimum.
GRADIENT_BOUND = 1e-4


@dataclass(frozen=True)
class PreferenceModel:
    """Weights of a scalar scorer, and the fitted model they come from."""

    weights: tuple[float, ...]
    fitted: LogisticRegressionModel | None = None

    def save(self, path: str) -> None:
        if self.fitted is None:
            raise ValueError("Only a fitted model can be saved.")
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> PreferenceModel:
        fitted = LogisticRegressionModel.load(path)
        return cls(tuple(fitted.coefficients.toArray().tolist()), fitted)


def fit_preference(
    df: DataFrame, x_j: str = "x_j", x_k: str = "x_k", reg_param: float = 0.0, max_iter: int = 100, tol: float = 1e-7
) -> PreferenceModel:
    """Fit weights w that minimise the mean of ``-log(sigmoid(w·x_j - w·x_k))`` over dense vectors.

    That is a logistic regression without intercept on the differences. Every pair
    is given both ways round, which doubles the loss and leaves its minimum in place. The
    gradient at the weights found is checked; a fit that stopped elsewhere fails.
    """
    margin = F.zip_with(x_j, x_k, lambda j, k: j.cast("double") - k.cast("double"))
    both = F.array(
        F.struct(margin.alias("x"), F.lit(1.0).alias("label")),
        F.struct(F.transform(margin, lambda v: -v).alias("x"), F.lit(0.0).alias("label")),
    )
    training = df.select(F.inline(both).alias("x", "label")).select(array_to_vector("x").alias("features"), "label")
    return _fit(training, reg_param, max_iter, tol)


@dataclass(frozen=True)
class TermModel(PreferenceModel):
    """A weight for every id of a vocabulary."""

    def save(self, path: str) -> None:
        rows = [(i, w) for i, w in enumerate(self.weights)]
        spark = SparkSession.active()
        spark.createDataFrame(rows, "id int, weight double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> TermModel:
        rows = SparkSession.active().read.parquet(path).orderBy("id").collect()  # one row an id
        return cls(tuple(row["weight"] for row in rows))


def fit_terms(
    df: DataFrame,
    size: int,
    ids_j: str = "input_ids_j",
    ids_k: str = "input_ids_k",
    reg_param: float = 0.01,
    max_iter: int = 200,
    tol: float = 1e-5,
) -> TermModel:
    """The same fit on the term vectors of two id arrays, over a whole vocabulary of ``size`` ids.

    A side's features are how often each id occurs, divided by the root of the number of ids. The sparse
    differences are written once; every evaluation of loss and gradient is one aggregate over them that
    combines by id before the shuffle and brings one number an id to the driver, which keeps the search
    directions (L-BFGS). No feature is rescaled, so rare ids don't slow the search down. Fails unless the
    gradient's largest entry falls to ``tol``.
    """
    sparse = _term_difference(F.col(ids_j), F.col(ids_k))
    terms = materialize(df.select(sparse.alias("x")).select("x.ids", "x.amounts"), "term-differences")
    rows, last = terms.agg(F.count(F.lit(1)), F.max(F.array_max("ids"))).first()
    if last is not None and last >= size:
        raise ValueError(f"Id {last} is beyond a vocabulary of {size}.")

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        known = _numbers(w)
        margin = F.aggregate(F.zip_with("ids", "amounts", lambda i, x: F.get(known, i) * x), F.lit(0.0), lambda t, v: t + v)
        measured = terms.withColumn("m", margin)
        loss = F.greatest(F.lit(0.0), -F.col("m")) + F.log1p(F.exp(-F.abs("m")))
        share = F.zip_with("ids", "amounts", lambda i, x: F.struct(i.alias("id"), (-x / (1 + F.exp(F.col("m")))).alias("g")))
        parts = F.concat(share, F.array(F.struct(F.lit(-1).alias("id"), loss.alias("g"))))
        sums = measured.select(F.inline(parts)).groupBy("id").agg(F.sum("g").alias("g")).collect()
        gradient = np.zeros(size + 1)
        for i, g in sums:
            gradient[i] = g / rows  # id -1: the loss, last
        return gradient[-1] + 0.5 * reg_param * float(w @ w), gradient[:-1] + reg_param * w

    return TermModel(tuple(_minimize(evaluate, np.zeros(size), max_iter, tol).tolist()))


def _numbers(values: Sequence[float]) -> Column:
    """A constant array, sent as one text however long it is."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _term_difference(ids_j: Column, ids_k: Column) -> Column:
    """Ids whose share of the roots differs between two sides, and by how much."""

    @F.arrow_udf("struct<ids:array<int>,amounts:array<double>>")
    def difference(sides_j: pa.Array, sides_k: pa.Array) -> pa.Array:
        rows = []
        for j, k in zip(sides_j, sides_k, strict=True):
            found = [np.unique(np.asarray(ids.values if ids.is_valid else [], np.int32), return_counts=True) for ids in (j, k)]
            ids = np.union1d(found[0][0], found[1][0]).astype(np.int32)
            amounts = np.zeros(len(ids))
            for sign, (own, counts) in zip((1, -1), found, strict=True):
                amounts[np.searchsorted(ids, own)] += sign * counts / max(counts.sum(), 1) ** 0.5
            rows.append({"ids": ids[amounts != 0], "amounts": amounts[amounts != 0]})
        return pa.array(rows, pa.struct([("ids", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float64()))]))

    return difference(ids_j, ids_k)


def _minimize(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS with halved steps; ``evaluate`` returns value and gradient."""
    value, gradient = evaluate(w)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=12)
    for _ in range(max_iter):
        if np.abs(gradient).max(initial=0.0) <= tol:
            return w
        direction, used = gradient.copy(), []
        for step, change in reversed(past):
            share = step @ direction / (step @ change)
            direction -= share * change
            used.append(share)
        if past:
            step, change = past[-1]
            direction *= step @ change / (change @ change)
        for (step, change), share in zip(past, reversed(used), strict=True):
            direction += (share - change @ direction / (step @ change)) * step
        length, slope = 1.0, gradient @ direction
        new_value, new_gradient = evaluate(w - direction)
        while new_value > value - 1e-4 * length * slope + 1e-15 * abs(value) and length > 1e-9:
            length /= 2
            new_value, new_gradient = evaluate(w - length * direction)
        if (new_gradient - gradient) @ direction < 0:  # curvature along the step
            past.append((-length * direction, new_gradient - gradient))
        w, value, gradient = w - length * direction, new_value, new_gradient
    steepest = np.abs(gradient).max(initial=0.0)
    if steepest > tol:
        raise RuntimeError(f"The fit stopped at a gradient of {steepest:.2g}: raise max_iter or reg_param.")
    return w


def _fit(training: DataFrame, reg_param: float, max_iter: int, tol: float) -> PreferenceModel:
    regression = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=reg_param, maxIter=max_iter, tol=tol
    )
    fitted = regression.fit(training)
    steepest = _gradient(training, fitted, reg_param)
    if steepest > GRADIENT_BOUND:
        raise RuntimeError(f"The fit stopped at a gradient of {steepest:.2g}: raise max_iter or reg_param.")
    return PreferenceModel(tuple(fitted.coefficients.toArray().tolist()), fitted)


def _gradient(training: DataFrame, fitted: LogisticRegressionModel, reg_param: float) -> float:
    """Largest entry of the regularised loss's gradient, by one weighted sum of vectors."""
    margin = vector_to_array("rawPrediction")[1]
    wrong = fitted.transform(training.where("label = 1")).select("features", (1 / (1 + F.exp(margin))).alias("p"))
    total, rows = wrong.agg(Summarizer.sum(F.col("features"), F.col("p")), F.count(F.lit(1))).first()
    if not rows:
        return 0.0
    return float(np.abs(reg_param * fitted.coefficients.toArray() - total.toArray() / rows).max(initial=0.0))


_loaded: dict[str, Callable] = {}


def _scorer(token: str, load: Callable[[dict[str, str]], Callable], names: Sequence[str]) -> Callable:
    """What ``load`` returns, kept by the worker's own module from one task to the next."""
    if token not in _loaded:
        _loaded[token] = load({name: SparkFiles.get(name) for name in names})
    return _loaded[token]


def score_with(
    df: DataFrame,
    fn: Callable[[list[str]], Sequence[float]] | None = None,
    text_j: str = "text_j",
    text_k: str = "text_k",
    load: Callable[[dict[str, str]], Callable[[list[str]], Sequence[float]]] | None = None,
    files: Sequence[str] = (),
) -> DataFrame:
    """Add the scores of both texts of every pair by a caller's own scorer.

    Either ``fn`` is the scorer, or ``load`` returns it. ``load`` is called once by each Python worker, with the
    places of ``files`` (by file name), which are sent to every executor. Both must be picklable. The
    scorer gets one Arrow batch at a time, the texts of both sides together; NULL texts are empty.
    """
    if (fn is None) == (load is None):
        raise ValueError("Give a scorer or a function that loads it.")
    for path in files:
        df.sparkSession.sparkContext.addFile(path)
    names, token = [path.rstrip("/").rpartition("/")[2] for path in files], uuid.uuid4().hex

    @F.arrow_udf("struct<j:double,k:double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = fn if load is None else _scorer(token, load, names)
        for j, k in batches:
            scores = list(scorer([*j.to_pylist(), *k.to_pylist()]))
            sides = [pa.array(s, pa.float64()) for s in (scores[: len(j)], scores[len(j) :])]
            yield pa.StructArray.from_arrays(sides, ["j", "k"])

    texts = [F.coalesce(F.col(name), F.lit("")) for name in (text_j, text_k)]
    scored = df.withColumn("_scores", run(*texts))
    return scored.withColumns({REWARD_J: F.col("_scores.j"), REWARD_K: F.col("_scores.k")}).drop("_scores")


def score_terms(ids: Column, weights: Sequence[float]) -> Column:
    """One score per id array: the weights of its ids, by the root of their number."""
    known, ids = _numbers(weights), F.coalesce(ids, F.array().cast("array<int>"))
    total = F.aggregate(ids, F.lit(0.0), lambda total, i: total + F.coalesce(F.get(known, i), F.lit(0.0)))
    return total / F.sqrt(F.greatest(F.size(ids), F.lit(1)))


def score(features: Column, weights: Sequence[float]) -> Column:
    """One score per row: the dot product of features and weights."""
    weighted = F.zip_with(
        features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x.cast("double") * w
    )
    return F.aggregate(weighted, F.lit(0.0), lambda total, term: total + term)


def score_pairs(df: DataFrame, model: PreferenceModel, x_j: str = "x_j", x_k: str = "x_k") -> DataFrame:
    """Add the scores of both sides of every pair."""
    return df.withColumns(
        {REWARD_J: score(F.col(x_j), model.weights), REWARD_K: score(F.col(x_k), model.weights)}
    )


def evaluate_terms(
    df: DataFrame, model: PreferenceModel, ids_j: str = "input_ids_j", ids_k: str = "input_ids_k", group_by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and log-loss of a model of :func:`fit_terms` on held-out pairs of id arrays, in one pass."""
    j, k = (score_terms(F.col(ids), model.weights) for ids in (ids_j, ids_k))
    return df.groupBy(*group_by).agg(accuracy(j, k).alias("accuracy"), logloss(j, k).alias("loss"))


def evaluate_preference(
    df: DataFrame,
    model: PreferenceModel,
    x_j: str = "x_j",
    x_k: str = "x_k",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy and log-loss of a model on held-out pairs, in one pass."""
    j, k = F.col(REWARD_J), F.col(REWARD_K)
    return score_pairs(df, model, x_j, x_k).groupBy(*group_by).agg(
        accuracy(j, k).alias("accuracy"), logloss(j, k).alias("loss")
    )
