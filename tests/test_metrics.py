import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneprep.operators.metrics import (
    align_scores,
    flagged_share,
    pairwise_accuracy,
    pairwise_logloss,
    scores_from_arrays,
    scores_from_matrix,
    scores_from_struct,
)
from tuneprep.operators.preference import (
    PreferenceModel,
    evaluate_preference,
    fit_preference,
    score_pairs,
)

PAIR = "rewards_j double, rewards_k double"
NAN = float("nan")


def measure(spark, function, rows):
    return function(spark.createDataFrame(rows, PAIR)).first()[0]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1.0, 0.0), (1.0, 1.0), (NAN, 0.0), (-800.0, 0.0)], 0.25),
        ([(1.0, NAN), (NAN, NAN), (None, 0.0), (1.0, None)], 0.0),
        ([], None),
    ],
)
def test_accuracy(spark, rows, expected):
    assert measure(spark, pairwise_accuracy, rows) == expected


def test_logloss(spark):
    assert measure(spark, pairwise_logloss, [(0.0, 0.0)]) == pytest.approx(math.log(2))
    assert measure(spark, pairwise_logloss, [(800.0, 0.0)]) == pytest.approx(0.0)
    assert measure(spark, pairwise_logloss, [(0.0, 800.0)]) == pytest.approx(800.0)
    assert math.isnan(measure(spark, pairwise_logloss, [(NAN, 0.0), (1.0, 0.0)]))
    assert measure(spark, pairwise_logloss, []) is None


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 0.0, 1.0), ("b", 1.0, 0.0)], f"g string, {PAIR}")
    assert {r.g: r.accuracy for r in pairwise_accuracy(df, group_by=["g"]).collect()} == {"a": 0.5, "b": 1.0}


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_score_shapes(spark):
    arrays = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 5.0]), ([], [1.0])], "j array<double>, k array<double>")
    assert pairs(scores_from_arrays(arrays, "j", "k")) == [(1.0, 0.0), (2.0, 5.0)]
    named = spark.createDataFrame([((1.0, 2.0),)], f"p struct<{PAIR.replace(' double', ':double')}>")
    assert pairs(scores_from_struct(named, "p")) == [(1.0, 2.0)]
    assert scores_from_struct(spark.createDataFrame([((1.0,),)], "p struct<rewards_j:double>"), "p") is None


@pytest.mark.parametrize("shape", [(2, 5), (5, 2), (2, 2), (3, 3), (1, 1)])
def test_matrix_shapes(spark, shape):
    matrix = np.arange(shape[0] * shape[1], dtype=float).reshape(shape)
    cells = [(i, j, float(matrix[i, j])) for i in range(shape[0]) for j in range(shape[1])]
    scores = scores_from_matrix(spark.createDataFrame(cells, "i int, j int, v double"), "i", "j", "v")
    if shape[0] == 2:
        assert pairs(scores) == sorted(zip(matrix[0], matrix[1]))
    elif shape[1] == 2:
        assert pairs(scores) == sorted(zip(matrix[:, 0], matrix[:, 1]))
    else:
        assert scores is None


def test_alignment_stops_at_the_shorter_list(spark):
    j = spark.createDataFrame([(30, 3.0), (10, 1.0), (20, 2.0)], "k int, v double")
    k = spark.createDataFrame([(7, 0.5), (5, 0.1)], "k int, v double")
    out = align_scores(j, k, "v", ["k"]).orderBy("position").collect()
    assert [tuple(r) for r in out] == [(0, 1.0, 0.1), (1, 2.0, 0.5)]


def test_flagged_share(spark):
    df = spark.createDataFrame([("a", 30, True), ("b", 70, False), ("c", 0, None)], "name string, n int, f boolean")
    assert tuple(flagged_share(df, "n", "f").first()) == (30, 100, 30.0)
    assert tuple(flagged_share(df.where("not f"), "n", "f").first()) == (0, 70, 0.0)
    assert flagged_share(df.where("name = 'c'"), "n", "f").first()["percent"] is None


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x_j, x_k = rng.normal(0.3, 1, (300, 4)), rng.normal(0, 1, (300, 4))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x_j, x_k)], "x_j array<double>, x_k array<double>")
    return x_j - x_k, df


def test_fit_reaches_the_minimum(spark, vectors, out_dir):
    margins, df = vectors
    model = fit_preference(df)
    w = np.zeros(4)
    for _ in range(30):  # Newton steps on the mean log-loss
        p = 1 / (1 + np.exp(-margins @ w))
        hessian = (margins * (p * (1 - p))[:, None]).T @ margins
        w += np.linalg.solve(hessian, margins.T @ (1 - p))
    assert np.allclose(model.weights, w, atol=1e-4)
    result = evaluate_preference(df, model).first()
    assert result.accuracy == pytest.approx(np.mean(margins @ w > 0), abs=0.01)
    assert result.loss == pytest.approx(np.mean(np.log1p(np.exp(-margins @ w))), abs=1e-6)
    model.save(out_dir)
    assert np.allclose(PreferenceModel.load(out_dir).weights, model.weights)
    with pytest.raises(ValueError):
        PreferenceModel((1.0,)).save(out_dir)


def test_scores(spark, vectors):
    margins, df = vectors
    weights = (0.5, -1.0, 2.0, 0.0)
    rows = score_pairs(df, PreferenceModel(weights)).select((F.col("rewards_j") - F.col("rewards_k")).alias("d")).collect()
    assert np.allclose(sorted(r.d for r in rows), sorted(margins @ np.array(weights)))


def test_null_scores_make_the_loss_nan(spark):
    from tuneprep.operators.metrics import pairwise_accuracy, pairwise_logloss

    scores = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (0.0, 1.0)], "rewards_j double, rewards_k double")
    assert abs(pairwise_accuracy(scores).first()[0] - 1 / 3) < 1e-12
    assert pairwise_logloss(scores).first()[0] != pairwise_logloss(scores).first()[0]


def test_matrix_cells_must_be_there_once(spark):
    import pytest

    from tuneprep.operators.metrics import scores_from_matrix

    cells = [(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0)]
    for wrong in (cells, [*cells, (1, 1, 4.0), (1, 1, 4.0)]):
        with pytest.raises(Exception, match="exactly once"):
            scores_from_matrix(spark.createDataFrame(wrong, "r int, c int, v double"), "r", "c", "v").collect()
    whole = spark.createDataFrame([*cells, (1, 1, None)], "r int, c int, v double")
    assert sorted(tuple(r) for r in scores_from_matrix(whole, "r", "c", "v").collect()) == [(1.0, 2.0), (3.0, None)]


def test_score_with(spark):
    from tuneprep.operators.preference import score_with

    pairs = spark.createDataFrame([(1, "abc", "a"), (2, None, "xy")], "k int, text_j string, text_k string")
    scored = score_with(pairs, lambda texts: [float(len(t)) for t in texts])
    assert scored.columns == ["k", "text_j", "text_k", "rewards_j", "rewards_k"]
    assert sorted((r.k, r.rewards_j, r.rewards_k) for r in scored.collect()) == [(1, 3.0, 1.0), (2, 0.0, 2.0)]


def test_a_fit_that_stops_early_fails(spark):
    import random

    import pytest

    rng = random.Random(1)
    rows = [([rng.gauss(1, 2), rng.gauss(0, 9)], [rng.gauss(0, 2), rng.gauss(0, 9)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "x_j array<double>, x_k array<double>")
    with pytest.raises(RuntimeError, match="gradient"):
        fit_preference(df, max_iter=1)


def test_fit_on_all_terms(spark, out_dir):
    """Sparse differences over a whole vocabulary reach the minimum that Newton's method finds."""
    from tuneprep.operators.preference import evaluate_terms, fit_terms

    rng, size = np.random.default_rng(6), 40
    ids = [[rng.integers(0, size, n).tolist() for n in rng.integers(0, 30, 2)] for _ in range(300)]
    df = spark.createDataFrame([*[tuple(x) for x in ids], (None, [1, 1])], "input_ids_j array<int>, input_ids_k array<int>")
    x = np.array([np.bincount(j, minlength=size) / max(len(j), 1) ** 0.5 - np.bincount(k, minlength=size) / max(len(k), 1) ** 0.5 for j, k in [*ids, ([], [1, 1])]])
    w = np.zeros(size)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = 0.1 * w - x.T @ (1 - p) / len(x)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + 0.1 * np.eye(size), gradient)
    model = fit_terms(df, size, reg_param=0.1, tol=1e-8)
    assert np.allclose(model.weights, w, atol=1e-6)
    result = evaluate_terms(df, model).first()
    assert result.accuracy == pytest.approx(np.mean(x @ w > 0), abs=0.004)
    assert result.loss == pytest.approx(np.mean(np.log1p(np.exp(-x @ w))), abs=1e-8)
    model.save(out_dir)
    assert type(model).load(out_dir) == model
    with pytest.raises(RuntimeError, match="gradient"):
        fit_terms(df, size, max_iter=1)
    assert set(fit_terms(df.limit(0), 3).weights) == {0.0}
    with pytest.raises(Exception, match="beyond a vocabulary"):
        fit_terms(df, 10, reg_param=0.1)


def test_rare_words_count(spark):
    """Pairs that differ only in an id beyond the frequent ones get different scores."""
    from tuneprep.operators.preference import PreferenceModel, evaluate_terms

    df = spark.createDataFrame([([1, 31_999], [1, 5])], "input_ids_j array<int>, input_ids_k array<int>")
    weights = [0.0] * 32_000
    weights[31_999] = 1.0
    assert evaluate_terms(df, PreferenceModel(tuple(weights))).first().accuracy == 1.0


def test_a_scorer_is_loaded_once_a_worker(spark, tmp_path):
    from tuneprep.operators.preference import score_with

    (tmp_path / "rate.txt").write_text("2.5")

    def load(files):
        import os
        import uuid

        rate = float(open(files["rate.txt"]).read())
        mark = (os.getpid() * 1000 + uuid.uuid4().int % 1000) * 1000.0
        return lambda texts: [mark + rate * len(text) for text in texts]

    pairs = spark.range(0, 4000, 1, 16).selectExpr("id", "repeat('x', int(id % 7)) AS text_j", "CAST(NULL AS STRING) AS text_k")
    scored = score_with(pairs, load=load, files=[str(tmp_path / "rate.txt")]).collect()
    assert all(r.rewards_j - r.rewards_k == 2.5 * (r.id % 7) for r in scored)
    marks = {r.rewards_k for r in scored}
    assert len(marks) == len({m // 1_000_000 for m in marks})  # each process loaded once
    for wrong in ({}, {"fn": len, "load": load}):
        with pytest.raises(ValueError):
            score_with(pairs, **wrong)
