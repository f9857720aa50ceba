"""Preference metrics, score shapes and the linear preference model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneprep.operators.metrics import (
    accuracy,
    align_scores,
    flagged_share,
    logloss,
    pairwise_accuracy,
    pairwise_logloss,
    scores_from_arrays,
    scores_from_matrix,
    scores_from_struct,
)
from tuneprep.operators.columns import pair_texts
from tuneprep.operators.preference import PreferenceModel, evaluate_preference, fit_preference, score_pairs, score_with
from tuneprep.operators.splits import train_test
from tuneprep.queries import sql
from tuneprep.queries.registry import query
from tuneprep.sources import views
from tuneprep.storage import materialize

DIGITS = 6
# Fixed weights for scoring 64 features; they only need to differ from one another.
WEIGHTS = [((7 * i) % 11 - 5) / 10 for i in range(64)]

LOSS_SQL = "greatest(0.0, rewards_k - rewards_j) + ln(1 + exp(-abs(rewards_j - rewards_k)))"
MEASURES_SQL = (
    "avg(CASE WHEN rewards_j > rewards_k THEN 1.0 ELSE 0.0 END) AS accuracy, "
    f"round(avg({LOSS_SQL}), {DIGITS}) AS loss, count(*) AS n"
)


def measures(scores, *groups):
    j, k = F.col("rewards_j"), F.col("rewards_k")
    return scores.groupBy(*groups).agg(
        accuracy(j, k).alias("accuracy"),
        F.round(logloss(j, k), DIGITS).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )


@query("SELECT avg(CASE WHEN l_discount > l_tax THEN 1.0 ELSE 0.0 END) AS accuracy FROM lineitem", "pairwise_accuracy")
def accuracy_of_lines(spark, sf_dir):
    return pairwise_accuracy(views.scored(spark, sf_dir))


@query(
    "SELECT l_returnflag, avg(CASE WHEN l_discount > l_tax THEN 1.0 ELSE 0.0 END) AS accuracy "
    "FROM lineitem GROUP BY l_returnflag"
)
def pairwise_accuracy_by_group(spark, sf_dir):
    return pairwise_accuracy(views.scored(spark, sf_dir), group_by=["l_returnflag"])


@query(
    "WITH scores AS (SELECT l_discount AS rewards_j, l_tax AS rewards_k FROM lineitem) "
    f"SELECT round(avg({LOSS_SQL}), {DIGITS}) AS loss FROM scores",
    "pairwise_logloss",
)
def logloss_of_lines(spark, sf_dir):
    return pairwise_logloss(views.scored(spark, sf_dir)).select(F.round("loss", DIGITS).alias("loss"))


@query(
    "SELECT l_returnflag, "
    "avg(CASE WHEN l_linenumber <> 3 AND l_discount > l_tax THEN 1.0 ELSE 0.0 END) AS accuracy, "
    "bool_or(l_linenumber = 3) AS loss_is_nan, "
    f"round(avg({LOSS_SQL}) FILTER (WHERE l_linenumber <> 3), {DIGITS}) AS loss_of_others FROM "
    "(SELECT *, l_discount AS rewards_j, l_tax AS rewards_k FROM lineitem) GROUP BY l_returnflag"
)
def pairwise_measures_null(spark, sf_dir):
    """A NULL score is a wrong pair and makes the loss NaN."""
    line = views.table(spark, sf_dir, "lineitem")
    missing = F.col("l_linenumber") == 3
    j, k = F.when(~missing, F.col("l_discount")), F.col("l_tax")
    return line.groupBy("l_returnflag").agg(
        accuracy(j, k).alias("accuracy"),
        F.isnan(logloss(j, k)).alias("loss_is_nan"),
        F.count_if(missing).alias("_missing"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(~missing, F.greatest(F.lit(0.0), k - j) + F.log1p(F.exp(-F.abs(j - k))))).alias("_sum"),
    ).select("l_returnflag", "accuracy", "loss_is_nan", F.round(F.col("_sum") / (F.col("_rows") - F.col("_missing")), DIGITS).alias("loss_of_others"))


@query(
    f"WITH scores AS (SELECT l_discount AS rewards_j, l_tax AS rewards_k FROM lineitem) SELECT {MEASURES_SQL} FROM scores"
)
def normalize_predictions_named(spark, sf_dir):
    named = views.scored(spark, sf_dir).select(F.struct("rewards_j", "rewards_k").alias("predictions"))
    return measures(scores_from_struct(named, "predictions"))


@query(
    "WITH pairs AS (SELECT max_by(embedding, vec_id) AS j, min_by(embedding, vec_id) AS k FROM embeddings "
    "GROUP BY vec_id // 2 HAVING count(*) = 2), "
    "scores AS (SELECT CAST(unnest(j) AS DOUBLE) AS rewards_j, CAST(unnest(k) AS DOUBLE) AS rewards_k FROM pairs) "
    f"SELECT {MEASURES_SQL} FROM scores"
)
def normalize_predictions_arrays(spark, sf_dir):
    vectors = (
        views.table(spark, sf_dir, "embeddings")
        .groupBy(F.expr("vec_id div 2").alias("pair_id"))
        .agg(
            F.max_by("embedding", "vec_id").alias("j"),
            F.min_by("embedding", "vec_id").alias("k"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n = 2")
    )
    return measures(scores_from_arrays(vectors, "j", "k"))


@query(
    "WITH scores AS (SELECT o_totalprice / 1000 AS rewards_j, CAST(o_custkey AS DOUBLE) AS rewards_k FROM orders) "
    f"SELECT {MEASURES_SQL} FROM scores"
)
def normalize_predictions_matrix(spark, sf_dir):
    """A matrix with two rows: one column per order."""
    cells = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.posexplode(F.array(F.col("o_totalprice") / 1000, F.col("o_custkey").cast("double")))
    )
    return measures(scores_from_matrix(cells, "pos", "o_orderkey", "col"))


@query(
    "WITH j AS (SELECT o_totalprice AS rewards_j, row_number() OVER (ORDER BY o_orderkey) - 1 AS position "
    "FROM orders WHERE o_orderstatus = 'F'), "
    "k AS (SELECT o_totalprice AS rewards_k, row_number() OVER (ORDER BY o_orderkey) - 1 AS position "
    "FROM orders WHERE o_orderstatus <> 'F') "
    "SELECT position, rewards_j, rewards_k FROM j JOIN k USING (position)",
    "align_scores",
)
def aligned_orders(spark, sf_dir):
    """Two score lists of different length, paired by position."""
    orders = views.table(spark, sf_dir, "orders")
    finished = F.col("o_orderstatus") == "F"
    return align_scores(orders.where(finished), orders.where(~finished), "o_totalprice", ["o_orderkey"])


@query(
    "SELECT CAST(sum(CASE WHEN p_brand = 'Brand#1' THEN p_size ELSE 0 END) AS BIGINT) AS flagged, "
    "CAST(sum(p_size) AS BIGINT) AS total, "
    "100.0 * sum(CASE WHEN p_brand = 'Brand#1' THEN p_size ELSE 0 END) / sum(p_size) AS percent FROM part",
    "flagged_share",
)
def share_of_parts(spark, sf_dir):
    return flagged_share(views.manifest(spark, sf_dir), "numel", "requires_grad")


PAIRS_SQL = (
    "pairs AS (SELECT vec_id // 2 AS pair_id, max_by(embedding, label) AS x_j, min_by(embedding, label) AS x_k "
    "FROM embeddings GROUP BY vec_id // 2 HAVING max(label) <> min(label))"
)


def _dot(vector: str) -> str:
    weights = "[" + ", ".join(str(w) for w in WEIGHTS) + "]"
    return (
        f"list_sum(list_transform(range(1, {len(WEIGHTS) + 1}), "
        f"lambda i: CAST({vector}[i] AS DOUBLE) * CAST({weights} AS DOUBLE[])[i]))"
    )


SCORES_SQL = f"{PAIRS_SQL}, scores AS (SELECT pair_id, {_dot('x_j')} AS rewards_j, {_dot('x_k')} AS rewards_k FROM pairs)"


@query(
    f"WITH {SCORES_SQL} SELECT pair_id, round(rewards_j, {DIGITS}) AS rewards_j, "
    f"round(rewards_k, {DIGITS}) AS rewards_k FROM scores",
    "score",
)
def scored_vectors(spark, sf_dir):
    scored = score_pairs(views.vector_pairs(spark, sf_dir), PreferenceModel(tuple(WEIGHTS)))
    return scored.select(
        "pair_id", F.round("rewards_j", DIGITS).alias("rewards_j"), F.round("rewards_k", DIGITS).alias("rewards_k")
    )


@query(f"WITH {SCORES_SQL} SELECT {MEASURES_SQL} FROM scores")
def evaluate_fixed_weights(spark, sf_dir):
    return measures(score_pairs(views.vector_pairs(spark, sf_dir), PreferenceModel(tuple(WEIGHTS))))


REG_PARAM, FIT_STEPS, FIT_DIGITS = 0.01, 400, 4
FEATURES_SQL = "SELECT pair_id AS pair, i, CAST(x_j[i] AS DOUBLE) - CAST(x_k[i] AS DOUBLE) AS x FROM {pairs}, range(1, 65) r(i)"


@query(
    f"WITH RECURSIVE {PAIRS_SQL}, features AS ({FEATURES_SQL.format(pairs='pairs')}), "
    f"{sql.fit('fitted', 'features', REG_PARAM, FIT_STEPS)} "
    f"SELECT CAST(i - 1 AS INTEGER) AS feature, round(w, {FIT_DIGITS}) AS weight FROM fitted",
    "fit_preference",
)
def fitted_weights(spark, sf_dir):
    """One row per feature."""
    model = fit_preference(views.vector_pairs(spark, sf_dir), reg_param=REG_PARAM, max_iter=500, tol=1e-13)
    return spark.createDataFrame(
        [(i, round(w, FIT_DIGITS)) for i, w in enumerate(model.weights)], "feature int, weight double"
    )


@query(
    f"WITH RECURSIVE {PAIRS_SQL}, {sql.split('marked', 'pairs', ['pair_id'], 50, 3)}, "
    "train AS (SELECT * FROM marked WHERE split = 'train'), test AS (SELECT * FROM marked WHERE split = 'test'), "
    f"features AS ({FEATURES_SQL.format(pairs='train')}), {sql.fit('fitted', 'features', REG_PARAM, FIT_STEPS)}, "
    f"margins AS (SELECT sum(f.x * w) AS rewards_j, 0.0::DOUBLE AS rewards_k FROM ({FEATURES_SQL.format(pairs='test')}) f JOIN fitted USING (i) GROUP BY pair) "
    f"SELECT avg(CASE WHEN rewards_j > rewards_k THEN 1.0 ELSE 0.0 END) AS accuracy, round(avg({LOSS_SQL}), {FIT_DIGITS}) AS loss FROM margins",
    "evaluate_preference",
)
def held_out_measures(spark, sf_dir):
    """Fit on one part of the pairs, measure on the other."""
    pairs = materialize(views.vector_pairs(spark, sf_dir), "pairs")
    train, test = train_test(pairs, 50, 3, ["pair_id"])
    found = evaluate_preference(test, fit_preference(train, reg_param=REG_PARAM, max_iter=500, tol=1e-13))
    return found.select("accuracy", F.round("loss", FIT_DIGITS).alias("loss"))


SCORER_SQL = "length({t}) / 100.0 + 0.5 * (length({t}) - length(replace({t}, 'e', ''))) - 0.25 * (length({t}) - length(replace({t}, 'th', '')))"


def load_scorer(files):
    """Stands for loading a large model: a worker does it once."""
    rates = {"e": 0.5, "th": -0.5}
    return lambda texts: [len(text) / 100 + sum(rate * text.count(part) for part, rate in rates.items()) for text in texts]


@query(
    f"WITH {sql.QA}, texts AS (SELECT conv_id, turn, {sql.qa_text('question', 'response_j')} AS j, {sql.qa_text('question', 'response_k')} AS k FROM qa) "
    f"SELECT conv_id, turn, round({SCORER_SQL.format(t='j')}, {DIGITS}) AS rewards_j, round({SCORER_SQL.format(t='k')}, {DIGITS}) AS rewards_k FROM texts",
    "score_with",
)
def scored_by_caller(spark, sf_dir):
    """Both sides' texts through a caller's scorer, in one pass."""
    texts = pair_texts(views.qa(spark, sf_dir), keep=views.TURN_KEY)
    scored = score_with(texts, load=load_scorer)
    return scored.select(*views.TURN_KEY, *[F.round(name, DIGITS).alias(name) for name in ("rewards_j", "rewards_k")])
