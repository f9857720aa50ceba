"""Hard negatives by integer inner products, filtered through the angular triangle inequality.

Every vector's components are scaled and rounded down. Its norm and its angles to a few reference
directions are stored. For an anchor at angle a and a row at angle t to one reference, their own
angle lies between |a - t| and a + t, so their cosine lies in an interval; the references'
intervals are intersected, multiplied by both norms and widened by more than rounding can amount to. Integer
scores are computed only where such a score interval can matter: for positives, where its top reaches
the k-th best bottom of the block; for negatives, where it overlaps a window between the floor that a
positive's score sets and that score.

Anchors meet all rows in blocks of bounded size, whatever labels or vectors are frequent; a block
passes on at most k rows for an anchor, or for a positive, and these are merged by rank.

Defined cases: rows whose id, label or vector is NULL, empty or holds a NULL or non-finite component take
no part, nor do vectors of another length than the most frequent one; of several rows of one id, the one with the
smallest label, then vector bytes, stands; equal scores go to the smaller id; a zero vector scores 0; a positive with a
negative score has no negatives, as its window is empty; an empty table gives no rows; other columns are
ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.storage import materialize

SCALE = 256
REFERENCES, SAMPLE = 16, 2_048  # directions are chosen from about so many rows
BLOCK_ROWS, BLOCK_ANCHORS = 1_024, 1_024
# Angles are off by up to 2e-8 where a cosine is near 1, which moves a bound by less than this share of the norms.
SLACK = 1e-6
EXACT = 2.0**53  # sums of whole numbers up to this are exact in doubles


def usable(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows that take part, one an id."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def _scaled(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.floor(scale * batch.column("v").flatten().to_numpy(zero_copy_only=False)) + 0.0  # no -0.0
        raw = [row.tobytes() for row in flat.reshape(batch.num_rows, -1 if batch.num_rows else 1)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "vec"])


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1 if len(raw) else 1)


def norms_of(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, initial=0)
    safe = np.where(largest > 0, largest, 1)
    return np.linalg.norm(rows / safe[:, None], axis=1) * largest


def unit(rows: np.ndarray) -> np.ndarray:
    norms = norms_of(rows)
    return rows / np.where(norms > 0, norms, 1)[:, None]


def references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Directions of sampled rows, each the farthest from those before it."""
    rows = unit(sample[np.abs(sample).any(axis=1)])
    if not len(rows):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def angles(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(rows) @ directions.T, -1, 1))


def _measured(batches: Iterator[pa.RecordBatch], directions: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch.column("vec").to_pylist())
        raw = [row.tobytes() for row in angles(rows, directions)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms_of(rows)), pa.array(raw, pa.binary())], [*batch.schema.names, "norm", "angles"])


def score_bounds(a_angles: np.ndarray, a_norms: np.ndarray, r_angles: np.ndarray, r_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of every anchor (rows) and row (columns)."""
    low, high = np.full((len(a_norms), len(r_norms)), -1.0), np.ones((len(a_norms), len(r_norms)))
    for j in range(a_angles.shape[1]):
        straight = np.outer(np.cos(a_angles[:, j]), np.cos(r_angles[:, j]))
        across = np.outer(np.sin(a_angles[:, j]), np.sin(r_angles[:, j]))
        np.minimum(high, straight + across, out=high)  # the cosine of the angles' difference
        np.maximum(low, straight - across, out=low)  # and of their sum
    norms = np.outer(a_norms, r_norms)
    return (low - SLACK) * norms - SLACK, (high + SLACK) * norms + SLACK


def scores(anchor: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products; ``largest`` bounds the product of the norms."""
    if largest < EXACT:
        return (rows @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in rows], np.int64)


def _block(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block by id: ids, labels, vectors, norms, angles."""
    frame = frame.sort_values("vec_id", kind="stable")
    vectors = _matrix(frame["vec"].tolist())
    measured = np.frombuffer(b"".join(frame["angles"]), np.float64).reshape(len(frame), -1)
    return frame["vec_id"].to_numpy(), frame["label"].to_numpy(), vectors, frame["norm"].to_numpy(), measured


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest; among equals the first."""
    return np.argsort(-found, kind="stable")[:k]


POSITIVES = "anchor_id long, vec_id long, score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(anchors) and len(rows):
        a_ids, a_labels, a_vecs, a_norms, a_angles = _block(anchors)
        ids, labels, vecs, norms, r_angles = _block(rows)
        low, high = score_bounds(a_angles, a_norms, r_angles, norms)
        for i, anchor_id in enumerate(a_ids):
            same = np.flatnonzero((labels == a_labels[i]) & (ids != anchor_id))
            if len(same) > k:  # a row whose top is below k bottoms has k better ones
                same = same[high[i, same] >= np.partition(low[i, same], -k)[-k]]
            found = scores(a_vecs[i], vecs[same], a_norms[i] * norms.max())
            best = _best(found, k)
            out += [(anchor_id, ids[same[j]], found[j]) for j in best]
    return pd.DataFrame(out, columns=["anchor_id", "vec_id", "score"])


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, least: int) -> pd.DataFrame:
    out = []
    if len(anchors) and len(rows):
        a_ids, a_labels, a_vecs, a_norms, a_angles = _block(anchors)
        wanted = dict(zip(anchors["vec_id"], anchors["positives"], strict=True))
        ids, labels, vecs, norms, r_angles = _block(rows)
        low, high = score_bounds(a_angles, a_norms, r_angles, norms)
        for i, anchor_id in enumerate(a_ids):
            # 100 * score between least * positive and 100 * positive
            windows = [(p["vec_id"], -(-least * int(p["score"]) // 100), int(p["score"])) for p in wanted[anchor_id] if p["score"] >= 0]
            overlaps = np.zeros(len(ids), bool)
            for _, floor, ceiling in windows:
                overlaps |= (high[i] >= floor) & (low[i] <= ceiling)
            other = np.flatnonzero(overlaps & (labels != a_labels[i]))
            if not len(other):
                continue
            found = scores(a_vecs[i], vecs[other], a_norms[i] * norms.max())
            for positive, floor, ceiling in windows:
                inside = np.flatnonzero((found >= floor) & (found <= ceiling))
                best = inside[_best(found[inside], k)]
                out += [(anchor_id, positive, ceiling, ids[other[j]], found[j]) for j in best]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])


class Grid:
    """All pairs of a block of anchors and a block of rows, each pair a group of bounded size."""

    def __init__(self, rows: DataFrame, count: int, anchors: int, block_rows: int, block_anchors: int):
        self.blocks, self.chunks = max(1, -(-count // block_rows)), max(1, -(-anchors // block_anchors))
        self.rows = rows

    def _dealt(self, frame: DataFrame, own: str, into: int, other: str, copies: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(into)).cast("int")
        return frame.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def meet(self, anchors: DataFrame, function, schema: str) -> DataFrame:
        left = self._dealt(anchors, "chunk", self.chunks, "block", self.blocks)
        right = self._dealt(self.rows, "block", self.blocks, "chunk", self.chunks)
        return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(function, schema)


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group, ranked from 1; what cannot be among them is left out before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    every: int = 100,
    k: int = 5,
    least: int = 80,
    scale: int = SCALE,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the ids divisible by ``every``; positives an anchor's ``k`` best rows of its own label;
    negatives, for each positive, the ``k`` best rows of other labels with ``least`` to 100 percent of the positive's score.
    """
    spark = df.sparkSession
    scaled = usable(df, key, label, vector).mapInArrow(lambda b: _scaled(b, scale), "vec_id long, label long, vec binary")
    scaled = materialize(scaled, "scaled-vectors")
    counts = scaled.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    order = F.pmod(F.xxhash64("vec", F.lit(4)), F.lit(1_000_000))
    sample = scaled.where(order < 1_000_000 * min(1.0, SAMPLE / max(counts["rows"], 1))).select("vec").distinct().toPandas()["vec"]
    directions = spark.sparkContext.broadcast(references(_matrix(sorted(sample))))
    fields = "vec_id long, label long, vec binary, norm double, angles binary"
    rows = materialize(scaled.mapInArrow(lambda b: _measured(b, directions.value), fields), "measured-vectors")
    grid = Grid(rows, counts["rows"], counts["anchors"], block_rows, block_anchors)
    anchors = rows.where(F.col("vec_id") % every == 0)
    positives = _ranked(grid.meet(anchors, lambda a, r: _positives(a, r, k), POSITIVES), ["anchor_id"], k)
    wanted = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    with_windows = materialize(anchors.join(wanted, "vec_id"), "anchor-windows")
    negatives = grid.meet(with_windows, lambda a, r: _negatives(a, r, k, least), NEGATIVES)
    return _ranked(negatives, ["anchor_id", "positive_id", "positive_score"], k).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
