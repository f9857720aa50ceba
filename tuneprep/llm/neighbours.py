"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph, which is cut into parts of equal size with
few edges between them; a small classifier learns which parts a vector's neighbours are in.
Every vector is indexed under its most probable part; a query looks into as many of its most
probable parts as the sample needed for the wanted recall, and ranks what it finds by the
exact cosine. Parts are split into blocks of bounded size, and so are a part's queries, so a
crowded part is many tasks. Equal vectors are indexed once, with their smallest ids: as many
as an answer can use.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, nor
do those of another length than the most frequent one; rows with NULL vec_id are left out; repeated
rows of one vec_id and vector count once; equal scores go to the smaller vec_id; with fewer
candidates than ``k`` all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.storage import materialize

SAMPLE = 8_192
PART_ROWS, MOST_PARTS = 1_024, 256
GRAPH_NEIGHBOURS, HIDDEN, EPOCHS = 12, 96, 24
RECALL, TRIAL_QUERIES = 0.98, 512
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


def clean_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec): usable vectors as 64-bit floats in bytes, -0.0 as 0.0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = df.where(F.col(key).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0))
    usable = usable.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    common = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = common["n"] if common else 0

    @F.arrow_udf("binary")
    def to_bytes(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False) + 0.0
        rows = np.ascontiguousarray(flat.reshape(len(vectors), -1 if len(vectors) else 1))
        return pa.array([row.tobytes() for row in rows], pa.binary())

    return usable.where(F.size("v") == width).select("vec_id", to_bytes("v").alias("vec"))


def _distinct(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids: dict[bytes, set] = {}
        for vec_id, vec in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
            ids.setdefault(vec, set()).add(vec_id)
        smallest = [sorted(v)[:keep] for v in ids.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(smallest, pa.list_(pa.int64()))], ["vec", "ids"])


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): every different vector with its ``keep`` smallest ids; combined before the shuffle."""
    part = vectors.mapInArrow(lambda b: _distinct(b, keep), "vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return part.groupBy("vec").agg(ids.alias("ids"))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's ``k`` nearest other rows."""
    found = np.empty((len(unit), k), np.int64)
    for a in range(0, len(unit), 512):
        near = unit[a : a + 512] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1)
        found[a : a + 512] = np.take_along_axis(top, order, 1)
    return found


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Parts of equal size with few graph edges between them.

    Starts from median cuts along main directions; then every node wishes for the part that
    most of its neighbours are in, and the strongest wishes are granted while there is room.
    """
    label = np.zeros(len(unit), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            at = np.flatnonzero(label == p)
            if len(at) > 1:
                rows = unit[at] - unit[at].mean(axis=0)
                direction = np.linalg.eigh(rows.T @ rows)[1][:, -1]
                order = np.argsort(rows @ direction, kind="stable")
                label[at[order[len(at) // 2 :]]] += 1 << level
    room = int(np.ceil(1.05 * len(unit) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(unit), parts), np.float32)
        for j in range(graph.shape[1]):
            np.add.at(votes, (graph[:, j], label), 0.5)
            votes[np.arange(len(unit)), label[graph[:, j]]] += 1
        votes[np.arange(len(unit)), label] += 0.1
        new, filled = np.full(len(unit), -1), np.zeros(parts, np.int64)
        for _ in range(parts):
            free = np.flatnonzero(new < 0)
            if not len(free):
                break
            wish = np.where(filled < room, votes[free], -1).argmax(axis=1)
            order = np.lexsort((free, -votes[free, wish], wish))
            rank = np.arange(len(free)) - np.searchsorted(wish[order], wish[order], "left")
            granted = order[rank < (room - filled)[wish[order]]]
            new[free[granted]] = wish[granted]
            filled += np.bincount(wish[granted], minlength=parts)
        if (new == label).all():
            break
        label = new
    return label


@dataclass
class Router:
    """A one-hidden-layer classifier of parts, and how many parts a query looks into."""

    layers: list[np.ndarray]
    parts: int
    probes: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(rows), 1))
        w1, b1, w2, b2 = self.layers
        return np.maximum(_unit(rows) @ w1 + b1, 0) @ w2 + b2


def _train(unit: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Cross-entropy against the parts of each row's neighbours, by Adam."""
    rng = np.random.default_rng(2)
    d, parts = unit.shape[1], target.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)) * np.sqrt(d), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(unit))
        for a in range(0, len(unit), 256):
            at = order[a : a + 256]
            x, step = unit[at], step + 1
            hidden = np.maximum(x @ layers[0] + layers[1], 0)
            out = hidden @ layers[2] + layers[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - target[at]) / len(at)
            back = (error @ layers[2].T) * (hidden > 0)
            rate = 0.01 * (1 - epoch / EPOCHS)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def learn_router(sample: np.ndarray, rows: int, k: int) -> Router:
    """Fit parts and classifier on sampled vectors for an index of ``rows`` vectors."""
    parts = 1
    while parts < MOST_PARTS and parts * PART_ROWS * 2 <= rows and parts * 32 <= len(sample):
        parts *= 2
    if parts == 1:
        return Router([], 1, 1)
    unit = _unit(sample)
    graph = neighbour_graph(unit, GRAPH_NEIGHBOURS)
    label = balanced_parts(unit, graph, parts)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.arange(len(unit)), label), 4.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(unit)), label[graph[:, j]]), 1.0)
    router = Router(_train(unit, target / target.sum(axis=1, keepdims=True)), parts, parts)
    scores = router.scores(sample)
    home = scores.argmax(axis=1)
    rank = np.argsort(np.argsort(-scores[:TRIAL_QUERIES], axis=1), axis=1)
    needed = np.take_along_axis(rank, home[graph[:TRIAL_QUERIES, :k]], axis=1).ravel()
    router.probes = int(np.sort(needed)[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1
    return router


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1 if len(vecs) else 1)


def _rows(column: pa.Array) -> np.ndarray:
    return _matrix(column.to_pylist())


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` nearest of one block's rows for one block of queries."""
    out: list[tuple] = []
    if len(queries) and len(rows):
        r, q = _matrix(rows["vec"].tolist()), _matrix(queries["vec"].tolist())
        r_max, q_max = np.abs(r).max(axis=1, keepdims=True), np.abs(q).max(axis=1, keepdims=True)
        r, q = r / r_max, q / q_max  # cosines don't change, and squares stay finite
        near = (q @ r.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(r, axis=1)
        least = np.partition(near, -min(keep, len(rows)), axis=1)[:, -min(keep, len(rows))]
        ids = rows["ids"].to_numpy()
        for i, vec in enumerate(queries["vec"]):
            found = np.flatnonzero(near[i] >= least[i])
            best = sorted((-near[i, j], int(v)) for j in found for v in ids[j])[:keep]
            out += [(vec, v, -s) for s, v in best]
    return pd.DataFrame(out, columns=["vec", "vec_id", "score"])


def search(
    df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest others; queries are ids divisible by ``every``."""
    spark = df.sparkSession
    vectors = materialize(clean_vectors(df, key, vector), "vectors")
    index = materialize(distinct_vectors(vectors, k + 1), "distinct-vectors")
    n = index.count()
    order = F.pmod(F.xxhash64("vec", F.lit(2)), F.lit(1_000_000))
    chosen = index.where(order < 1_000_000 * min(1.0, SAMPLE / max(n, 1))).select("vec").toPandas()["vec"]
    sample = _matrix(sorted(chosen))
    sample = sample[np.random.default_rng(2).permutation(len(sample))]
    router = spark.sparkContext.broadcast(learn_router(sample, n, k))

    @F.arrow_udf("int")
    def home(vecs: pa.Array) -> pa.Array:
        return pa.array(router.value.scores(_rows(vecs)).argmax(axis=1).astype(np.int32))

    @F.arrow_udf("array<int>")
    def routes(vecs: pa.Array) -> pa.Array:
        scores, probes = router.value.scores(_rows(vecs)), router.value.probes
        best = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.array(list(best), pa.list_(pa.int32()))

    queries = vectors.where(F.col("vec_id") % every == 0)
    rows = materialize(index.withColumn("part", home("vec")), "indexed-vectors")
    asked = materialize(
        queries.select("vec").distinct().withColumn("part", F.explode(routes("vec"))), "routed-queries"
    )
    # One row for each part: how many blocks its rows and its queries are cut into.
    blocks = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    chunks = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("chunks"))
    grid = F.broadcast(blocks.join(chunks, "part"))

    def cut(frame: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec", F.lit(3)), F.col(own + "s")).cast("int")
        every_other = F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))
        return frame.join(grid, "part").withColumn(own, mine).withColumn(other, every_other).drop("blocks", "chunks")

    cell = ["part", "block", "chunk"]
    found = (
        cut(asked, "chunk", "block")
        .groupBy(*cell)
        .cogroup(cut(rows, "block", "chunk").groupBy(*cell))
        .applyInPandas(lambda q, r: _nearest(q, r, k + 1), "vec binary, vec_id long, score double")
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1)
    nearest = found.groupBy("vec").agg(best.alias("best"))
    answers = queries.select(F.col("vec_id").alias("query_id"), "vec").distinct().join(nearest, "vec")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score")
    )
