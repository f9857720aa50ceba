"""Benchmark passages in documents by greedy string tiling.

Words are runs of letters and digits, A-Z folded. Seeds are runs of five words, hashed by
a rolling sum; a stretch of seeds that also occur in the benchmark is looked up once
however many documents hold it. For each document and item the longest common run of unmarked
words is marked, again and again, until no run of five is left; the share of the item's
words that is marked counts, so passages cut up and put in another order are found too.

A document that covers enough of an item matches so many of its seeds that at least one is among
the item's rarest in the documents. Only such pairs are tiled, so a phrase that many documents and
items share makes no pairs by itself; nothing is lost by it.

Defined cases: NULL and empty texts match nothing; the one seed of a text or item of one to four words is its
whole word sequence, so it matches only a text that consists of the same words;
rows with equal doc_id (item_id) count as one document (item): their different texts lie far apart in it, told
apart by 30 bits of a hash, and equal ones lie on each other; repeated passages are
marked as often as the item has words for them; NULL ids are left out; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.words import PUNCTUATION, find_words, hash_words, mix, slices, text_bytes, windows
from tuneprep.operators.ordering import with_running_total
from tuneprep.storage import materialize

SEED_WORDS = 5
COVERAGE = 0.5
FILTER_BITS = 24
FILTER_PIECES = 256
TEXT_BITS = 32


def _seeds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = text_bytes(column)
    starts, ends, first = find_words(data, bounds, PUNCTUATION)
    words = hash_words(data, starts, ends, lower=True, seed=5)
    seeds = [windows(words, first, SEED_WORDS)]
    for n in range(1, SEED_WORDS):  # texts of so many words
        begins = first[:-1][np.diff(first) == n]
        if len(begins):
            hashes, at = windows(words, first, n)
            whole = np.isin(at, begins)
            seeds.append((mix(hashes[whole] ^ np.uint64(n)), at[whole]))
    hashes, at = (np.concatenate(parts) for parts in zip(*seeds, strict=True))
    order = np.argsort(at, kind="stable")
    return hashes[order], at[order], first


def _text_starts(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """For ascending row numbers, where each row's text begins among all texts of its id."""
    own, back = np.unique(rows, return_inverse=True)
    texts = column.take(pa.array(own)).to_pylist()
    tags = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") >> 2 for t in texts]
    return (np.array(tags, np.int64) << TEXT_BITS)[back]


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, "text"):
            hashes, at, first = _seeds(cut.column("text"))
            row = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "seed": hashes.view(np.int64),
                    "item_id": cut.column("item_id").take(pa.array(row)),
                    "item_at": at - first[row] + _text_starts(cut.column("text"), row),
                    "text_words": np.diff(first)[row],
                    "place": _places(hashes),
                }
            )


def _bits(rows: pd.DataFrame) -> pd.DataFrame:
    piece = int(rows["piece"].iloc[0])
    width = (1 << FILTER_BITS) // FILTER_PIECES
    bits = np.zeros(width, np.uint8)
    bits[rows["place"].to_numpy() - piece * width] = 1
    return pd.DataFrame({"piece": [piece], "bits": [np.packbits(bits).tobytes()]})


def _filter(seeds: DataFrame) -> np.ndarray:
    """Which hash places the benchmark uses: a bitmap of fixed size (2 MB), whatever the benchmark's size."""
    width = (1 << FILTER_BITS) // FILTER_PIECES
    places = seeds.select("place", F.expr(f"place div {width}").alias("piece")).distinct()
    bitmap = np.zeros((FILTER_PIECES, width // 8), np.uint8)
    packed = places.groupBy("piece").applyInPandas(_bits, "piece long, bits binary").toPandas()
    for piece, bits in zip(packed["piece"], packed["bits"], strict=True):
        bitmap[piece] = np.frombuffer(bits, np.uint8)
    return np.unpackbits(bitmap.ravel()).astype(bool)


def _stretches(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive windows that the filter lets through: doc_id, place in the document, hash of the run, its seeds."""
    for batch in batches:
        for cut in slices(batch, "text"):
            hashes, at, first = _seeds(cut.column("text"))
            hit = np.flatnonzero(known[_places(hashes)])
            if not len(hit):
                continue
            at, hashes = at[hit], hashes[hit]
            row = np.searchsorted(first, at, "right") - 1
            cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
            begins, stops = np.append(0, cuts), np.append(cuts, len(at))
            runs = [hashes[a:b].tobytes() for a, b in zip(begins, stops, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": cut.column("doc_id").take(pa.array(row[begins])),
                    "doc_at": at[begins] - first[row[begins]] + _text_starts(cut.column("text"), row[begins]),
                    "seeds": pa.array(runs, pa.binary()),
                }
            )


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            seeds = np.frombuffer(batch.column("seeds")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "run": pa.array([batch.column("run")[i].as_py()] * len(seeds)),
                    "copies": np.full(len(seeds), batch.column("copies")[i].as_py()),
                    "run_at": np.arange(len(seeds)),
                    "seed": seeds,
                }
            )


def tile(matches: np.ndarray, item_words: int) -> tuple[int, int]:
    """Greedy tiling of (place in document, place in item) seed matches: marked item words, number of tiles.

    A third column may give the words of a seed, fewer than ``SEED_WORDS`` for a text that is shorter.
    """
    matches = np.unique(matches, axis=0)
    if matches.shape[1] == 2:
        matches = np.column_stack([matches, np.full(len(matches), SEED_WORDS)])
    covered, tiles = 0, 0
    while len(matches):
        diagonal = matches[:, 0] - matches[:, 1]
        order = np.lexsort((matches[:, 1], diagonal))
        at, diagonal = matches[order], diagonal[order]
        cuts = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(at[:, 1]) != 1)) + 1
        begins, stops = np.append(0, cuts), np.append(cuts, len(at))
        longest = np.lexsort((at[begins, 0], at[begins, 1], begins - stops))[0]
        doc, item, seed = at[begins[longest]]
        length = stops[longest] - begins[longest] + seed - 1
        covered, tiles = covered + length, tiles + 1
        free_doc = (at[:, 0] + SEED_WORDS <= doc) | (at[:, 0] >= doc + length)
        free_item = (at[:, 1] + SEED_WORDS <= item) | (at[:, 1] >= item + length)
        matches = at[free_doc & free_item]
    return min(int(covered), item_words), tiles


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = batch.column("places")
        runs = places.flatten()
        matches = runs.field("matches")
        sizes = pc.list_value_length(matches).to_numpy()
        flat = matches.flatten()
        at = [flat.field(name).to_numpy() for name in ("run_at", "item_at", "seed_words")]
        pairs = np.column_stack([np.repeat(runs.field("doc_at").to_numpy(), sizes) + at[0], at[1], at[2]])
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(pc.list_value_length(places).to_numpy()))]
        words = batch.column("item_words").to_pylist()
        found = [tile(pairs[a:b], n) for a, b, n in zip(ends[:-1], ends[1:], words, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("item_id"),
                batch.column("item_words"),
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
            ],
            ["doc_id", "item_id", "item_words", "covered", "tiles"],
        )


def _item_words(seeds: DataFrame) -> DataFrame:
    """(item_id, item_words): words of all different texts of an item."""
    texts = seeds.select("item_id", F.shiftright("item_at", TEXT_BITS).alias("text"), "text_words").distinct()
    return texts.groupBy("item_id").agg(F.sum("text_words").alias("item_words"))


def _rare_seeds(seeds: DataFrame, items: DataFrame, unrolled: DataFrame, coverage: float) -> DataFrame:
    """(seed, item_id): the rarest seeds of each item, of which every document that covers enough of it has one.

    A matched place covers at most ``SEED_WORDS`` words. So of an item's S places such a document matches
    at least c = coverage * words / SEED_WORDS, and one of any S - c + 1.
    """
    copies = unrolled.groupBy("seed").agg(F.sum("copies").alias("copies"))
    places = seeds.select("item_id", "seed", "item_at").distinct().join(copies, "seed", "left")
    places = places.withColumn("copies", F.coalesce("copies", F.lit(0)))
    ranked = with_running_total(places, ["copies", "seed", "item_at"], group_by=["item_id"], before="rank", total="places")
    least = F.greatest(F.ceil(F.col("item_words") * F.lit(coverage / SEED_WORDS) - F.lit(1e-9)), F.lit(1))
    return ranked.join(items, "item_id").where(F.col("rank") <= F.col("places") - least).select("seed", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, item_words, covered, tiles, coverage).

    Text is scanned once and never shuffled. What leaves the scan are stretches of seeds
    that pass a bitmap of the benchmark's seeds. Each distinct stretch is joined with the
    benchmark once, and its matches go back to the documents by the stretch's hash.
    """
    kinds = dict(docs.dtypes), dict(benchmark.dtypes)
    seeds = materialize(
        benchmark.select("item_id", "text")
        .where(F.col("item_id").isNotNull())
        .mapInArrow(
            _item_seeds,
            f"seed long, item_id {kinds[1]['item_id']}, item_at long, text_words long, place long",
        ),
        "benchmark-seeds",
    )
    known = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    hits = materialize(
        docs.select("doc_id", "text")
        .where(F.col("doc_id").isNotNull())
        .mapInArrow(
            lambda rows: _stretches(rows, known.value), f"doc_id {kinds[0]['doc_id']}, doc_at long, seeds binary"
        )
        .withColumn("run", F.sha2("seeds", 256)),
        "benchmark-hits",
    )
    runs = hits.groupBy("run").agg(F.first("seeds").alias("seeds"), F.count(F.lit(1)).alias("copies"))
    unrolled = materialize(
        runs.mapInArrow(_unroll, "run string, copies long, run_at long, seed long"), "benchmark-runs"
    )
    items = materialize(_item_words(seeds), "benchmark-items")
    rare = _rare_seeds(seeds, items, unrolled, coverage)
    candidates = (
        hits.select("doc_id", "run")
        .distinct()
        .join(unrolled.select("run", "seed").join(rare, "seed").select("run", "item_id").distinct(), "run")
        .select("doc_id", "item_id")
        .distinct()
    )
    match = F.struct("run_at", "item_at", F.least("text_words", F.lit(SEED_WORDS)).cast("long").alias("seed_words"))
    matches = unrolled.join(seeds.drop("place"), "seed").groupBy("run", "item_id").agg(F.collect_list(match).alias("matches"))
    pairs = (
        candidates.join(hits.select("doc_id", "doc_at", "run"), "doc_id")
        .join(matches, ["run", "item_id"])
        .groupBy("doc_id", "item_id")
        .agg(F.collect_list(F.struct("doc_at", "matches")).alias("places"))
        .join(items, "item_id")
    )
    schema = f"doc_id {kinds[0]['doc_id']}, item_id {kinds[1]['item_id']}, item_words long, covered long, tiles long"
    tiled = pairs.mapInArrow(_tiles, schema).withColumn("coverage", F.col("covered") / F.col("item_words"))
    return tiled.where(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; NULL ids stay."""
    found = contaminated(docs, benchmark, coverage).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
