"""Importance resampling of documents towards a target text, on hashed word n-grams of whole texts.

Texts are cut into segments at line ends, and a segment is its words in lower case. Features that lie
inside one segment are counted once for every different segment and multiplied by how often it occurs;
features that cross line ends are added for each text. The same split gives a text's weight: the
weights of its segments, computed once for every different one, and of what crosses its line ends.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered. A feature is a run of
one to three words joined by a space; its bucket is its CRC-32 modulo ``BUCKETS``.

Defined cases: a text that is NULL, empty or without words has no features and weight 0; rows of one
doc_id are documents of their own, equal rows get equal weights and ranks that follow each other;
rows without doc_id have no score and are not drawn, nor counted for the number of draws; an empty target
has no features, all gains come from the corpus; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.words import LOWER, PUNCTUATION, find_words, slices, text_bytes
from tuneprep.operators.ordering import with_running_total
from tuneprep.storage import materialize

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
SLICE_BYTES = 1 << 20
SHORT = 64  # bytes that one step of a CRC over zeros covers

# Bytes as words are cut: lower case, separators as spaces, line ends kept.
FOLD = bytes(10 if b == 10 else 32 if PUNCTUATION[b] else int(LOWER[b]) for b in range(256))

# A run of bytes moves the CRC register by a map that is linear over bits, so the CRC of a
# feature follows from those of its words: move one on by the length of the next, then add that.


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """What each value of the lowest byte adds to a CRC-32 register that moves one byte on."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


@lru_cache(maxsize=1)
def _zeros_tables() -> np.ndarray:
    """[n, byte, value]: where a register byte goes when ``n`` zero bytes follow."""
    step, tables = _byte_table(), np.zeros((SHORT + 1, 4, 256), np.uint32)
    for byte in range(4):
        tables[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(SHORT):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ step[tables[n] & np.uint32(255)]
    return tables


def _append_zeros(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The registers after as many zero bytes as given."""
    crc, left, tables = crc.copy(), lengths.copy(), _zeros_tables()
    at = np.arange(len(crc))
    while len(at):
        n, x = np.minimum(left[at], SHORT), crc[at]
        crc[at] = tables[n, 0, x & 255] ^ tables[n, 1, x >> 8 & 255] ^ tables[n, 2, x >> 16 & 255] ^ tables[n, 3, x >> 24]
        left[at] -= n
        at = at[left[at] > 0]
    return crc


def _word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of a space and the word."""
    step, lengths = _byte_table(), ends - starts
    alone = np.full(len(starts), 0xFFFFFFFF, np.uint32)  # the register, before its bits are turned
    after = np.full(len(starts), 0x00FFFFFF ^ step[0xFF ^ 32], np.uint32)
    order = np.argsort(-lengths, kind="stable")
    counts = np.searchsorted(-lengths[order], -np.arange(1, min(int(lengths.max(initial=0)), SHORT) + 1), "right")
    for i, n in enumerate(counts.tolist()):  # byte by byte through all words at once
        at = order[:n]
        letter = data[starts[at] + i].astype(np.uint32)
        for register in (alone, after):
            x = register[at]
            register[at] = (x >> np.uint32(8)) ^ step[(x ^ letter) & np.uint32(255)]
    alone, after = ~alone, ~after
    for i in np.flatnonzero(lengths > SHORT).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        alone[i] = zlib.crc32(word)
        after[i] = zlib.crc32(b" " + word)
    return alone, after


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all features of each text, which must be in lower case."""
    data, bounds = text_bytes(texts)
    starts, ends, first = find_words(data, bounds, PUNCTUATION)
    rows, lengths = np.repeat(np.arange(len(texts)), np.diff(first)), ends - starts
    crc, after = _word_crcs(data, starts, ends)
    found = []
    for width in range(1, LONGEST + 1):
        last = np.arange(width - 1, len(starts))  # where a feature that starts width - 1 words before ends
        if width > 1:
            crc = _append_zeros(crc[: len(last)], lengths[last] + 1) ^ after[last]
        inside = rows[: len(last)] == rows[last]
        found.append((rows[last][inside], crc[: len(last)][inside] % np.uint32(buckets)))
    return np.concatenate([r for r, _ in found]), np.concatenate([b for _, b in found])


def segments_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of each line that has any."""
    for line in (text or "").encode().translate(FOLD).split(b"\n"):
        words = line.split()
        if words:
            yield words


class Crossing:
    """Features of one text that reach over line ends, found from two words on each side."""

    def __init__(self, text: str | None, buckets: int):
        self.buckets, self.words, before = [], 0, []
        for words in segments_of(text):
            after = words[: LONGEST - 1]
            for left in range(1, len(before) + 1):
                for right in range(1, min(len(after), LONGEST - left) + 1):
                    self.buckets.append(zlib.crc32(b" ".join(before[-left:] + after[:right])) % buckets)
            before = (before + words if len(words) < LONGEST - 1 else words)[1 - LONGEST :]
            self.words += len(words)


def _by_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, SLICE_BYTES)


def _key(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def _count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different segments of each slice and how often they occur in it."""
    for cut in _by_slices(batches):
        counts: dict[bytes, int] = {}
        for text in cut.column("text"):
            for words in segments_of(text.as_py()):
                segment = b" ".join(words)
                counts[segment] = counts.get(segment, 0) + 1
        found = pa.array(list(counts), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([found, pa.array(list(counts.values()), pa.int64())], ["segment", "n"])


def _bucket_rows(totals: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(totals)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(totals[at], pa.int64())})


def _count_crossing(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(buckets, np.int64)
    for cut in _by_slices(batches):
        for text in cut.column("text"):
            np.add.at(totals, Crossing(text.as_py(), buckets).buckets, 1)
    yield _bucket_rows(totals)


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _segment_buckets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The buckets of each segment's features, computed once."""
    for cut in _by_slices(batches, "segment"):
        rows, found = feature_buckets(cut.column("segment"), buckets)
        order = np.argsort(rows, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=cut.num_rows))])
        ordered = found[order].astype(_width(buckets))
        lists = [ordered[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        keys = [_key(segment.encode()) for segment in cut.column("segment").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), cut.column("n"), pa.array(lists, pa.binary())], ["key", "n", "features"])


def _count_features(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(buckets, np.int64)
    for batch in batches:
        sizes = pc.binary_length(batch.column("features")).to_numpy() // np.dtype(_width(buckets)).itemsize
        found = np.frombuffer(b"".join(batch.column("features").to_pylist()), _width(buckets))
        times = np.repeat(batch.column("n").to_numpy(), sizes)
        for n in np.unique(times):  # most segments occur once
            totals += n * np.bincount(found[times == n], minlength=buckets)
    yield _bucket_rows(totals)


def distinct_segments(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, n, features): every different segment, its occurrences, and its features' buckets; written."""
    counted = docs.select("text").mapInArrow(_count_segments, "segment string, n long")
    segments = counted.groupBy("segment").agg(F.sum("n").alias("n"))
    return materialize(
        segments.mapInArrow(lambda b: _segment_buckets(b, buckets), "key binary, n long, features binary"), "segments"
    )


def bucket_counts(docs: DataFrame, segments: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: those of segments times occurrences, and the crossing ones."""
    inside = segments.select("n", "features").mapInArrow(lambda b: _count_features(b, buckets), "bucket int, n long")
    across = docs.select("text").mapInArrow(lambda b: _count_crossing(b, buckets), "bucket int, n long")
    totals = np.zeros(buckets, np.int64)
    for bucket, n in inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        totals[bucket] = n
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of target to source, smoothed by one, in thousandths, rounded down."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh_segments(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = [int(gain[np.frombuffer(f.as_buffer(), _width(len(gain)))].sum()) for f in batch.column("features")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(weights, pa.int64())], ["key", "segment_weight"])


def _weigh_crossing(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each text's numbers of words and features, and the weight of what crosses its line ends."""
    for cut in _by_slices(batches):
        rows = []
        for doc_id, text in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist(), strict=True):
            found = Crossing(text, len(gain))
            features = sum(max(found.words - width, 0) for width in range(LONGEST))
            crossing = int(gain[found.buckets].sum()) if found.buckets else 0
            rows.append({"doc_id": doc_id, "digest": _key((text or "").encode()), "words": found.words, "features": features, "crossing": crossing})
        yield pa.RecordBatch.from_pylist(rows, DOCUMENT)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each different segment of a slice occurs: a frequent one is one row a slice, not one a line."""
    for cut in _by_slices(batches):
        places: dict[bytes, dict] = {}
        for doc_id, text in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist(), strict=True):
            document = (doc_id, _key((text or "").encode()))
            for words in segments_of(text):
                own = places.setdefault(_key(b" ".join(words)), {})
                own[document] = own.get(document, 0) + 1
        where = [[{"doc_id": doc_id, "digest": digest, "times": n} for (doc_id, digest), n in own.items()] for own in places.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.binary()), pa.array(where, PLACES)], ["key", "places"])


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()), ("features", pa.int64()), ("crossing", pa.int64())])
PLACES = pa.list_(pa.struct([("doc_id", pa.int64()), ("digest", pa.binary()), ("times", pa.int64())]))


def weights(docs: DataFrame, segments: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, digest, copies, words, n_features, weight): equal rows as one, with how many they are."""
    gain = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    known = segments.select("key", "features").mapInArrow(lambda b: _weigh_segments(b, gain.value), "key binary, segment_weight long")
    places = docs.mapInArrow(_places, "key binary, places array<struct<doc_id: long, digest: binary, times: long>>")
    inside = (
        places.join(known, "key")
        .select(F.inline("places"), "segment_weight")
        .groupBy("doc_id", "digest")
        .agg(F.sum(F.col("times") * F.col("segment_weight")).alias("inside"))
    )
    fields = "doc_id long, digest binary, words long, features long, crossing long"
    rows = docs.mapInArrow(lambda b: _weigh_crossing(b, gain.value), fields).groupBy("doc_id", "digest", "words", "features", "crossing")
    rows = rows.agg(F.count(F.lit(1)).alias("copies"))
    same = rows["doc_id"].eqNullSafe(inside["doc_id"]) & (rows["digest"] == inside["digest"])
    # Segments of equal rows have been added up over all of them.
    weight = F.col("crossing") + F.coalesce(F.expr("inside div copies"), F.lit(0))
    return rows.join(inside, same, "left").select(
        rows["doc_id"], rows["digest"], "copies", "words", F.col("features").alias("n_features"), weight.alias("weight")
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A fixed Gumbel draw of each id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: the highest scores get ranks, as many as
    ``percent`` of the documents with enough words. Only keys are put in order, range by range."""
    scored = materialize(scored, "scored")
    able = F.coalesce((F.col("words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    able_rows = scored.where(able).withColumn("falling", -F.col("score"))
    placed = with_running_total(able_rows, ["falling", "doc_id", "digest"], F.col("copies"), before="before", total="all")
    ranks = F.when(F.col("at") < F.expr(f"{percent} * all div 100"), F.col("at") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    counted = placed.select(*columns, "all", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("at"))
    others = scored.where(~able).select(*columns, F.explode(F.array_repeat(F.lit(None).cast("long"), F.col("copies").cast("int"))).alias("rank"))
    return counted.select(*columns, ranks.alias("rank")).unionByName(others)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (NULL: not drawn)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = target.select("text")
    segments = distinct_segments(docs, buckets)
    wanted = bucket_counts(target, distinct_segments(target, buckets), buckets)
    gain = gains(bucket_counts(docs, segments, buckets), wanted)
    scored = weights(docs, segments, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(scored, percent)
