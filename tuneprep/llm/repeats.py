"""Removing word windows that an earlier document has, through a de Bruijn graph of the corpus.

An edge of the graph is a window of ``width`` words. Edges are hashed and dealt to buckets; a bucket
finds the edges of several documents, and for each the document with the smallest doc_id that has it. Back at
the texts, edges that follow each other both here and in that source are compacted into
one path, so a copied span is one row whatever its length. Each path is then joined with its
source's coordinates and verified by an independent hash of all its words; only verified
paths are cut out.

Texts are written once into chunk files of a few MB, sorted by doc_id, and read from there. An edge
leaves a chunk once, however often the chunk repeats it, as 7 bytes and the buckets' share of
the hash. So a passage that a third of all documents hold is one edge per chunk.

Defined cases: a NULL text has no words; rows of equal doc_id never remove each other's words; rows with
NULL doc_id are neither earlier nor later than others and stay whole; fewer words than a window
stay; very long texts fill a chunk of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.files import new_file, open_file
from tuneprep.llm.words import STEP, find_words, hash_words, powers, slices, text_bytes, windows
from tuneprep.storage import materialize, scratch_path

WIDTH = 13
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
EDGE_BYTES = 7
PATHS = 50_000
MANIFEST = "chunk long, path string, docs long, bytes long"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of differences, which repeat in runs, in little space."""
    raw = b"".join(np.diff(a, prepend=a.dtype.type(0)).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.cumsum(np.frombuffer(raw, kind, n, at), dtype=kind))
        at += n * np.dtype(kind).itemsize
    return out


def _write_chunks(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    attempt = TaskContext.get().taskAttemptId()

    def store() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows.column("doc_id"))).combine_chunks()
        path = f"{out}/chunk-{part:06d}-{number:06d}-{attempt}.arrow"
        with new_file(path) as stream:
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_file(stream, rows.schema, options=options) as writer:
                writer.write_table(rows)
        return pa.RecordBatch.from_pydict(
            {"chunk": [(part << 32) | number], "path": [path], "docs": [len(rows)], "bytes": [int(size)]}
        )

    for batch in batches:
        for cut in slices(batch, "text", CHUNK_BYTES // 2):
            held.append(cut)
            size += int(pc.sum(pc.binary_length(cut.column("text"))).as_py() or 0)
            if size >= CHUNK_BYTES - CHUNK_BYTES // 4:
                yield store()
                number, held, size = number + 1, [], 0
    if held:
        yield store()


class Chunk:
    """The texts of one chunk file and the places of their words."""

    def __init__(self, path: str):
        with open_file(path) as source, pa.ipc.open_file(source) as reader:
            rows = reader.read_all().combine_chunks()
        self.doc_id = rows.column("doc_id").to_numpy()
        self.text = rows.column("text").combine_chunks()
        if isinstance(self.text, pa.ChunkedArray):
            self.text = pa.concat_arrays(self.text.chunks)
        self.data, bounds = text_bytes(self.text)
        self.starts, self.ends, self.first = find_words(self.data, bounds)

    def edges(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and word of every window, and each row's first window."""
        hashes, at = windows(hash_words(self.data, self.starts, self.ends, seed=9), self.first, width)
        row = np.searchsorted(self.first, at, "right") - 1
        return hashes, row, at - self.first[row], np.searchsorted(at, self.first)

    def signatures(self, row: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
        """An independent hash of each span's words."""
        own = hash_words(self.data, self.starts, self.ends, seed=90)
        up, down = _scales(1 << max(10, len(own).bit_length()))
        total = np.append(np.uint64(0), np.cumsum(own * up[: len(own)], dtype=np.uint64))
        begin = self.first[row] + start
        inside = (start >= 0) & (begin + words <= self.first[np.minimum(row + 1, len(self.first) - 1)])
        begin = np.where(inside, begin, 0)
        end = np.where(inside, begin + words, 0)
        return (total[end] - total[begin]) * down[begin] + words.astype(np.uint64)


@lru_cache(maxsize=2)
def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n), powers(n, pow(STEP, -1, 1 << 64))


def _first_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different hash comes first, in order; and for every hash its first place."""
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return np.sort(index), index[inverse]


def _deal(batches: Iterator[pa.RecordBatch], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """(bucket, chunk, docs, counts, places, edges): a chunk's different edges, by bucket, in document order."""
    for batch in batches:
        for number, path in zip(batch.column("chunk").to_pylist(), batch.column("path").to_pylist(), strict=True):
            chunk = Chunk(path)
            hashes, row, place, _ = chunk.edges(width)
            first, _ = _first_places(hashes)
            hashes, row, place = hashes[first], row[first], place[first]
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            docs = _pack(chunk.doc_id)
            out: dict[str, list] = {"bucket": [], "chunk": [], "docs": [], "counts": [], "places": [], "edges": []}
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    short = (hashes[at] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)
                    counts = np.bincount(row[at], minlength=len(chunk.doc_id)).astype(np.int32)
                    values = (b, number, docs, _pack(counts), _pack(place[at].astype(np.int32)), short[:, :EDGE_BYTES].tobytes())
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema(BUCKETED))


BUCKETED = [("bucket", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("edges", pa.binary())]
FOUND = ("<i4", "<i4", "<i8", "<i4", "<i4")


def _find(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket's edges those that an earlier document has, per chunk: row, place, the source's chunk, row, place."""
    edge, doc, line, place = [], [], [], []
    sizes = []
    for docs, counts, places, edges in zip(rows["docs"], rows["counts"], rows["places"], rows["edges"], strict=True):
        (ids,), (n,), (at,) = _unpack(docs, "<i8"), _unpack(counts, "<i4"), _unpack(places, "<i4")
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, :EDGE_BYTES] = np.frombuffer(edges, np.uint8).reshape(-1, EDGE_BYTES)
        edge.append(wide.view("<u8").ravel())
        line.append(np.repeat(np.arange(len(n), dtype=np.int32), n))
        doc.append(np.repeat(ids, n))
        place.append(at)
        sizes.append(len(at))
    edge = np.concatenate(edge)
    order = np.argsort(edge)
    same = edge[order][1:] == edge[order][:-1]
    shared = order[np.append(same, False) | np.append(False, same)]
    if not len(shared):
        return pd.DataFrame({"chunk": [], "found": []})
    doc, line, place = np.concatenate(doc), np.concatenate(line), np.concatenate(place)
    source = np.repeat(np.arange(len(sizes)), sizes)  # which chunk
    shared = shared[np.lexsort((shared, doc[shared], edge[shared]))]
    head = np.append(True, edge[shared][1:] != edge[shared][:-1])
    best = shared[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later = doc[shared] > doc[best]
    own, best = shared[later], best[later]
    order = np.argsort(own)
    own, best = own[order], best[order]
    chunks, out = rows["chunk"].to_numpy(), {"chunk": [], "found": []}
    cuts = np.searchsorted(own, np.append(0, np.cumsum(sizes)))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            mine, theirs = own[a:b], best[a:b]
            out["chunk"].append(chunks[k])
            columns = (line[mine], place[mine], chunks[source[theirs]], line[theirs], place[theirs] - place[mine])
            out["found"].append(_pack(*(c.astype(kind) for c, kind in zip(columns, FOUND, strict=True))))
    return pd.DataFrame(out)


PATH = [("chunk", pa.int64()), ("row", pa.int32()), ("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_row", pa.int32()), ("source_start", pa.int32()), ("signature", pa.int64())]
PATH_SCHEMA = "chunk long, row int, start int, words int, source long, source_row int, source_start int, signature long"


def _paths(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Compact a chunk's repeated edges: runs that advance by one word both here and in their source."""
    for batch in batches:
        for number, path, found in zip(*(batch.column(c).to_pylist() for c in ("chunk", "path", "found")), strict=True):
            chunk = Chunk(path)
            hashes, row, place, first_edge = chunk.edges(width)
            n = len(hashes)
            if not n:
                continue
            source, source_row, source_at = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64)
            for packed in found or []:
                line, at, other, other_row, shift = _unpack(packed, *FOUND)
                mine = first_edge[line] + at
                source[mine], source_row[mine], source_at[mine] = other, other_row, at + shift.astype(np.int64)
            _, first = _first_places(hashes)
            # A repeat within the chunk has its first place's source, or that place itself if its document is earlier.
            outside = source[first] >= 0
            inside = ~outside & (chunk.doc_id[row] > chunk.doc_id[row[first]])
            source = np.where(outside, source[first], np.where(inside, number, -1))
            source_row = np.where(outside, source_row[first], row[first])
            source_at = np.where(outside, source_at[first], place[first])
            follows = np.zeros(n, bool)
            follows[1:] = (
                (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (source_row[1:] == source_row[:-1])
                & (source_at[1:] == source_at[:-1] + 1)
            )
            known = source >= 0
            begins = np.flatnonzero(known & ~(follows & np.append(False, known[:-1])))
            if not len(begins):
                continue
            ends = np.flatnonzero(known & ~np.append(follows[1:] & known[1:], False))
            words = ends - begins + width
            columns = (
                np.full(len(begins), number), row[begins], place[begins], words, source[begins], source_row[begins],
                source_at[begins], chunk.signatures(row[begins], place[begins], words).view(np.int64),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, pa.schema(PATH))], schema=pa.schema(PATH))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths whose words are those at the source's coordinates; rows come sorted by source."""
    at, chunk = None, None
    for batch in batches:
        sources = batch.column("source").to_numpy()
        cuts = np.flatnonzero(np.diff(sources)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(sources)), strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if at != sources[a]:
                at, chunk = sources[a], Chunk(part.column("path")[0].as_py())
            there = chunk.signatures(*(part.column(c).to_numpy().astype(np.int64) for c in ("source_row", "source_start", "words")))
            ok = there.view(np.int64) == part.column("signature").to_numpy()
            yield part.select(["chunk", "row", "start", "words"]).filter(pa.array(ok))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: words, removed words, and the hash of what is kept."""
    for batch in batches:
        for path, paths in zip(batch.column("path").to_pylist(), batch.column("paths").to_pylist(), strict=True):
            chunk = Chunk(path)
            change = np.zeros(len(chunk.starts) + 1, np.int32)
            for p in paths or []:
                begin = chunk.first[p["row"]] + p["start"]
                change[begin] += 1
                change[begin + p["words"]] -= 1
            kept = np.cumsum(change[:-1]) == 0
            total = np.append(0, np.cumsum(~kept))
            removed = total[chunk.first[1:]] - total[chunk.first[:-1]]
            digests = []
            for i, text in enumerate(chunk.text.to_pylist()):
                words = (text or "").encode().split()
                if removed[i]:
                    words = compress(words, kept[chunk.first[i] : chunk.first[i + 1]].tolist())
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": chunk.doc_id, "n_words": np.diff(chunk.first), "n_removed": removed, "kept_sha256": digests}
            )


def _unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(text or "").encode().split() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(words), pa.int64()),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([0] * len(words), pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_paths(manifest: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chunk, row, start, words): verified spans that an earlier document holds, as windows of ``width`` words or more."""
    chunks, total = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    chunks, total = max(chunks, 1), total or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    places = manifest.select("chunk", "path")
    # A row that names a chunk is short, but its task reads the chunk: about one chunk for a task.
    dealt = places.repartition(chunks, "chunk").mapInArrow(
        lambda b: _deal(b, buckets, width), "bucket int, chunk long, docs binary, counts binary, places binary, edges binary"
    )
    found = dealt.groupBy("bucket").applyInPandas(_find, "chunk long, found binary")
    of_chunk = found.groupBy("chunk").agg(F.collect_list("found").alias("found"))
    paths = materialize(
        places.join(of_chunk.hint("merge"), "chunk", "left")  # large, though derived from a short table
        .repartition(chunks, "chunk")
        .mapInArrow(lambda b: _paths(b, width), PATH_SCHEMA),
        "paths",
    )
    # A source that many paths name is read by as many tasks as it has tens of thousands of them.
    load = paths.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / PATHS).cast("int").alias("salts"))
    sources = materialize(load.join(places.withColumnRenamed("chunk", "source"), "source"), "sources")
    salt = F.pmod(F.xxhash64("chunk", "row", "start"), F.col("salts")).cast("int")
    asked = paths.join(sources, "source").withColumn("salt", salt).drop("salts")
    asked = asked.repartition(chunks, "source", "salt").sortWithinPartitions("source")
    return asked.mapInArrow(_verify, "chunk long, row int, start int, words int")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    out = scratch_path(docs.sparkSession, "chunks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = texts.where(F.col("doc_id").isNotNull())
    manifest = materialize(named.mapInArrow(lambda b: _write_chunks(b, out), MANIFEST), "chunk-manifest")
    spans = repeated_paths(manifest, width).groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "words")).alias("paths"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    joined = manifest.select("chunk", "path").join(spans.hint("merge"), "chunk", "left")
    result = joined.repartition(max(1, manifest.count()), "chunk").mapInArrow(_remove, schema)
    unnamed = texts.where(F.col("doc_id").isNull()).mapInArrow(_unnamed, schema)
    return result.unionByName(unnamed)
