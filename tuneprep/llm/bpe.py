"""Byte-level BPE of whole texts of any length by overlapping chunks, and back.

A text up to ``CHUNK`` characters is one chunk. A longer one is cut into chunks that overlap
their successors by ``OVERLAP`` characters; they are spread over the cluster and pre-tokenised
each from its own start. A match depends on nothing before it, so where a boundary of one chunk
is also one of the next, both go on alike: chunks are stitched at the first such boundary, and
each encodes the pieces between its two stitches. From the first pair of chunks that shares no
boundary on (a single piece fills the overlap), the rest of that text is pre-tokenised in order,
chunk by chunk, by one task, which holds the piece at hand.

Defined cases: a NULL or empty text has no ids; every row is encoded, repeated ones too, but a long
text is cut and encoded once for all its rows; NULL ids are kept; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm.words import slices
from tuneprep.storage import materialize

CHUNK, OVERLAP = 32_768, 512  # characters
PROBES = (r"\p{L}", r"\p{N}", r"\s")  # classes that regular expression engines may know differently
CACHED_PIECES = 300_000
SLICE_BYTES = 1 << 20
PARTS = "doc_id long, part int, ids array<int>"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Rules:
    """How to cut texts: a pattern, the same with all classes spelled out, the characters for which they
    differ, and the spelled form for texts in Latin-1 only, which the standard library matches faster.

    ``reach`` is how many characters past its end can decide a match.
    """

    ranks: str
    pattern: str
    exact: str
    differing: str
    latin: str
    reach: int = 3


def _ranges(points: np.ndarray) -> str:
    """Code points as the inside of a character class."""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = np.concatenate([points[:1], points[cuts + 1]]), np.concatenate([points[cuts], points[-1:]])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


def _spelled(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with its named classes as ranges, inside and outside of sets."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((name for name in classes if pattern.startswith(name, at)), None)
        if name is not None:
            out, step = out + (classes[name] if inside else f"[{classes[name]}]"), len(name)
        elif pattern.startswith(r"\S", at) and not inside:
            out, step = out + f"[^{classes[PROBES[-1]]}]", 2
        else:
            step = 2 if pattern[at] == "\\" else 1
            out += pattern[at : at + step]
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        at += step
    return out


def latin_pattern(pattern: str) -> str:
    """The pattern for texts of Latin-1 characters only, whose classes don't change between versions of Unicode."""
    named = {r"\p{L}": "L", r"\p{N}": "N"}
    classes = {name: _ranges(np.array([c for c in range(256) if unicodedata.category(chr(c))[0] == kind])) for name, kind in named.items()}
    return _spelled(pattern, classes | {r"\s": r"\t-\r \x85\xa0"})


def rules(ranks: str, pattern: str) -> Rules:
    """Compare Python's character classes with those of the tokenizer library over all characters."""
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = points.astype("<u4").tobytes().decode("utf-32-le")

    def matched(found: str) -> np.ndarray:
        return np.frombuffer(found.encode("utf-32-le"), "<u4").astype(np.int64)

    theirs = {}
    for name in PROBES:
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs[name] = matched(library.decode(library.encode_ordinary(text)))
    odd = np.unique(np.concatenate([np.setxor1d(theirs[name], matched("".join(regex.findall(name, text)))) for name in PROBES]))
    every = {name: _ranges(found) for name, found in theirs.items()}
    return Rules(ranks, pattern, _spelled(pattern, every), f"[{_ranges(odd)}]" if len(odd) else "", latin_pattern(pattern))


class Known(dict):
    """Ids of pieces met before; others are encoded when asked for."""

    def __init__(self, own: Codec):
        self.own = own

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.own.library.encode_ordinary(piece)).tobytes()
        self[piece] = ids
        return ids


class Codec:
    """Pieces of texts, their ids by merge ranks, and the bytes of ids."""

    def __init__(self, rule: Rules):
        import regex

        with open(rule.ranks, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.find = regex.compile(rule.pattern).findall
        self.find_latin = re.compile(rule.latin).findall
        self.find_exact = regex.compile(rule.exact).findall
        self.differs = regex.compile(rule.differing).search if rule.differing else lambda text: None
        self.reach = rule.reach
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.known = Known(self)

    @cached_property
    def library(self):
        """The tokenizer library with a pattern that cuts nothing: a piece is one match."""
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_exact(text) if self.differs(text) else self.find(text)
        return self.find_latin(text)

    def encode(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces, as little-endian 32-bit integers; a piece is encoded when it is first met."""
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known = self.known.__getitem__
        return [b"".join(map(known, row)) for row in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


_codecs: dict[Rules, Codec] = {}


def codec(rule: Rules) -> Codec:
    """One codec per Python worker."""
    if rule not in _codecs:
        _codecs[rule] = Codec(rule)
    return _codecs[rule]


def _id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def _id_rows(batch: pa.RecordBatch) -> Iterator[list[int]]:
    column = batch.column("ids")
    ids, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
        yield ids[a:b].tolist()


def _encode_short(batches: Iterator[pa.RecordBatch], rule: Rules) -> Iterator[pa.RecordBatch]:
    own = codec(rule)
    for batch in batches:
        for cut in slices(batch, "text", SLICE_BYTES):
            rows = own.encode([own.pieces(text) if text else [] for text in cut.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [cut.column("doc_id"), pa.array(np.zeros(len(rows), np.int32)), _id_lists(rows)], ["doc_id", "part", "ids"]
            )


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _short(docs: DataFrame, chunk: int) -> DataFrame:
    return _named(docs).where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)


def encode_short(docs: DataFrame, rule: Rules, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, part, ids) of the texts that are one chunk; nothing is shuffled."""
    return _short(docs, chunk).mapInArrow(lambda batches: _encode_short(batches, rule), PARTS)


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = set()
        for text in batch.column("text"):
            text = text.as_py()
            key = hashlib.sha256(text.encode()).digest()
            if key in seen:  # copies side by side are cut once
                continue
            seen.add(key)
            starts = range(0, len(text) - overlap, chunk)
            for first in range(0, len(starts), 64):
                some = starts[first : first + 64]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([key] * len(some), pa.binary()),
                        "no": pa.array(range(first, first + len(some)), pa.int32()),
                        "last": [start + chunk + overlap >= len(text) for start in some],
                        "text": [text[start : start + chunk + overlap] for start in some],
                    }
                )


def _boundaries(batches: Iterator[pa.RecordBatch], rule: Rules, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Pre-tokenise chunks: their pieces' lengths, and the boundaries that a neighbour can see."""
    own = codec(rule)
    for batch in batches:
        for cut in slices(batch, "text", SLICE_BYTES):
            lengths, heads, tails = [], [], []
            for text, last in zip(cut.column("text").to_pylist(), cut.column("last").to_pylist(), strict=True):
                sizes = np.fromiter(map(len, own.pieces(text)), np.int32)
                at = np.cumsum(sizes) - sizes
                sure = at[at <= len(text) - own.reach]  # later ones may hang on what follows the chunk
                lengths.append(sizes)
                heads.append(at[at < overlap])
                tails.append(np.zeros(0, np.int64) if last else sure[sure >= chunk] - chunk)
            arrays = [pa.array(rows, pa.list_(pa.int32())) for rows in (lengths, heads, tails)]
            yield pa.RecordBatch.from_arrays([*cut.columns, *arrays], [*cut.schema.names, "lengths", "head", "tail"])


def chunks(docs: DataFrame, rule: Rules, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, no, last, text, lengths, head, tail): pre-tokenised chunks of every different long text, dealt by (key, no)."""
    rows = (
        _named(docs)
        .where(F.length("text") > chunk)
        .mapInArrow(lambda batches: _cut(batches, chunk, overlap), "key binary, no int, last boolean, text string")
        .dropDuplicates(["key", "no"])
    )
    fields = "key binary, no int, last boolean, text string, lengths array<int>, head array<int>, tail array<int>"
    return rows.mapInArrow(lambda batches: _boundaries(batches, rule, chunk, overlap), fields)


def stitches(pretokenised: DataFrame) -> DataFrame:
    """(key, no, entry, leave, apart): where each chunk starts and stops to count.

    ``leave`` is in the chunk's own characters; NULL: to the text's end. ``apart`` marks chunks that
    are to be read in order: the last before a missing stitch, and all that follow.
    """
    ordered = Window.partitionBy("key").orderBy("no")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(ordered)))
    entries = pretokenised.select("key", "no", F.when(F.col("no") == 0, 0).otherwise(shared).alias("entry"))
    lost = F.col("entry").isNull()
    nearby = entries.select("*", F.lead("entry").over(ordered).alias("leave"), F.lead(lost, 1, False).over(ordered).alias("ends"))
    return nearby.select("key", "no", "entry", "leave", F.max(lost | F.col("ends")).over(ordered).alias("apart"))


def _encode_chunks(batches: Iterator[pa.RecordBatch], rule: Rules, chunk: int) -> Iterator[pa.RecordBatch]:
    own = codec(rule)
    for batch in batches:
        for cut in slices(batch, "text", SLICE_BYTES):
            found = []
            columns = [cut.column(name) for name in ("text", "lengths", "entry", "leave")]
            for text, sizes, entry, leave in zip(*columns, strict=True):
                text, entry, leave = text.as_py(), entry.as_py(), leave.as_py()
                ends = np.cumsum(sizes.values.to_numpy(zero_copy_only=False))
                stop = len(text) if leave is None else chunk + leave
                first, last = np.searchsorted(ends, [entry, stop], "right")
                ends = ends[first:last].tolist()
                found.append([text[a:b] for a, b in zip([entry, *ends[:-1]], ends, strict=True)] if ends else [])
            yield pa.RecordBatch.from_arrays([cut.column("key"), cut.column("no"), _id_lists(own.encode(found))], ["key", "part", "ids"])


def _encode_in_order(batches: Iterator[pa.RecordBatch], rule: Rules, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a text one after the other, carrying what isn't surely cut yet."""
    own = codec(rule)
    key, waiting, tried = None, "", 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                key, waiting, tried = row["key"], row["text"][row["entry"] :], 0
            else:
                waiting += row["text"][overlap:]
            if not row["last"] and len(waiting) < 2 * tried:  # a long piece is not tried at every chunk
                continue
            pieces = own.pieces(waiting)
            if row["last"]:
                waiting = ""
            else:
                left = 0  # characters of pieces at the end that more text could change
                while pieces and left < own.reach:
                    left += len(pieces.pop())
                waiting = waiting[len(waiting) - left :]
            tried = len(waiting)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([row["no"]], pa.int32()), _id_lists(own.encode([pieces]))], ["key", "part", "ids"]
            )


def encode_long(docs: DataFrame, rule: Rules, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, part, ids) of every different text of several chunks; the key is its SHA-256."""
    pretokenised = materialize(chunks(docs, rule, chunk, overlap), "chunks")
    stitched = pretokenised.drop("head", "tail").join(stitches(pretokenised), ["key", "no"])
    alone = stitched.where(~F.col("apart")).mapInArrow(lambda b: _encode_chunks(b, rule, chunk), "key binary, part int, ids array<int>")
    in_order = (
        stitched.where("apart")
        .select("key", "no", "last", "text", "entry")
        .repartition("key")
        .sortWithinPartitions("key", "no")
        .mapInArrow(lambda b: _encode_in_order(b, rule, overlap), "key binary, part int, ids array<int>")
    )
    return alone.unionByName(in_order)


def _gather_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners: dict[bytes, list] = {}
        for doc_id, key in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), strict=True):
            owners.setdefault(key, []).append(doc_id)
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(list(owners), pa.binary()), "doc_ids": pa.array(list(owners.values()), pa.list_(pa.int64()))}
        )


def owners(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, doc_ids): rows of each long text, those of one batch together, so that a text with many rows is few rows here."""
    keyed = _named(docs).where(F.length("text") > chunk).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    return keyed.mapInArrow(_gather_owners, "key binary, doc_ids array<long>")


def for_rows(keyed: DataFrame, docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What is known by key of a long text, for every row that holds it."""
    return owners(docs, chunk).join(keyed, "key").select(F.explode("doc_ids").alias("doc_id"), *[c for c in keyed.columns if c != "key"])


def encode(docs: DataFrame, rule: Rules, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, part, ids): every text's ids, a long text's in parts that follow each other."""
    return encode_short(docs, rule, chunk).unionByName(for_rows(encode_long(docs, rule, chunk, overlap), docs, chunk))


def _decode(batches: Iterator[pa.RecordBatch], rule: Rules) -> Iterator[pa.RecordBatch]:
    own = codec(rule)
    for batch in batches:
        raw = [own.decode(ids) for ids in _id_rows(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "bytes"])


def decode(encoded: DataFrame, rule: Rules) -> DataFrame:
    """``encoded`` with the raw ``bytes`` of each part; a character may be cut between two parts."""
    return encoded.mapInArrow(lambda batches: _decode(batches, rule), encoded.withColumn("bytes", F.lit(b"")).schema)


def _digest_rows(batches: Iterator[pa.RecordBatch], rule: Rules, name: str) -> Iterator[pa.RecordBatch]:
    """Digests over rows in order; rows of one name follow each other. Without a name, each row by itself."""
    own = codec(rule)
    current, total, of_ids, of_bytes = None, 0, hashlib.sha256(), hashlib.sha256()

    def row(key, n, a, b):
        return pa.RecordBatch.from_pydict({name: key, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    if name == "doc_id":
        for batch in batches:
            counts, texts, raws = [], [], []
            for ids in _id_rows(batch):
                counts.append(len(ids))
                texts.append(hashlib.sha256(own.decimals(ids).encode()).hexdigest())
                raws.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield row(batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(raws, pa.string()))
        return
    for batch in batches:
        for key, ids in zip(batch.column(name).to_pylist(), _id_rows(batch), strict=True):
            if key != current:
                if current is not None:
                    yield row(pa.array([current], pa.binary()), [total], [of_ids.hexdigest()], [of_bytes.hexdigest()])
                current, total, of_ids, of_bytes = key, 0, hashlib.sha256(), hashlib.sha256()
            if ids:
                of_ids.update(("," if total else "").encode() + own.decimals(ids).encode())
                of_bytes.update(own.decode(ids))
                total += len(ids)
    if current is not None:
        yield row(pa.array([current], pa.binary()), [total], [of_ids.hexdigest()], [of_bytes.hexdigest()])


def digests(docs: DataFrame, rule: Rules, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (of the bytes the ids decode to).

    A long text's parts go by in order through one task, which keeps a running digest.
    """
    # One worker encodes and digests: the ids need not pass through the JVM between.
    short = _short(docs, chunk).mapInArrow(lambda b: _digest_rows(_encode_short(b, rule), rule, "doc_id"), f"doc_id long, {DIGESTS}")
    parts = encode_long(docs, rule, chunk, overlap).repartition("key").sortWithinPartitions("key", "part")
    long = parts.mapInArrow(lambda b: _digest_rows(b, rule, "key"), f"key binary, {DIGESTS}")
    return short.unionByName(for_rows(long, docs, chunk))
