"""Token ids of a corpus in binary shards, with Elias-Fano coded document boundaries.

A shard holds the ids of consecutive documents side by side (2 bytes each while the
vocabulary fits, else 4), then two Elias-Fano sequences, the documents' ends and their
ids, then a fixed footer. ``TokenShard`` finds a document by two selects.

Defined cases: a NULL or empty text is just the end mark; rows with equal doc_id follow
each other in unspecified order; rows whose doc_id is NULL cannot be named and are left
out; an empty table gives no shard; other columns are ignored. A very long text is held
once by the one task that encodes it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm import elias_fano
from tuneprep.llm.bpe import latin_pattern
from tuneprep.llm.files import new_file, open_file
from tuneprep.llm.words import slices
from tuneprep.storage import materialize, scratch_path

END_ID = 0
SHARD_IDS = 64 << 20
CACHED_PIECES = 400_000
FOOTER = struct.Struct("<QQQQQqB7s")  # documents, ids, index offset, its two lengths, smallest doc_id, width, mark
MARK = b"EFTOK01"
MANIFEST = "part int, file int, path string, docs long, ids long"


class Pieces(dict):
    """Ids of pieces met before; others go through the tokenizer's merges when asked for."""

    def __init__(self, own: Encoder):
        from tokenizers import pre_tokenizers

        self.model, self.kind = own.tokenizer.model, f"<u{own.width}"
        # The merges are over stand-ins of bytes.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: "".join(part for part, _ in spell(chr(c))) for c in range(256)}

    def __missing__(self, piece: str) -> bytes:
        ids = np.array([token.id for token in self.model.tokenize(piece.translate(self.spelling))], self.kind).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Whole-text ids from a tokenizer file, remembering the ids of pieces.

    A byte-level tokenizer cuts a text by a fixed pattern and encodes each piece by itself, so a
    text's ids are those of its pieces in a row. Texts beyond Latin-1, where versions of Unicode
    decide about pieces, and texts with a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        cutter = self.tokenizer.pre_tokenizer
        self.by_pieces = (
            type(cutter).__name__ == "ByteLevel"
            and cutter.use_regex
            and not cutter.add_prefix_space
            and self.tokenizer.normalizer is None
        )
        self.cut = re.compile(latin_pattern(public_tokenizers.PATTERN)).findall
        self.pieces = Pieces(self)

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in encoded]

    def _simple(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self.by_pieces and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of every text."""
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        known = self.pieces.__getitem__
        return [b"".join(map(known, self.cut(text))) if self._simple(text) else self.whole([text])[0] for text in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write_shards(
    batches: Iterator[pa.RecordBatch], out: str, tokenizer: str, end_id: int, shard_ids: int
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, file = TaskContext.get().partitionId(), 0
    encode = encoder(tokenizer)
    end = end_id.to_bytes(encode.width, "little")

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for cut in slices(batch, "text"):
                texts = [text or "" for text in cut.column("text").to_pylist()]
                yield from zip(cut.column("doc_id").to_pylist(), encode.encode(texts), strict=True)

    waiting = rows()
    row = next(waiting, None)
    while row is not None:
        path = f"{out}/tokens-{part:06d}-{file:04d}.bin"
        ids, lengths, total = [], [], 0
        with new_file(path) as stream:
            while row is not None and total < shard_ids:
                stream.write(row[1] + end)
                ids.append(row[0])
                lengths.append(len(row[1]) // encode.width + 1)
                total += lengths[-1]
                row = next(waiting, None)
            ends = elias_fano.encode(np.cumsum(lengths))
            names = elias_fano.encode((np.array(ids, np.int64) - ids[0]).astype(np.uint64))
            stream.write(ends + names)
            stream.write(
                FOOTER.pack(len(ids), total, total * encode.width, len(ends), len(names), ids[0], encode.width, MARK)
            )
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "file": pa.array([file], pa.int32()),
                "path": [path],
                "docs": [len(ids)],
                "ids": [total],
            }
        )
        file += 1
    encode.pieces.clear()  # an idle worker holds no pieces


def write_token_ids(
    docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Write shards in ascending doc_id order; return the manifest of committed files.

    Rows are range-partitioned by doc_id and sorted, and each task streams its texts
    into files, so a task holds one slice of texts and the coded boundaries of one file.
    Only files that the manifest names count.
    """
    ordered = (
        docs.select("doc_id", "text")
        .where(F.col("doc_id").isNotNull())
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    written = ordered.mapInArrow(lambda rows: _write_shards(rows, out, tokenizer, end_id, shard_ids), MANIFEST)
    return materialize(written, "token-manifest")


class TokenShard:
    """Random access to one shard file."""

    def __init__(self, source):
        size = source.size()
        self.source = source
        source.seek(size - FOOTER.size)
        self.docs, self.ids, self.index, ends, names, self.base, self.width, mark = FOOTER.unpack(
            source.read(FOOTER.size)
        )
        if mark != MARK:
            raise ValueError("Not a token shard.")
        source.seek(self.index)
        index = source.read(ends + names)
        self.ends, self.names = elias_fano.Sequence(index[:ends]), elias_fano.Sequence(index[ends:])

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends among the shard's ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int:
        return self.base + self.names.select(i)

    def read(self, first: int, last: int) -> np.ndarray:
        self.source.seek(first * self.width)
        return np.frombuffer(self.source.read((last - first) * self.width), f"<u{self.width}")


def _read_shards(batches: Iterator[pa.RecordBatch], chunk_ids: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    _encoders.clear()  # the shards are written: the worker gives their memory back
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with open_file(path) as source:
                shard = TokenShard(source)
                bounds = np.concatenate([[0], shard.ends.values().astype(np.int64)])
                names = shard.names.values().astype(np.int64) + shard.base
                first = 0
                while first < shard.docs:
                    last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + chunk_ids, "right")) - 1)
                    at = bounds[first : last + 1]
                    ids = shard.read(at[0], at[-1]).astype("<u4")
                    cut = at - at[0]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": names[first:last],
                            "start": at[:-1] + base,
                            "n_tokens": np.diff(at),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    first = last


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # one row per file
    return (
        based.select("path", "base")
        .repartition(max(1, manifest.count()), "path")  # a row is short, but its task reads the file
        .mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the corpus below the shared folder and describe its documents from the files."""
    return read_token_ids(write_token_ids(docs, scratch_path(docs.sparkSession, "token-ids"), tokenizer, end_id))
