"""Chunked byte-level BPE against the tokenizer library over whole texts."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame, prose, rows_of

from tuneprep.llm import bpe

RULES = bpe.rules(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
CODEC = bpe.codec(RULES)
LIBRARY = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
FIELDS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def ids_of(text):
    return np.frombuffer(CODEC.encode([CODEC.pieces(text)])[0], "<i4").tolist()


def expected(doc_id, text):
    ids = LIBRARY.encode_ordinary(text or "")
    digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
    return (doc_id, len(ids), *digests)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '\n\t1é　.’\U000323b0 \U00011de1sret"), max_size=40))
def test_pieces_are_the_librarys(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_every_character():
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for between in ("", "a", " ", "1", "'"):
        assert ids_of(between.join(text)) == LIBRARY.encode_ordinary(between.join(text))


def long_texts():
    rng = random.Random(5)
    mixed = "".join(rng.choice(["'s", "'re", " ", "  ", "\n", "a", "bc", "12", "é", "!?", " x"]) for _ in range(3_000))
    run = "q" * 900  # longer than a chunk and its overlap
    return {
        1: prose(1, 400), 2: mixed, 3: run, 4: prose(2, 60) + run + " " + prose(3, 200) + "7" * 300 + mixed,
        5: " " * 500 + "a" + "\n" * 400 + "b", 6: run + "'s " + run, 7: "x" * 100, 8: "x" * 101, 9: "ab " * 33 + "ab",
        10: "日本語の文章です。" * 80, 11: mixed + "\U000323b0" * 70 + mixed, 12: None, 13: "", 14: " ", 15: prose(1, 400),
    }


@pytest.mark.parametrize("chunk, overlap", [(100, 20), (64, 64), (1000, 200)])
def test_chunks_equal_whole_texts(spark, chunk, overlap):
    texts = list(long_texts().items())
    rows = [*texts, (1, prose(1, 400)), (None, prose(1, 400)), (2, "another text of the same id"), (-5, "a")]
    found = rows_of(bpe.digests(frame(spark, rows), RULES, chunk, overlap), *FIELDS)
    assert sorted(found, key=repr) == sorted((expected(*row) for row in rows), key=repr)


def test_ids_and_bytes(spark):
    texts = {k: v for k, v in long_texts().items() if v}
    parts = bpe.decode(bpe.encode(frame(spark, list(texts.items())), RULES, 100, 20), RULES).orderBy("doc_id", "part").collect()
    for doc_id, text in texts.items():
        mine = [row for row in parts if row.doc_id == doc_id]
        assert [i for row in mine for i in row.ids] == LIBRARY.encode_ordinary(text)
        assert b"".join(bytes(row.bytes) for row in mine) == text.encode()
    assert max(row.part for row in parts if row.doc_id == 1) > 3


def test_stitches(spark):
    """Chunks meet at a shared boundary; from the first pair that shares none on, they are read in order."""
    rows = [(1, prose(1, 400)), (2, prose(2, 60) + "q" * 500 + " " + prose(3, 100))]
    found = bpe.stitches(bpe.chunks(frame(spark, rows), RULES, 100, 20)).collect()
    by_text = {}
    for row in found:
        by_text.setdefault(bytes(row.key), []).append(row)
    whole, broken = sorted((sorted(v, key=lambda r: r.no) for v in by_text.values()), key=lambda v: any(r.apart for r in v))
    assert all(r.entry is not None and not r.apart for r in whole)
    assert [r.leave for r in whole[:-1]] == [r.entry for r in whole[1:]]
    first = next(i for i, r in enumerate(broken) if r.entry is None)
    assert [r.apart for r in broken] == [i >= first - 1 for i in range(len(broken))]


def test_copies_are_cut_once(spark):
    rows = [(i, prose(1, 400)) for i in range(300)]
    assert bpe.chunks(frame(spark, rows).repartition(4), RULES, 100, 20).count() == bpe.chunks(frame(spark, rows[:1]), RULES, 100, 20).count()
    assert bpe.owners(frame(spark, rows).coalesce(2), 100).count() <= 2
    found = rows_of(bpe.digests(frame(spark, rows), RULES, 100, 20), *FIELDS)
    assert sorted(found) == [expected(*row) for row in rows]


def test_no_documents(spark):
    empty = frame(spark, [])
    assert bpe.digests(empty, RULES).count() == 0
    assert bpe.encode(empty, RULES).count() == 0
