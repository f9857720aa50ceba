"""Token shards: exact round trips."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame, prose

from tuneprep.llm import elias_fano, token_ids
from tuneprep.llm.files import open_file
from tuneprep.llm.queries import TOKENIZER


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.integers(0, 50))
def test_elias_fano(gaps, repeat):
    values = np.cumsum(np.array(gaps + [0] * repeat, np.uint64))
    coded = elias_fano.Sequence(elias_fano.encode(values))
    assert len(coded) == len(values)
    assert coded.values().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert coded.select(i) == int(values[i])
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(elias_fano.encode(ends)) < 100_000 * 14 / 8


def test_elias_fano_needs_order():
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([3, 2]))


ODD = [
    "", "a", " a", "a ", "a  b", "x\n\ny", "x \n y", "don't's it's", "<|endoftext|> a<|endoftext|>b", "12.5 a1b2 ___ x\t\ty",
    "é.É\nÑ ...", "a\n", "\n", "\nb", "end.### \r\n z", " ", "  ", "co'op, 'tis", "a\x1cb c\x85d", "日本 語。x", "ok... (yes) [no]'s",
]


def test_pieces_are_exact():
    encoder = token_ids.Encoder(TOKENIZER)
    assert encoder.by_pieces
    assert encoder.encode(ODD) == encoder.whole(ODD)
    assert encoder.encode(ODD) == encoder.whole(ODD)  # from the cache


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB é.'\n\t,1<| ñ"), max_size=40))
def test_pieces_are_exact_on_any_text(text):
    encoder = token_ids.encoder(TOKENIZER)
    assert encoder.encode([text]) == [encoder.whole([text])[0] if text else b""]


def expected(rows):
    encoder = token_ids.encoder(TOKENIZER)
    out, start = [], 0
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [1, 50, 1 << 20])
def test_corpus(spark, out_dir, shard_ids):
    rows = [(i * 7 % 40 - 5, t) for i, t in enumerate(ODD)] + [(100, None), (101, prose(1, 30_000)), (101, prose(1, 30_000)), (None, "x")]
    manifest = token_ids.write_token_ids(frame(spark, rows), out_dir, TOKENIZER, shard_ids=shard_ids)
    got = token_ids.read_token_ids(manifest).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)
    row = manifest.orderBy("part", "file").first()
    with open_file(row["path"]) as source:
        shard = token_ids.TokenShard(source)
        a, b = shard.span(shard.docs - 1)
        assert shard.read(a, b)[-1] == 0 and shard.doc_id(0) == -5


def test_empty_corpus(spark):
    assert token_ids.tokenized(frame(spark, []), TOKENIZER).count() == 0
