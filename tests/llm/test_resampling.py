"""Importance resampling against a plain version that counts every feature of every text."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame, prose, rows_of

from tuneprep.llm import resampling

FIELDS = ("doc_id", "n_features", "weight", "score", "rank")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % resampling.BUCKETS


def plain(docs, target, percent=resampling.PERCENT):
    source, wanted = Counter(), Counter()
    for counts, texts in ((source, [text for _, text in docs]), (wanted, target)):
        for text in texts:
            counts.update(map(bucket, features(text)[1]))
    n, s, t = resampling.BUCKETS, sum(source.values()), sum(wanted.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s + n) / ((source[b] + 1) * (t + n)))) for b in map(bucket, found))
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= resampling.LEAST_WORDS and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return [tuple(row[:5]) for row in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9 é\n\x85.　-\U0001f600"), max_size=60), max_size=5), st.integers(2, 90_000))
def test_buckets(texts, buckets):
    rows, found = resampling.feature_buckets(pa.array([t.lower() for t in texts], pa.string()), buckets)
    expected = [(i, zlib.crc32(f.encode()) % buckets) for i, t in enumerate(texts) for f in features(t.lower())[1]]
    assert sorted(zip(rows.tolist(), found.tolist(), strict=True)) == sorted(expected)


def test_long_words():
    texts = ["x" * n + " y " + "z" * (n + 1) for n in (1, 62, 63, 64, 65, 127, 128, 129, 5_000)]
    rows, found = resampling.feature_buckets(pa.array(texts), 1 << 31)
    expected = [(i, zlib.crc32(f.encode()) % (1 << 31)) for i, t in enumerate(texts) for f in features(t)[1]]
    assert sorted(zip(rows.tolist(), found.tolist(), strict=True)) == sorted(expected)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB \n\n.é"), max_size=60))
def test_segments_and_crossing_are_all_features(text):
    inside = Counter(f for words in resampling.segments_of(text) for f in features(b" ".join(words).decode())[1])
    found = Counter(bucket(f) for f, n in inside.items() for _ in range(n))
    crossing = resampling.Crossing(text, resampling.BUCKETS)
    found.update(crossing.buckets)
    assert found == Counter(map(bucket, features(text)[1]))
    assert crossing.words == len(features(text)[0])


def documents():
    rng = random.Random(8)
    lines = [prose(i, rng.choice([1, 2, 3, 12, 40])) for i in range(40)]
    docs = [(i, rng.choice(["\n", "\n\n", "\n--\n"]).join(rng.choices(lines, k=rng.randint(1, 9)))) for i in range(300)]
    docs += [(300 + i, docs[0][1]) for i in range(150)]  # a third are copies
    docs += [(1, docs[1][1]), (1, docs[1][1]), (2, "Another text. " * 20), (None, docs[5][1]), (None, docs[5][1]), (901, None), (902, "")]
    docs += [(903, " \n.\n "), (904, "one\ntwo\nthree"), (905, prose(77, 60_000)), (-906, "A\n\nÉ b" * 30), (907, "w" * 20_000)]
    return docs


def test_equals_counting_everything(spark):
    docs, target = documents(), [prose(3, 40), prose(4, 12) + "\n" + prose(5, 9), None, "", prose(3, 40)]
    items = frame(spark, list(enumerate(target)), "item_id long, text string")
    for percent in (5, 50, 0, 100):
        found = rows_of(_resampled(frame(spark, docs).repartition(5), items, percent), *FIELDS)
        assert _keyed(found) == _keyed(plain(docs, target, percent))


def _keyed(rows):
    return sorted(rows, key=repr)


def _resampled(docs, items, percent):
    return resampling.resample(docs, items, percent)


def test_empty_tables(spark):
    items = frame(spark, [(1, prose(3, 40))], "item_id long, text string")
    assert resampling.resample(frame(spark, []), items).count() == 0
    docs = documents()[:30]
    found = rows_of(resampling.resample(frame(spark, docs), items.limit(0)), *FIELDS)
    assert _keyed(found) == _keyed(plain(docs, []))


def test_a_frequent_line_is_one_row_a_slice(spark):
    docs = frame(spark, [(i, "the same line of words\n" + prose(i, 5)) for i in range(2_000)]).coalesce(4)
    fields = "key binary, places array<struct<doc_id: long, digest: binary, times: long>>"
    assert docs.select("doc_id", "text").mapInArrow(resampling._places, fields).count() <= 2_000 + 16
