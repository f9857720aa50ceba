import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import encoding
from tuneprep.operators.encoding import (
    Vocabulary,
    build_vocab,
    encode,
    encode_pairs,
    encode_prompts,
    encode_with,
    pad_or_eos,
)

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in which one word, which no vocabulary here has, makes up a third of all words."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS + ["hot"] * 20) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    texts += ["", "  ", "unseen words only"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)


def expected_vocab(texts, size, first_id):
    counts = Counter(word for text in texts for word in text.split())
    ranked = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:size]
    return {word: (i + first_id, n) for i, (word, n) in enumerate(ranked)}


@pytest.mark.parametrize("size", [5, 30, 1000])
def test_build_vocab(spark, corpus, size):
    texts, df = corpus
    vocab = build_vocab(df, size, first_id=7)
    assert {r.token: (r.id, r.n) for r in vocab.collect()} == expected_vocab(texts, size, 7)


def test_nothing_to_encode(spark):
    empty = spark.createDataFrame([(1, ""), (2, None)], "k int, text string")
    vocab = build_vocab(empty, 5)
    assert vocab.count() == 0
    for broadcast_words in (10, 0):
        words = spark.createDataFrame([("a", 1)], "token string, id int")
        ready = Vocabulary(words if broadcast_words == 0 else vocab, 0, broadcast_words)
        assert [r.input_ids for r in encode(empty, ready).collect()] == [[], []]
    with pytest.raises(ValueError):
        build_vocab(empty, 0)


@pytest.mark.parametrize("max_length", [None, 8])
@pytest.mark.parametrize("broadcast_words", [1000, 30, 5, 1])
def test_encode(spark, corpus, max_length, broadcast_words):
    texts, df = corpus
    ids = {word: i for i, word in enumerate(WORDS, start=1)}
    vocab = Vocabulary(spark.createDataFrame(list(ids.items()), "token string, id int"), 0, broadcast_words)
    assert (vocab.lookup is None) == (broadcast_words < len(WORDS))
    out = encode(df, vocab, max_length=max_length)
    assert out.columns == ["k", "text", "input_ids"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.input_ids == [ids.get(word, 0) for word in texts[row.k].split()[:max_length]]


def test_broadcast_stays_within_its_bytes(spark, corpus, monkeypatch):
    texts, df = corpus
    monkeypatch.setattr(encoding, "BROADCAST_BYTES", 12)
    ids = {word: i for i, word in enumerate(WORDS, start=1)}
    vocab = Vocabulary(spark.createDataFrame(list(ids.items()), "token string, id int"))
    assert vocab.lookup is None
    for row in encode(df, vocab).collect():
        assert row.input_ids == [ids.get(word, 0) for word in texts[row.k].split()]


@pytest.mark.parametrize("broadcast_words", [1000, 1])
def test_rows_need_no_key(spark, broadcast_words):
    """Repeated rows and NULL columns give the same ids on both sides of the bound."""
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate("abcd", 1)], "token string, id int")
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "d d a"), (None, "d c b a a"), (None, "a x"), (None, None)]
    out = encode(spark.createDataFrame(rows, "k int, text string").repartition(3), Vocabulary(vocab, 0, broadcast_words))
    got = sorted((r.text or "", r.input_ids) for r in out.collect())
    ids = {w: i for i, w in enumerate("abcd", 1)}
    assert got == sorted((t or "", [ids.get(w, 0) for w in (t or "").split()]) for _, t in rows)


@pytest.mark.parametrize("broadcast_words", [1000, 2])
def test_encode_pairs(spark, broadcast_words):
    vocab = spark.createDataFrame([("Question:", 1), ("Answer:", 2), ("a", 3), ("b", 4)], "token string, id int")
    df = spark.createDataFrame([(1, "a b", "b", "c a"), (2, "", "a", None)], "k int, prompt string, chosen string, rejected string")
    ready = Vocabulary(vocab, 0, broadcast_words)
    out = encode_pairs(df, ready, 4, keep=["k"])
    assert out.columns == ["k", "input_ids_j", "attention_mask_j", "input_ids_k", "attention_mask_k"]
    rows = {r.k: r for r in out.collect()}
    assert rows[1].input_ids_j == rows[1].input_ids_k == [1, 3, 4, 2] and rows[1].attention_mask_j == [1, 1, 1, 1]
    assert (rows[2].input_ids_j, rows[2].input_ids_k) == ([1, 2, 3], [1, 2, 0])
    assert encode_pairs(df, ready).columns == out.columns[1:]


def test_encode_prompts(spark):
    vocab = spark.createDataFrame([("Answer:", 2), ("a", 3)], "token string, id int")
    out = encode_prompts(spark.createDataFrame([("a x",)], "question string"), vocab)
    assert out.columns == ["input_ids"] and out.first()[0] == [0, 3, 0, 2]


def test_own_tokenizer(spark, corpus):
    texts, df = corpus

    def tokenize(batch):
        return [[len(word) for word in text.split()] for text in batch]

    for row in encode_with(df, tokenize, max_length=5).collect():
        assert row.input_ids == [len(word) for word in texts[row.k].split()][:5]


def test_pad_id():
    assert pad_or_eos(None, 2) == 2 and pad_or_eos(0, 2) == 0


def test_encode_shuffles_nothing(spark, corpus):
    _, df = corpus
    vocab = Vocabulary(build_vocab(df, 20))
    scan = spark.range(10).select(F.col("id").cast("string").alias("text"))
    assert "Exchange" not in encode(scan, vocab)._jdf.queryExecution().executedPlan().toString()
