"""Language and quality models: held-out figures and defined cases."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame, prose

from tuneprep.llm.language import PENALTY, identify, keep_identified, learn_languages, shares
from tuneprep.llm.quality import learn_quality, score_quality
from tuneprep.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def test_held_out_language(spark):
    found = QUERIES["op7_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    docs = table(spark, SF, "documents")
    model = learn_languages(docs)
    texts = {r["lang"]: r["text"] for r in docs.collect()}
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "…"), (5, texts["fr"]), (5, texts["fr"]), (None, texts["de"])]
    rows += [(6, " ".join([texts["en"]] * 200)), (7, texts["en"] + " " + texts["fr"][: len(texts["en"])])]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in identify(frame(spark, rows), model).collect()}
    assert {k for k in got if k[0] in (1, 2, 3, 4)} == {(i, "und") for i in (1, 2, 3, 4)}
    assert (5, "fr") in got and (None, "de") in got and (6, "en") in got
    assert 0.3 < max(v for k, v in got.items() if k[0] == 7) < 0.9  # a mixture
    kept = keep_identified(frame(spark, rows, "doc_id long, text string"), model)
    assert kept.columns == frame(spark, []).columns
    assert sorted(r["doc_id"] or 0 for r in kept.where("doc_id <> 7 or doc_id is null").collect()) == [0, 5, 5, 6]


def test_nothing_learned(spark):
    docs = frame(spark, [(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = learn_languages(docs)
    assert {r["lang_pred"] for r in identify(docs, model).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def test_held_out_quality(spark):
    found = QUERIES["op8_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in found if r["quality"] == q] for q in (1, 0))
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_quality_cases(spark):
    rows = [(i, ("spam buy now " if i % 2 else "") + prose(i, 60)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, quality int")
    weights = learn_quality(frame(spark, rows), labels)
    tests = [(1000, None), (1001, ""), (1002, "spam buy now " + prose(7000, 60)), (1003, prose(7001, 60)), (1003, prose(7001, 60)), (None, "x")]
    got = score_quality(frame(spark, tests).drop("score"), weights).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 6 and by[1000] == by[1001] and by[1002] < 0.5 < by[1003]
    long = score_quality(frame(spark, [(1, prose(3, 60_000))]), weights).first()
    assert 0 <= long["score"] <= 1


def test_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, [(1, "a b"), (2, None)])
    assert {r["score"] for r in score_quality(docs, learn_quality(docs, labels)).collect()} == {0.5}
    assert score_quality(docs.limit(0), learn_quality(docs, labels)).count() == 0


def plain_climb(likelihood, share):
    """EM one word at a time, for far more rounds than it needs."""
    for _ in range(4_000):
        joint = [[p * s for p, s in zip(word, share)] for word in likelihood]
        share = [sum(row[j] / sum(row) for row in joint) / len(joint) for j in range(len(share))]
    return share, sum(np.log(sum(p * s for p, s in zip(word, share))) for word in likelihood)


def plain_shares(likelihood):
    share, _ = plain_climb(likelihood, [1 / len(likelihood[0])] * len(likelihood[0]))
    order, found = sorted(range(len(share)), key=lambda j: -share[j]), []
    for k in range(1, len(share) + 1):
        own, fitted = plain_climb([[word[j] for j in order[:k]] for word in likelihood], [1 / k] * k)
        found.append((fitted - PENALTY * 0.5 * (k - 1) * np.log(len(likelihood) + 1), k, dict(zip(order, own))))
    _, k, own = max(found, key=lambda x: x[0])
    return k, [own.get(j, 0.0) for j in range(len(share))]


def test_shares_and_sets_against_plain_em():
    rng = np.random.default_rng(9)
    tables, sizes = [], set()
    for mixture in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.6, 0.2, 0.2, 0], [0.25] * 4, [0.9, 0.1, 0, 0], [0, 0, 1, 0]):
        for words in (1, 7, 60):
            true = rng.choice(4, words, p=mixture)
            table = np.exp(-rng.uniform(0, 24, (words, 4)))
            table[np.arange(words), true] = 1.0
            tables.append(table)
    row = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    first = np.searchsorted(row, np.arange(len(tables)))
    share, size = shares(np.concatenate(tables), row, first)
    for i, table in enumerate(tables):
        k, own = plain_shares(table.tolist())
        sizes.add(k)
        assert size[i] == k and np.allclose(share[i], own, atol=0.02), i
    assert sizes == {1, 2, 3, 4}


def test_text_in_all_languages(spark):
    docs = table(spark, SF, "documents")
    model = learn_languages(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 3000").collect()}
    text = " ".join(" ".join(texts[lang].split())[:3000] for lang in sorted(texts))
    rows = identify(frame(spark, [(1, text), (2, texts["fr"]), (3, None)]), model, mixture="languages").collect()
    found = {r["doc_id"]: r["languages"] for r in rows}
    assert sorted(part["lang"] for part in found[1]) == sorted(texts) and len(texts) == 4
    assert all(0.1 < part["share"] < 0.45 for part in found[1]) and sum(part["share"] for part in found[1]) == pytest.approx(1)
    assert [(part["lang"], part["share"]) for part in found[2]] == [("fr", 1.0)] and found[3] == []


def test_columns_of_the_same_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0, 6, "x")], "doc_id long, text string, score double, _score int, Lang_pred string")
    model = learn_languages(docs.selectExpr("text", "'en' AS lang"))
    found = identify(docs, model)
    assert found.columns == ["doc_id", "text", "__score", "_score", "_Lang_pred", "lang_pred", "score"] and found.first()["__score"] == 5.0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scored = score_quality(docs, learn_quality(docs, labels))
    assert scored.columns == ["doc_id", "text", "__score", "_score", "Lang_pred", "score", "predicted"] and scored.first()["_score"] == 6
