"""The pipeline's stages: what they keep, drop and return."""

import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame, prose
from test_matching import brute_components

import corpus_pipeline
from tuneprep.llm.queries import TOKENIZER, table
from tuneprep.llm.token_ids import encoder
from tuneprep.storage import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        out[name] = docs.collect()
        if name != "token ids":
            assert docs.columns == columns
            assert all(given[r["doc_id"]] == r["text"] for r in out[name])
    language, dedup, clean, mixed, ids = out.values()
    assert {r["doc_id"] for r in language} == {k for k, t in given.items() if any(c.isalpha() for c in t or "")}
    kept = {r[0] for r in brute_components([(r["doc_id"], r["text"]) for r in language], 5) if r[3]}
    assert {r["doc_id"] for r in dedup} == kept
    items = [" ".join(r["text"].split()) for r in table(spark, SF, "benchmark").collect()]
    held = {r["doc_id"] for r in dedup if any(i in " ".join(r["text"].split()) for i in items)}
    assert held and {r["doc_id"] for r in clean} == {r["doc_id"] for r in dedup} - held
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in clean} - {r["doc_id"] for r in mixed}
    assert len(gone - toxic) <= 0.02 * len(clean)
    start, expected = 0, []
    for r in sorted(mixed, key=lambda r: r["doc_id"]):
        tokens = encoder(TOKENIZER).tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        expected.append((r["doc_id"], start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert [tuple(r) for r in sorted(ids, key=lambda r: r["start"])] == expected
    again = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in again] == expected


def test_stages_on_odd_rows(spark):
    text = table(spark, SF, "documents").where("lang = 'en'").orderBy("doc_id").first()["text"]
    schema = "doc_id long, text string, lang string, score double, rate double"
    rows = [(1, None, "en", 1.0, 2.0), (2, "", None, 1.0, 2.0), (3, text, "en", None, None), (3, text, "en", 0.0, 0.0)]
    rows += [(None, text + " tail", "en", 0.0, 0.0), (6, prose(1, 30_000) + text, "en", 0.0, 0.0), (7, "12 !", "fr", 0.0, 0.0)]
    for given in (rows, []):
        docs = frame(spark, given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, SF), "test-stage")
            if name == "token ids":
                assert out.count() == sum(r[0] is not None for r in given)
            else:
                assert out.columns == docs.columns
                assert out.count() <= 3 * len(given)
