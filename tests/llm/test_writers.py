"""WARC archives, the conversation tree, nearest neighbours and mixing."""

import base64
import hashlib
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame, prose, rows_of

from tuneprep.llm import chat_tree, mixing, neighbours, ranges, warc
from tuneprep.llm.files import open_file
from tuneprep.llm.queries import MIXTURE, PROBE, THIN, TOKENIZER

PAGES = "page_id long, url string, html string"


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>{prose(i, 30)}") for i in range(200)]
    rows += [(300 + i, "u", "same é") for i in range(50)] + [(400, None, None), (401, "a\r\nb", ""), (402, "u", prose(1, 50_000))]
    return rows + [(500, "u", "twice"), (500, "u", "twice"), (500, "u", "other"), (501, "u", "twice"), (None, "u", "twice"), (10**15, "u", "far")]


def expected_pages(rows, least):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        source = first.get(html or "")
        revisit = len(raw) >= least and source is not None and page_id != source
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if revisit else "response", source if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, range_rows, file_bytes", [(0, 4096, 1 << 25), (6, 20, 400), (0, 1, 1)])
def test_archive(spark, out_dir, least, range_rows, file_bytes):
    rows = page_rows()
    manifest = warc.write_pages(frame(spark, rows, PAGES).repartition(6), out_dir, least, range_rows, file_bytes)
    got = sorted((tuple(r) for r in warc.read_pages(manifest).collect()), key=repr)
    assert got == expected_pages(rows, least)


def test_archive_is_deterministic(spark, out_dir):
    def files(name, parts):
        manifest = warc.write_pages(frame(spark, page_rows(), PAGES).repartition(parts), f"{out_dir}/{name}", 0, 30, 2000)
        contents = {}
        for row in manifest.collect():
            with open_file(row["path"]) as source:
                contents[row["path"].rpartition("/")[2]] = source.read()
        return contents

    first = files("a", 3)
    assert first == files("b", 8) and len(first) > 8


def test_empty_archive(spark):
    assert warc.archived(frame(spark, [], PAGES)).count() == 0


def test_even_splits(spark):
    keys = [*range(1000), *range(10**12, 10**12 + 500), -(2**60)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    splits = np.array(ranges.even_splits(df, "k", 100))
    assert np.bincount(ranges.range_of(np.array(keys), splits)).max() <= 100
    assert len(splits) < 40
    assert ranges.even_splits(df.limit(0), "k", 100) == []


def test_ranges_are_bounded_and_keep_a_key_whole(spark, monkeypatch):
    monkeypatch.setattr(ranges, "MOST_RANGES", 8)
    keys = [5] * 700 + [*range(10, 1000)]
    splits = ranges.even_splits(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 10)
    assert splits == sorted(set(splits)) and len(splits) < 8
    assert np.bincount(ranges.range_of(np.array(keys), np.array(splits))).max() <= 700 + 212


def test_a_range_has_a_task_of_its_own(spark, out_dir):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(400)]
    manifest = warc.write_pages(frame(spark, rows, "page_id long, url string, html string"), out_dir, range_rows=25)
    assert sorted(r["records"] for r in manifest.collect()) == [25] * 16


@given(st.text(st.sampled_from("<>/s[]INSTY\\n\n é"), max_size=40), st.text(st.sampled_from("<>/s[]INSTY\\n\n é"), max_size=9))
def test_turns_round_trip(text, role):
    for name in ("user", "assistant", role):
        formatted, a, b = chat_tree.format_turn(name, text)
        assert chat_tree.parse_turn(formatted) == (name, text)
        inside = formatted[1:-5] if name == "assistant" else formatted[7:-8]
        assert not any(c in inside for c in chat_tree.CONTROLS)
        assert chat_tree.unescape(formatted[a:b]) == (text if name == "assistant" else "")


TURNS = "conv_id long, turn long, role string, text string"


def chat_rows():
    rows = []
    for c in range(60):
        rows += [(c, 0, "system", "shared"), (c, 1, "user", f"ask {c % 3}")]
        rows += [(c, 2 + k, "assistant" if k % 2 == 0 else "user", f"é {c % 9 if k < 2 else c} {k}") for k in range(c % 5)]
    rows += [(100, t, "user", f"t{t}") for t in range(300)] + [(101, 0, None, None), (101, None, "tool", "x\\n<s>"), (101, 0, None, None)]
    return rows + [(102, 0, "assistant", PROBE), (103, 0, "assistant", PROBE), (None, 0, "user", "nobody"), (104, 0, "ro\nle", "a\nb")]


def test_tree(spark):
    rows = chat_rows()
    nodes, turns = chat_tree.build_tree(frame(spark, rows, TURNS).repartition(5), TOKENIZER)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_tree(nodes, turns).collect()}
    expected, paths = {}, set()
    for c in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in own if role == "assistant")
        size = sum(len(chat_tree.format_turn(*x)[0]) for x in own)
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        expected[c] = (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
        paths |= {tuple(own[: i + 1]) for i in range(len(own))}
    assert got == expected

    laid = nodes.orderBy("start").collect()
    assert len(laid) == len(paths)  # each shared turn once
    at, by_start = 0, {}
    for r in laid:
        assert r["start"] == at and r["tokens"] == len(r["input_ids"])
        at += r["tokens"]
        assert r["intervals"][-1]["stop"] == at
        assert sum(i["stop"] - i["start"] for i in r["intervals"]) == r["position"] + r["tokens"]
        by_start[r["start"]] = r
    for r in laid:  # what a node sees is its own path, in order
        seen = []
        for i in r["intervals"]:
            place = i["start"]
            while place < i["stop"]:
                seen.append(chat_tree.parse_turn(by_start[place]["formatted"]))
                place += by_start[place]["tokens"]
        assert tuple(seen) in paths and len(seen) == r["depth"] + 1
    open_paths = []  # depth first: a node comes after its parent and before anything outside the parent
    for r in laid:
        del open_paths[r["depth"] :]
        assert len(open_paths) == r["depth"]
        open_paths.append(r["start"])


def test_empty_tree(spark):
    nodes, turns = chat_tree.build_tree(frame(spark, [], TURNS), TOKENIZER)
    assert chat_tree.read_tree(nodes, turns).count() == 0


def brute_nearest(rows, k):
    ids, vecs = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            near = np.round(unit @ unit[i], 12)
            out[q] = [ids[j] for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-near[j], ids[j]))[:k]]
    return out


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]]) and -1 - 1e-9 <= r["score"] <= 1 + 1e-9
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=24)).tolist()) for i in range(9_000)]
    rows += [(10_000 + i, rows[3][1]) for i in range(3_000)]  # a quarter of all are equal
    got = found_nearest(neighbours.search(frame(spark, rows, "vec_id long, embedding array<double>")))
    true = brute_nearest(rows, 5)
    assert got.keys() == true.keys()
    assert sum(len(set(got[q]) & set(true[q])) for q in true) / (5 * len(true)) >= 0.9
    assert all(len(v) == 5 for v in got.values())
    assert [got[q] for q in got if q >= 10_000] == [true[q] for q in true if q >= 10_000]


def test_neighbour_cases(spark):
    nan = math.nan
    good = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-0.0, 3.0]), (3, [0.0, 1.0]), (50, [1.0, 0.0]), (100, [1e300, 1e300])]
    bad = [(150, None), (200, [0.0, 0.0]), (250, [nan, 1.0]), (300, [None, 1.0]), (350, [math.inf, 1.0]), (400, []), (450, [1.0]), (None, [1.0, 1.0])]
    df = frame(spark, good + bad + good[:1], "vec_id long, embedding array<double>")
    got = found_nearest(neighbours.search(df))
    assert got == {0: [1, 50, 100, 2, 3], 50: [0, 1, 100, 2, 3], 100: [0, 1, 2, 3, 50]}
    assert found_nearest(neighbours.search(df.where("vec_id in (0, 3)"))) == {0: [3]}
    assert neighbours.search(df.limit(0)).count() == 0


def labelled(spark):
    kinds = {"red": "crimson scarlet ruby", "blue": "azure navy teal", "grey": "ash slate lead"}
    rows, labels = [], []
    for i in range(240):
        kind = ["red", "red", "red", "blue", "grey", "red"][i % 6]
        rows.append((i, f"{kinds[kind]} {prose(i, 40 + i % 7)}"))
        labels.append((i, kind))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (None, rows[1][1]), (903, prose(5, 40_000))]
    return frame(spark, rows), spark.createDataFrame(labels[:180] + [(4, None), (None, "red")], "doc_id long, domain string")


def test_mixture(spark):
    docs, labels = labelled(spark)
    docs = docs.where("doc_id is null or doc_id <> 903")  # its text would outweigh all others
    table, mixture, model = mixing.document_rates(docs, labels, {"red": 0.4, "blue": 0.4, "grey": 0.2}, ("red",))
    assert model.names == ["blue", "grey", "red"]
    rows = table.collect()
    domains, tokens, rate = (np.array([r[c] for r in rows]) for c in ("domains", "tokens", "rate"))
    totals = (tokens * rate) @ domains
    assert np.allclose(totals / totals.sum(), [0.4, 0.2, 0.4], atol=0.002)
    assert (rate >= 0).all() and np.allclose(domains.sum(axis=1), 1)
    assert np.allclose(totals, mixture.target, rtol=0.005)
    mixed = mixing.mix(docs, labels, {"red": 0.4, "blue": 0.4, "grey": 0.2}, ("red",))
    assert mixed.columns == docs.columns
    counts = dict(rows_of(mixed.groupBy("doc_id").count(), "doc_id", "count"))
    by = {r["doc_id"]: r["rate"] for r in rows if r["doc_id"] not in (902, None)}
    assert all(abs(counts.get(k, 0) - v) < 1 for k, v in by.items() if k not in (900, 901))


def test_rates_against_a_direct_solution():
    rng = np.random.default_rng(2)
    domains = rng.dirichlet([0.3] * 3, 500)
    tokens = rng.integers(1, 100, 500)
    whole = tokens.sum()
    natural = tokens @ domains
    target = natural * [1.3, 0.4, 1.0]
    history = np.zeros((0, 3))
    for _ in range(300):
        _, ahead = mixing.rates(domains, history)
        residual = (tokens * ahead) @ domains - target
        history = np.vstack([history, whole / natural / 3 * residual / whole])
    rate = mixing.rates(domains, history)[0]
    assert np.allclose((tokens * rate) @ domains, target, rtol=1e-4) and (rate >= 0).all()


def test_mixture_without_labels_or_rows(spark):
    docs, labels = labelled(spark)
    table, _, _ = mixing.document_rates(docs.where("doc_id < 5"), labels.limit(0), {"red": 1.0})
    assert {r["rate"] for r in table.collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"red": 1.0}).count() == 0
    assert mixing.document_rates(docs.limit(0), labels, {"red": 1.0})[0].where(F.col("rate") != 1).count() == 0


@pytest.mark.parametrize("apart", [1, 2, 5])
def test_mixture_reaches_production_targets(spark, apart):
    rng = np.random.default_rng(apart)
    margin = rng.normal(0, 1, (4000, 3))
    margin[np.arange(4000), rng.choice(3, 4000, p=[0.75, 0.15, 0.1])] += apart
    score = 1 / (1 + np.exp(-1.5 * (margin - apart / 2)))
    domains = score / score.sum(axis=1, keepdims=True)
    tokens = rng.lognormal(5, 1, 4000).astype(int) + 1
    rows = [(int(t), p.tolist()) for t, p in zip(tokens, domains, strict=True)]
    table = spark.createDataFrame(rows, "tokens long, domains array<double>").repartition(4).cache()
    mixture = mixing.fit_rates(table, ["good", "plain", "toxic"], MIXTURE, THIN)
    got = mixing.add_rates(table, mixture).collect()
    rate = np.array([r["rate"] for r in got])
    totals = (np.array([r["tokens"] for r in got]) * rate) @ np.array([r["domains"] for r in got])
    assert (rate >= 0).all() and mixture.met
    assert np.allclose(totals, mixture.target, atol=2e-5 * tokens.sum())
    assert np.allclose(totals / totals.sum(), [0.85, 0.13, 0.02], atol=1e-4)


def test_mixture_says_when_targets_are_out_of_reach(spark):
    rows = [(100 + i, [0.6 - 0.001 * i, 0.2 + 0.001 * i, 0.2]) for i in range(200)]
    table = spark.createDataFrame(rows, "tokens long, domains array<double>").cache()
    with pytest.warns(UserWarning, match="target weights not reached"):
        mixture = mixing.fit_rates(table, ["good", "plain", "toxic"], MIXTURE, THIN)
    assert not mixture.met
