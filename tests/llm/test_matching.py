"""Near duplicates, repeated spans and benchmark passages against brute force."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import edited, frame, prose, rows_of

from tuneprep.llm import decontaminate as decontaminate_module
from tuneprep.llm import near_dedup
from tuneprep.llm.components import components
from tuneprep.llm.decontaminate import contaminated, decontaminate, tile
from tuneprep.llm.near_dedup import deduplicate, near_duplicates
from tuneprep.llm.repeats import remove_repeats

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return (text or "").encode().split()


def brute_components(rows, width):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {c: min(rows[k][0] for k in range(len(rows)) if comp[k] == c) for c in set(comp)}
    return sorted((rows[k][0], len(sets[k]), least[comp[k]], rows[k][0] == least[comp[k]]) for k in range(len(rows)))


def near_rows():
    rows = [(i, prose(i, 120)) for i in range(20)]
    base = prose(500, 150)
    rows += [(100 + i, edited(base, i, 0.02 + 0.001 * i)) for i in range(60)]  # a large group, some of it loose
    passage = prose(501, 60)
    rows += [(200 + i, f"{prose(900 + i, 100)} {passage}") for i in range(40)]  # a common passage
    rows += [(300 + i, f"{passage} {prose(950 + i // 2, 8)}") for i in range(20)]  # mostly the passage
    rows += [(400, base), (401, base.upper()), (402, "\n".join(base.split())), (403, prose(3, 120))]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one  TWO"), (505, "one"), (506, "two one")]
    return rows


@pytest.mark.parametrize("width, longest, hot", [(4, 256, 5), (5, 8, 3), (4, 3, 1)])
def test_near_duplicates(spark, monkeypatch, width, longest, hot):
    monkeypatch.setattr(near_dedup, "LIST", longest)
    monkeypatch.setattr(near_dedup, "HOT_KEYS", hot)
    rows = near_rows()
    got = near_duplicates(frame(spark, rows).repartition(5), width)
    assert sorted(rows_of(got, "doc_id", "n_shingles", "component_id", "kept")) == brute_components(rows, width)


@pytest.mark.parametrize("width", [4, 5])
def test_short_texts_in_long_lists(spark, width):
    """Sets of four and five share four values, fewer than ``HOT_KEYS``, all of them in lists longer than ``LIST``."""
    base = prose(600, width + 3)
    rows = [(1, base)] + [(10 + i, f"{base} tail{i}") for i in range(300)]  # 4 of 5
    rows += [(1000 + i, " ".join(f"{base} tail{i}".split()[1:])) for i in range(5)]  # sets of four, of which 4 of 5 too
    rows += [(2000 + i, " ".join(base.split()[: width + 2]) + f" end{i}") for i in range(5)]  # 3 of 5: no link
    rows += [(3000 + i, " ".join(base.split()[:width]) + f" two{i}") for i in range(5)]  # sets of two
    got = near_duplicates(frame(spark, rows).repartition(5), width)
    expected = brute_components(rows, width)
    assert sum(r[2] == 1 for r in expected) == 306
    assert sorted(rows_of(got, "doc_id", "n_shingles", "component_id", "kept")) == expected


def test_near_duplicate_cases(spark):
    long = prose(1, 40_000)
    rows = [(1, long), (2, long + " tail"), (3, prose(9, 50)), (3, prose(9, 50)), (None, long), (None, None)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True),
    ]
    kept = deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == 5
    assert near_duplicates(frame(spark, [])).count() == 0


def test_union_estimate():
    rng = np.random.default_rng(1)
    sets = [rng.choice(3000, n, replace=False).astype(np.uint32) for n in (40, 50, 500, 520)]
    sets.append(np.concatenate([sets[2][:450], sets[3][:50]]))
    sketches = np.full((5, near_dedup.SKETCH), near_dedup.PAD, np.uint32)
    mixed = [np.unique((s.astype(np.uint64) * 2654435761 % 2**32).astype(np.uint32)) for s in sets]
    for row, s in zip(sketches, mixed, strict=True):
        row[: min(len(s), near_dedup.SKETCH)] = s[: near_dedup.SKETCH]
    for i in range(5):
        for j in range(5):
            union = np.union1d(mixed[i], mixed[j])[: near_dedup.SKETCH]
            true = np.isin(union, mixed[i]) & np.isin(union, mixed[j])
            assert near_dedup.union_estimate(sketches, np.array([i]), np.array([j]))[0] == true.mean()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    comp = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width):
    first, out = {}, []
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if doc_id is not None and first[tuple(w[i : i + width])] < doc_id:
                keep[i : i + width] = [False] * width
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((doc_id or -99, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def repeat_rows():
    rng = random.Random(5)
    passages = [prose(50 + i, 30) for i in range(5)]
    rows = []
    for i in range(80):
        parts = [prose(1000 + i, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), prose(rng.randrange(10**6), rng.randrange(0, 9))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, prose(7, 12)), (93, prose(7, 12)), (94, prose(8, 13)), (95, prose(8, 13)), (95, prose(8, 13))]
    rows += [(96, "la " * 60), (97, "la " * 30), (98, None), (99, ""), (None, rows[3][1]), (None, None)]
    return rows


@pytest.mark.parametrize("width", [13, 3])
def test_repeats(spark, width):
    rows = repeat_rows()
    got = remove_repeats(frame(spark, rows).repartition(7), width)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect())
    expected = sorted((d if d else (0 if d == 0 else -99), *rest) for d, *rest in brute_repeats(rows, width))
    assert [f for f in found if f[0] > 0] == [e for e in expected if e[0] > 0]
    assert len(found) == len(rows)


def test_repeats_in_many_chunks(spark, monkeypatch):
    from tuneprep.llm import repeats

    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    long = prose(1, 50_000)
    rows = [(5, long), (9, long + " " + prose(2, 5)), (7, " ".join(long.split()[100:40_000]))]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(frame(spark, rows).repartition(3)).collect()}
    assert got == {5: 0, 7: 39_900, 9: 50_000}
    assert remove_repeats(frame(spark, [])).count() == 0


def brute_tiling(doc, item, least=5):
    """Mark the longest common run of unmarked words, again and again; ties to the first in the item, then in the document."""
    used_doc, used_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_doc[i + n] and not used_item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered
        for k in range(best[0]):
            used_doc[best[1] + k] = used_item[best[2] + k] = True
        covered += best[0]


def test_tiling_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(5, 30))]
        cut = rng.randrange(len(item))
        doc = [rng.choice("abcdef") for _ in range(9)] + item[cut:] + [rng.choice("abcdef") for _ in range(3)] + item[:cut]
        seeds = [(i, j) for i in range(len(doc) - 4) for j in range(len(item) - 4) if doc[i : i + 5] == item[j : j + 5]]
        assert tile(np.array(seeds).reshape(-1, 2), len(item))[0] == brute_tiling(doc, item)


def test_decontamination(spark):
    items = [(i, prose(70 + i, 40)) for i in range(6)] + [(6, "too short"), (7, None), (None, prose(99, 40)), (8, prose(70, 40))]
    first = items[0][1].split()
    rows = [(i, prose(i, 200)) for i in range(30)]
    rows += [(100, prose(1, 20) + " " + items[1][1] + " " + prose(2, 20)), (101, items[2][1].upper().replace(" ", ", "))]
    rows += [(102, " ".join(first[20:] + ["x"] + first[:20])), (103, " ".join(first[:12])), (104, None), (105, ""), (106, "too short")]
    rows += [(107, items[3][1]), (107, items[3][1]), (None, items[3][1]), (108, prose(5, 30_000) + " " + items[4][1] * 1)]
    docs, benchmark = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = contaminated(docs, benchmark)
    assert sorted(rows_of(got, "doc_id", "item_id")) == [(100, 1), (101, 2), (102, 0), (102, 8), (106, 6), (107, 3), (108, 4)]
    assert {r["coverage"] for r in got.collect()} == {1.0}
    clean = decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 7
    assert contaminated(docs.limit(0), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0


def test_items_below_a_seed(spark):
    """An item of one to four words is found where a document consists of just these words, and nowhere else."""
    items = [(i, " ".join("alpha beta gamma delta epsilon".split()[:i])) for i in range(1, 6)]
    rows = [(10 + i, text.upper() + "!") for i, text in items] + [(20, prose(1, 50) + " alpha beta gamma delta " + prose(2, 50))]
    rows += [(30, "beta alpha"), (31, "alpha alpha"), (32, ""), (33, prose(3, 8) + " alpha beta gamma delta epsilon")]
    got = contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert sorted(rows_of(got, "doc_id", "item_id", "covered")) == [(10 + i, i, i) for i in range(1, 6)] + [(33, 5, 5)]


def test_rows_of_one_id_are_one_document(spark):
    """An item's halves in two rows of one doc_id, and an item of two rows, count together."""
    item = prose(61, 20).split()
    rows = [(1, " ".join(item[:10])), (1, " ".join(item[10:])), (2, " ".join(item[:10])), (3, prose(62, 20)), (3, prose(63, 20)), (4, prose(62, 20)), (4, "one")]
    items = [(1, " ".join(item)), (2, prose(62, 20)), (2, prose(63, 20)), (3, prose(62, 20)), (3, "one")]
    got = contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert sorted(rows_of(got, "doc_id", "item_id", "item_words", "covered")) == [
        (1, 1, 20, 20), (2, 1, 20, 10), (3, 2, 40, 40), (3, 3, 21, 20), (4, 2, 40, 20), (4, 3, 21, 21)
    ]


def test_a_common_phrase_makes_no_pairs(spark, monkeypatch):
    """Seeds of a phrase that many documents and items share choose no pair; documents that hold an item are found."""
    chosen = []
    rare = decontaminate_module._rare_seeds
    monkeypatch.setattr(decontaminate_module, "_rare_seeds", lambda *a: chosen.append(rare(*a)) or chosen[0])
    phrase = prose(64, 6)
    rows = [(i, f"{prose(1000 + i, 30)} {phrase}") for i in range(60)]
    items = [(i, f"{prose(3000 + i, 30)} {phrase} {prose(4000 + i, 4)}") for i in range(40)]
    rows += [(100 + i, items[i][1]) for i in range(3)]
    got = contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert sorted(rows_of(got, "doc_id", "item_id", "covered")) == [(100 + i, i, 40) for i in range(3)]
    # Two seeds lie inside the phrase and belong to all items; the ones at its ends belong to a few at most.
    assert chosen[0].groupBy("seed").count().where("count > 10").count() == 0


def test_long_repeats_of_a_word(spark):
    got = contaminated(frame(spark, [(1, "la " * 1500)]), frame(spark, [(1, "la " * 150)], "item_id long, text string"))
    assert rows_of(got, "covered") == [(150,)]


def test_query_against_brute_force(spark):
    """Every document with every item, tiled without seeds or filters."""
    rng = random.Random(12)
    items = [(i, [rng.choice("abcdefghij") for _ in range(rng.randrange(5, 30))]) for i in range(12)]
    rows = []
    for i in range(40):
        text = [rng.choice("abcdefghij") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            cut = rng.choice(items)[1]
            a = rng.randrange(len(cut))
            text += cut[a:] + [rng.choice("abcdefghij")] + cut[:a]
        rows.append((i, text))
    expected = []
    for i, text in rows:
        for j, item in items:
            covered = brute_tiling(text, item)
            if covered / len(item) >= 0.5:
                expected.append((i, j, len(item), covered))
    docs = frame(spark, [(i, " ".join(t)) for i, t in rows])
    got = contaminated(docs, frame(spark, [(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert sorted(rows_of(got, "doc_id", "item_id", "item_words", "covered")) == sorted(expected)
