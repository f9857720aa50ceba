"""Hard negatives against scoring every pair."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import frame

from tuneprep.llm import hard_negatives

FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every, k=5, least=80):
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    out = []
    for a, own, v in whole:
        if a % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, label) for i, label, w in whole if i != a)
        for s, p, _ in [x for x in found if x[2] == own][:k]:
            inside = [x for x in found if x[2] != own and least * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(inside[:k])]
    return sorted(out)


def vectors(seed, n, d=6, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(i - 40, rng.randrange(4), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def found(spark, rows, **options):
    table = frame(spark, rows, SCHEMA).repartition(5)
    return sorted(tuple(r[c] for c in FIELDS) for r in hard_negatives.mine(table, **options).collect())


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_equals_all_pairs(spark, spread):
    rows = vectors(1, 400, spread=spread)
    rows += [(1000 + i, 2, rows[0][2]) for i in range(130)]  # one vector and label hold a quarter of all rows
    rows += [(2000 + i, i % 4, [0.0] * 6) for i in range(8)] + [(3000 + i, 1, [-x for x in rows[i][2]]) for i in range(20)]
    expected = plain(rows, 10)
    assert expected
    assert found(spark, rows, every=10, block_rows=50, block_anchors=16) == expected


def test_rows_that_take_no_part(spark):
    rows = vectors(2, 120)
    bad = [
        (500, None, rows[0][2]), (501, 1, None), (502, 1, [None, *rows[0][2][1:]]), (503, 2, [math.nan] * 6), (504, 2, [math.inf] * 6),
        (505, 1, []), (506, 1, [1.0]), (None, 1, rows[0][2]),
    ]
    assert found(spark, rows + bad + rows[:30], every=10) == plain(rows, 10)
    doubled = [(7, 1, rows[47][2]), (7, 0, rows[3][2])]
    kept = [r for r in rows if r[0] != 7] + doubled[1:]
    assert found(spark, [r for r in rows if r[0] != 7] + doubled, every=10) == plain(kept, 10)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == plain([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])], 100)
    large = [(0, 1, [3e10, 1.0]), (1, 1, [1000.0, 1.0]), (2, 2, [999.0, 1.0]), (3, 2, [999.0, 2.0])]
    assert found(spark, large) == plain(large, 100) != []


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    rows = np.floor(256 * (centres[rng.integers(0, 5, 800)] + rng.normal(size=(800, 16)) * 0.02))
    rows[:3] = 0
    directions = hard_negatives.references(rows)
    measured, norms = hard_negatives.angles(rows, directions), hard_negatives.norms_of(rows)
    low, high = hard_negatives.score_bounds(measured[:200], norms[:200], measured, norms)
    exact = rows[:200] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert ((high - low)[3:, 3:] < 0.5 * np.outer(norms[3:200], norms[3:])).mean() > 0.9
