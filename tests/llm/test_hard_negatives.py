import math
import random

import numpy as np
import pytest

from tests.llm import odd
from tideline.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, node string, leaf int, x string, score double, rank int, `at` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "x", 0.5, 2, 3) for r in rows], SCHEMA)


def expected(rows):
    """All pairs, in Python's integers."""
    kept = []
    for vec_id, x, label in rows:
        if x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in x], label))
    out = []
    for a, (vec_id, x, label) in enumerate(kept):
        if vec_id is None or vec_id % 100:
            continue
        scores = sorted(((-sum(u * v for u, v in zip(x, y)), i is None, i or 0, k != label) for b, (i, y, k) in enumerate(kept) if b != a), key=lambda s: s[:3])
        for p, missing, positive, _ in [s for s in scores if not s[3]][:5]:
            fits = [s for s in scores if s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(vec_id, None if missing else positive, rank, None if s[1] else s[2], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(n, width, seed, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    x = middle[rng.integers(centres, size=n)] + 0.5 * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.fixture
def small_leaves(monkeypatch):
    """So small that the tree has several levels and leaves have several blocks."""
    for name, value in (("LEAF", 60), ("BLOCK", 25), ("ASKED", 4), ("FAN", 4)):
        monkeypatch.setattr(hard, name, value)


def test_odd_rows(spark, small_leaves):
    rng = random.Random(3)
    rows = [(i, x, rng.randrange(10)) for i, x in enumerate(vectors(1500, 8, 1))]
    same = vectors(1, 8, 2)[0]
    rows += [(5000 + i, same, i % 3) for i in range(700)]  # a third of all rows
    rows += [(100, rows[100][1], 3), (100, rows[100][1], rows[100][2]), (None, rows[0][1], 4), (None, rows[0][1], rows[0][2])]
    rows += [(9000, None, 1), (9100, rows[5][1], None), (9200, [0.1, None], 2), (9300, [float("nan")] * 8, 2), (9400, [float("inf")] * 8, 2)]
    rows += [(9500, [], 1), (9600, [0.0] * 8, 1), (9700, [0.5, -0.25], 1), (9800, [-v for v in same], 5), (-100, same, 9), (9900, [0.3] * 12, 6)]
    assert odd.rows_of(hard.hard_negatives(table(spark, rows))) == expected(rows)


def test_large_components(spark, small_leaves):
    rows = [(i, [(-1) ** i * 2.0 ** 20 + i, float(i)], i % 4) for i in range(300)]
    assert odd.rows_of(hard.hard_negatives(table(spark, rows))) == expected(rows)
    huge = [(i, [3e38, 1.0], i % 2) for i in range(300)]
    assert hard.hard_negatives(table(spark, huge)).count() == 0  # scores beyond 64 bits


def test_few_rows(spark):
    assert hard.hard_negatives(table(spark, [])).count() == 0
    assert hard.hard_negatives(table(spark, [(0, [1.0], 1)])).count() == 0
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.5, 0.1], 2), (3, [0.95, 0.0], 2)]
    assert odd.rows_of(hard.hard_negatives(table(spark, rows))) == expected(rows) != []


def test_the_tree_eliminates_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(hard, "FAN", 6)
    x = hard.scaled(np.array(vectors(4000, 6, 5, centres=30)))
    nodes, leaves = hard.grown(x[::4], 25)
    found = {}

    def see(at, rows, far, nearest):
        norm = np.sqrt((x[rows] ** 2).sum(1))
        for child in np.unique(nearest):
            for split, d in enumerate(np.vstack([norm, far.T])[:, nearest == child], -1):
                low, high = found.get((at, split, child), (np.inf, -np.inf))
                found[at, split, child] = min(low, d.min()), max(high, d.max())

    leaf = hard._descend(nodes, x, see)
    tree = hard.Tree(nodes, leaves, [(*key, *value) for key, value in found.items()])
    asks = x[:200]
    score = (asks @ x.T).astype(np.int64)
    high = np.sort(score, axis=1)[:, [-5, -50]]
    low = np.sort(score, axis=1)[:, [-12, -70]]
    met = {(q, w, to) for to, rows, alive in tree.leaves_of(asks, low, high) for i, q in enumerate(rows) for w in np.flatnonzero(alive[i])}
    for w in range(2):
        for q, row in zip(*np.nonzero((score >= low[:, [w]]) & (score <= high[:, [w]]))):
            assert (q, w, leaf[row]) in met
    assert len(met) < 0.8 * 2 * len(asks) * leaves


def test_given_vectors(spark):
    given = spark.read.parquet(f"{odd.SF_DIR}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in given.collect()]
    assert odd.rows_of(hard.hard_negatives(given)) == expected(rows) != []
