import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, side int, vec string"


def brute(rows):
    v = {}
    for i, e, label, *_ in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * x) if abs(x) < 1e300 else 2**40 for x in e]
        if sum(x * x for x in q) >= 2**62:
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, q)
        v[i] = min(v.get(i, own), own)
    score = lambda a, b: sum(x * y for x, y in zip(v[a][1], v[b][1]))
    out = []
    for a in (i for i in v if i % 50 == 0):
        best = lambda same, a=a: sorted((-score(a, b), b) for b in v if b != a and (v[b][0] == v[a][0]) == same)
        others = best(False)
        for minus, b in best(True)[:5]:
            p = -minus
            found = [(-s, n) for s, n in others if 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, b, r, n, p, s) for r, (s, n) in enumerate(found, 1)]
    return sorted(out)


def vectors(n=600, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, (x[i] / np.linalg.norm(x[i])).tolist(), int(rng.integers(0, 3)), "n", i, "v") for i in range(n)]


def mined(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/embeddings.parquet")
    return sorted(tuple(r) for r in queries.op11_hard_negatives(spark, path).collect())


@pytest.mark.parametrize("sizes", [(65536, 4096, 1024), (3, 70, 16)])
def test_equals_brute_force(spark, tmpdir_path, monkeypatch, sizes):
    for name, value in zip(("GROUP_ANCHORS", "MIN_RUN_ROWS", "BLOCK"), sizes):
        monkeypatch.setattr(hard_negatives, name, value)
    if sizes[0] < 10:
        monkeypatch.setattr(hard_negatives, "RUN_ROWS", 70)
    rows = vectors()
    rows += [(50 * 1000 + i, rows[i][1], rows[i][2], "n", 0, "v") for i in range(0, 200, 10)]  # copies: ties
    assert mined(spark, tmpdir_path, rows) == brute(rows) != []


def test_odd_rows(spark, tmpdir_path):
    rows = vectors(120, 4)
    e = rows[0][1]
    odd = [(200, None, 1), (250, e, None), (300, [1.0, None, 0.0, 0.0], 1), (350, [math.nan] * 4, 1), (400, [math.inf, 0.0, 0.0, 0.0], 1),
           (450, [0.0] * 4, 1), (500, [], 1), (550, [0.5], 2), (600, [1e6] * 4, 0), (650, [-1e6] * 4, 0), (700, [1e200] * 4, 1),
           (750, [1e308] * 4, 1), (None, e, 1), (800, [8e6] * 4, 0), (801, [8e6 - 1] * 4, 0), (802, [7e6] * 4, 1), (850, e, 77)]
    rows += [(*r, "n", 0, "v") for r in odd] + rows[:3] + [(50, e, 2, "n", 0, "v")]
    assert mined(spark, tmpdir_path, rows) == brute(rows) != []


def test_empty_tables(spark, tmpdir_path, scratch):
    assert mined(spark, tmpdir_path, []) == []
    alone = spark.createDataFrame([(0, 1, [1, 2]), (1, 2, [2, 2])], "id long, label long, vec array<int>")
    assert hard_negatives.mine(alone, scratch, F.col("id") == 0).collect() == []


def test_the_walk_ends_early_and_certified(spark):
    """Two opposite clouds: members of one never see the other, and still have the right answers."""
    rng = np.random.default_rng(1)
    side = np.repeat([1, -1], 3000)[:, None]
    c = np.rint(256 * (side * np.r_[1.0, np.zeros(15)] + 0.1 * rng.normal(size=(6000, 16)))).astype(np.int64)
    x = c[:200]
    low, high = np.full((200, 1), -2**62), np.full((200, 1), 2**62)
    centre = np.r_[1.0, np.zeros(15)]
    (m, _, n, s), walked = hard_negatives.walk(x, lambda i, j: i[:, None] != j[None, :], low, high, centre, c, np.arange(6000), 5)
    assert walked.max() <= 4096 and len(m) == 1000
    for i in range(0, 200, 20):
        want = sorted((-int(x[i] @ c[j]), j) for j in range(6000) if j != i)[:5]
        assert sorted((-a, b) for a, b in zip(s[m == i], n[m == i])) == want
