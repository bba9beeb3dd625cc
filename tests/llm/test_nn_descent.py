"""NN-descent near-duplicates against brute force."""

import math

import numpy as np
import pytest

from inspectra.llm import nn_descent as nd

from .conftest import union_find

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, threshold=0.95):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [None if i is None else unit(v) for i, v in rows]
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold]
            for i, a in enumerate(units)]
    ids = {i for i, _ in rows if i is not None}
    group = union_find([(rows[i][0], rows[j][0]) for i, js in enumerate(near) for j in js], ids)
    return sorted(((i, len(js), group.get(i), i is not None and group[i] == i) for (i, _), js in zip(rows, near)), key=str)


def got(spark, scratch, rows, schema=SCHEMA):
    out, audits = nd.near_duplicates(spark.createDataFrame(rows, schema).repartition(3), scratch)
    out = sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in out.collect()), key=str)
    return out, audits


def groups(rng, sizes, dim, noise):
    rows = []
    for s in sizes:
        base = rng.standard_normal(dim)
        for _ in range(s):
            rows.append((base + noise * rng.standard_normal(dim)).astype(np.float32).tolist())
    return [(int(i), v) for i, v in zip(rng.permutation(5 * len(rows))[:len(rows)], rows)]


def test_groups_of_near_copies(spark, scratch):
    rows = groups(np.random.default_rng(1), [1] * 150 + [2] * 20 + [3, 7, 12, 90], 32, 0.08)
    out, audits = got(spark, scratch, rows)
    assert out == brute(rows) and audits[-1][0] == audits[-1][1] > 0


def test_wide_groups_are_counted_exactly_in_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = groups(rng, [1] * 40 + [70, 30], 12, 0.22)  # many pairs of a group are below the threshold
    arc = [(1000 + i, [math.cos(i / 40), math.sin(i / 40), 0.01]) for i in range(60)]  # a chain along an arc
    rows += arc
    assert got(spark, scratch, rows)[0] == brute(rows)


def test_copies_scaled_copies_and_odd_vectors(spark, scratch):
    a, b = [1.0, 2.0, 3.0, -1.0], [2.0, 4.0, 6.0, -2.0]
    rows = [(5, a), (3, a), (3, a), (9, b), (7, [0.0] * 4), (8, None), (10, []), (11, [1.0, None, 2.0, 3.0]), (12, [float("nan"), 1.0, 2.0, 3.0]),
            (13, [float("inf"), 1.0, 1.0, 1.0]), (14, [1e-44, 2e-44, 3e-44, -1e-44]), (15, [1e38, 2e38, 3e38, -1e38]), (16, a[:3]), (None, a),
            (17, [-x for x in a]), (18, a[:3])]
    want = brute(rows)
    out, _ = got(spark, scratch, [(*r, "x", 1) for r in rows], SCHEMA + ", component_id string, node int")
    assert out == want


def test_one_and_no_vectors(spark, scratch):
    assert got(spark, scratch, [(4, [1.0, 0.0])])[0] == [(4, 0, 4, True)]
    assert got(spark, scratch, [(4, None)])[0] == [(4, 0, 4, True)]
    out, _ = nd.near_duplicates(spark.createDataFrame([], SCHEMA), scratch)
    assert out.count() == 0


def test_lists_double_when_saturated(spark, scratch):
    nodes = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0])], "node long, v array<float>")
    lists = spark.createDataFrame([(1, 2, 0.99, 1), (2, 1, 0.99, 2), (3, 1, 0.5, 1)], "a long, b long, sim double, k int")
    state = {r.node: (r.k, r.worst, r.saturated) for r in nd._sizes(nodes, lists, 0.95).collect()}
    assert state == {1: (2, -1.5, True), 2: (2, -1.5, False), 3: (1, 0.5, False)}


def test_refinement_finds_neighbours_of_neighbours(spark, scratch):
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.2]), (3, [1.0, 0.4]), (4, [-1.0, 0.0])], "node long, v array<float>")
    lists = spark.createDataFrame([(1, 2, 0.98, 8), (3, 2, 0.98, 8)], "a long, b long, sim double, k int")
    found = nd.refine(nodes, lists, scratch.table(nd._sizes(nodes, lists, 0.95), "s"), scratch)
    assert (1, 3) in {(r.a, r.b) for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_best_is_top_k(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(40)
    a, b, s = nd._best(ids, x, np.full(40, 5), np.full(40, 0.2))
    sims = x @ x.T - 3 * np.eye(40)
    want = {(i, j) for i in range(40) for j in np.argsort(-sims[i])[:5] if sims[i, j] > 0.2}
    assert set(zip(a.tolist(), b.tolist())) == want and np.allclose(s, sims[a, b])


def tight_pair(rng, size, cosine=0.96, dim=16):
    """Two groups of near-equal vectors whose centres have the given cosine."""
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    b = cosine * a + math.sqrt(1 - cosine ** 2) * b
    return [(g * size + i, (c + 0.0005 * rng.standard_normal(dim)).astype(np.float32).tolist()) for g, c in enumerate((a, b)) for i in range(size)]


def test_links_between_tight_groups_are_kept(spark, scratch):
    rows = tight_pair(np.random.default_rng(5), 40)
    want = brute(rows)
    assert all(r[1:3] == (79, 0) for r in want)
    assert got(spark, scratch, rows)[0] == want


def test_a_leaf_connects_what_its_pairs_connect():
    x = np.array([v for _, v in tight_pair(np.random.default_rng(6), 30)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(60)
    a, b, s = nd._best(ids, x, np.full(60, 8), np.full(60, -1.5), 0.95)
    assert np.allclose(s, (x @ x.T)[a, b])
    links = [(int(i), int(j)) for i, j, c in zip(a, b, s) if c >= 0.95]
    assert set(union_find(links, list(range(60))).values()) == {0}


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    rng = np.random.default_rng(7)
    small = [v for _, v in groups(rng, [2] * 50, 32, 0.01)]
    hot = [v for _, v in groups(rng, [300], 32, 0.01)]
    nodes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(hot + small)], "node long, v array<float>, w long").coalesce(1)

    def recall(counts):
        found, there = nd.audit(nodes, spark.createDataFrame(counts, "node long, component long, n_links long").coalesce(1), 0.95)
        return found / there

    pairs = [(300 + i, 300 + i // 2 * 2, 1) for i in range(100)]
    assert recall([(i, 0, 299) for i in range(300)] + pairs) == 1
    assert recall([(i, 0, 299) for i in range(300)]) < 0.1  # every pair is lost: 100 of 89,800 links
    assert recall([(i, i % 2, 149) for i in range(300)] + pairs) < 0.7  # the hot group is in two


def test_missed_target_is_an_error(spark, scratch, monkeypatch):
    monkeypatch.setattr(nd, "ATTEMPTS", 1)
    monkeypatch.setattr(nd, "_descend", lambda *_: spark.createDataFrame([], "node long, component long"))
    with pytest.raises(RuntimeError, match="recall below"):
        got(spark, scratch, groups(np.random.default_rng(8), [2] * 5, 32, 0.01))


def test_orders_grow_with_the_rows():
    assert nd.orders_for(0, 0.95) == nd.orders_for(256, 0.95) == nd.ORDERS
    some = [nd.orders_for(10 ** e, 0.95) for e in (5, 6, 7, 8)]
    assert some == sorted(set(some)) and some[0] > nd.ORDERS


@pytest.mark.parametrize("hub", [4096, 4])
def test_neighbours_of_a_hub_meet_others_in_other_rounds(spark, scratch, monkeypatch, hub):
    monkeypatch.setattr(nd, "GROUP", 3)
    monkeypatch.setattr(nd, "HUB", hub)
    nodes = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(9)], "node long, v array<float>")
    lists = spark.createDataFrame([(i, 0, 0.99, 8) for i in range(1, 9)], "a long, b long, sim double, k int")
    sizes = scratch.table(nd._sizes(nodes, lists, 0.95), "s")
    met = [{(r.a, r.b) for r in nd.refine(nodes, lists, sizes, scratch, turn=turn).collect() if 0 < r.a < r.b} for turn in range(3)]
    assert met[0] != met[1] and len(set.union(*met)) > len(met[0])


def test_tiny_huge_and_ring_vectors_link(spark, scratch):
    """Double vectors whose length leaves the range of a double, and a ring whose centre is the origin."""
    rng = np.random.default_rng(6)
    rows = [(2 * i + b, (np.array([1.0, 2.0, 3.0]) * s).tolist()) for i, s in enumerate((1e-200, 1e200, 5e-324, 1e307, 1.0)) for b in (0, 1)]
    ring = [(100 + i, [math.cos(2 * math.pi * i / 40), math.sin(2 * math.pi * i / 40), 0.0]) for i in range(40)]
    rows += ring + [(200 + i, rng.standard_normal(3).tolist()) for i in range(30)]
    out, _ = nd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch)
    found = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    units = {}
    for i, v in rows:
        x = np.array(v) / np.abs(v).max()
        units[i] = x / np.linalg.norm(x)
    near = {i: [j for j in units if j != i and units[i] @ units[j] >= 0.95] for i in units}
    group = union_find([(i, j) for i, js in near.items() for j in js], set(units))
    assert found == {i: (len(near[i]), group[i]) for i in units}
    assert found[100][0] >= 4  # two neighbours a side within 18.2 degrees
