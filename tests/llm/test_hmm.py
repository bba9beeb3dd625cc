import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.llm import hmm, queries

SCHEMA = "doc_id long, text string, lang string, _row string, score string, rare int"


def model(states=3, symbols=7, seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T.copy())


def all_paths(o, m):
    """Likelihood as the sum over every state path."""
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(o)):
        p = m.start[path[0]] * m.emit[o[0], path[0]]
        for a, b, x in zip(path, path[1:], o[1:]):
            p *= m.step[a, b] * m.emit[x, b]
        total += p
    return math.log(total)


def plain(o, m):
    """Unscaled forward-backward of one sequence: log likelihood, starts, steps, emissions."""
    n, k = len(o), len(m.start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = m.start * m.emit[o[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m.step) * m.emit[o[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.step @ (m.emit[o[t + 1]] * b[t + 1])
    whole = a[-1].sum()
    share, steps, emissions = a * b / whole, np.zeros((k, k)), np.zeros_like(m.emit)
    for t in range(n - 1):
        steps += np.outer(a[t], m.emit[o[t + 1]] * b[t + 1]) * m.step / whole
    np.add.at(emissions, o, share)
    return math.log(whole), share[0], steps, emissions


@pytest.mark.parametrize("segment", [1, 2, 3, 5, 100])
def test_recursions_equal_brute_force(segment):
    m = model()
    sizes = [1, 2, 5, 9, 23, 4, 17, 40]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.random.default_rng(1).integers(0, 7, ends[-1])
    each = [flat[i:j] for i, j in zip(ends, ends[1:])]
    want = [plain(o, m) for o in each]
    for o in each[:4]:
        assert all_paths(o, m) == pytest.approx(plain(o, m)[0])
    assert np.allclose(hmm.log_likelihoods(flat, ends, m, segment), [w[0] for w in want])
    starts, steps, emissions, log = hmm.expected_counts(flat, ends, m, segment)
    assert log == pytest.approx(sum(w[0] for w in want))
    for got, i in ((starts, 1), (steps, 2), (emissions, 3)):
        assert np.allclose(got, sum(w[i] for w in want))


def test_nothing_underflows():
    m = model(2, 5000, 3)
    flat = np.random.default_rng(2).integers(0, 5000, 60_000)
    whole = hmm.log_likelihoods(flat, np.array([0, 60_000]), m, 1000)
    assert np.isfinite(whole).all() and np.allclose(whole, hmm.log_likelihoods(flat, np.array([0, 60_000]), m, 100_000))
    assert all(np.isfinite(x).all() for x in hmm.expected_counts(flat, np.array([0, 60_000]), m, 1000))


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


def base_of(rows):
    """doc_id -> n_tokens, n_known, train_tokens, base_score; and the training counts."""
    held = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1
    c = Counter(t for r in rows if not held(r) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        t = tokens(r[1])
        out.append((r[0], held(r), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    return out, c


def documents():
    rng = np.random.default_rng(5)
    kinds = [[f"{p}{i}{s}" for i in range(60)] for p, s in (("a", "ing"), ("b", "ung"), ("C", "tion"))]
    rows = []
    for i in range(300):
        words = rng.choice(kinds[i % 3], rng.integers(1, 200) if i else 5000)
        rows.append((i, ["\n", " ", " \t"][i % 3].join(words) + (f" only{i} {'x' * 70} Été " if i % 4 == 0 else ""), "en", "a", "s", 3))
    return rows + [(400, None, "en", "a", "s", 1), (401, "", "en", "a", "s", 1), (402, " \t\n", "en", "a", "s", 1), (None, "a1ing word", "en", "a", "s", 1), *rows[:2]]


@pytest.mark.parametrize("known, own", [(1 << 17, 1 << 14), (40, 10), (0, 0)])
def test_counts_and_score_equal_brute_force(spark, scratch, tmpdir_path, monkeypatch, known, own):
    """The same counts however few words every task holds; the score is the model's own probability of the text."""
    for name, value in (("KNOWN", known), ("OWN_WORDS", own), ("_BYTES", 1000), ("_FLUSH", 50)):
        monkeypatch.setattr(hmm, name, value)
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmpdir_path}/documents.parquet")
    seen = {}
    fit, read = hmm.train, hmm.vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a: seen.setdefault("model", fit(*a)))
    monkeypatch.setattr(hmm, "vocabulary", lambda *a: seen.setdefault("vocabulary", read(*a)))
    got = sorted((tuple(r) for r in queries.op12_hmm_scores(spark, tmpdir_path).collect()), key=lambda r: (str(r[0]), r[2]))
    want, c = base_of(rows)
    want = sorted(want, key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    # the score, from the model's parameters and the brute-force counts
    (m, history), (v, _) = seen["model"], seen["vocabulary"]
    assert history == sorted(history) and np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.step.sum(axis=1), 1)
    symbol = {w.decode(): i for i, w in enumerate(v.words[:v.own])}
    shared = Counter(hmm.ending(w.encode()) for w in c if w not in symbol and w != " ")
    total = Counter()
    for w in c:
        if w not in symbol and w != " ":
            total[hmm.ending(w.encode())] += c[w]
    by_id = {r[0]: r[1] for r in rows}
    for row in got[::7] + got[-5:]:
        o, inner = [], 0.0
        for w in tokens(by_id[row[0]]):
            e = hmm.ending(w.encode())
            o.append(len(symbol) + hmm.ENDINGS if w == " " else symbol.get(w, len(symbol) + e))
            if w != " " and w not in symbol:
                inner += math.log10((c[w] + 0.5) / (total[e] + 0.5 * (shared[e] + 1)))
        log = hmm.log_likelihoods(np.array(o), np.array([0, len(o)]), m, 10**6)[0] / math.log(10)
        assert row[6] == pytest.approx(log + inner, rel=1e-6)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than word counts on texts it hasn't seen


def test_nothing_to_learn_from_and_empty_table(spark, scratch):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = sorted(tuple(r) for r in hmm.score(docs, scratch, F.lit(False)).collect())
    assert [r[:4] for r in got] == [(1, 3, 0, 0), (2, 1, 0, 0)] and [r[4] for r in got] == [0, 0] and all(np.isfinite(r[5]) for r in got)
    assert hmm.score(docs.limit(0), scratch, F.lit(True)).collect() == []


def test_held_out_documents_of_the_tables(spark):
    rows = queries.op12_hmm_scores(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
