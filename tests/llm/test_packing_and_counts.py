"""Token counts and packing against plain Python."""

import itertools
import random

import numpy as np
import pytest

from inspectra.llm import packing, token_counts
from inspectra.llm.common import rank_encoder, vocabulary_path


def n_tokens(text):
    return len(rank_encoder(vocabulary_path("byte_bpe_50k.tiktoken")).encode_ordinary(text or ""))


def rows():
    rng = random.Random(8)
    texts = [None, "", "a", "   ", "word " * 3000, "x" * 5000] + ["tok " * rng.randrange(1, 90) for _ in range(60)]
    return list(enumerate(texts)) + [(9, "tok tok"), (9, "tok tok"), (None, "no id")]


def frame(spark, data=None):
    return spark.createDataFrame([(*r, 1, "z") for r in (rows() if data is None else data)], "doc_id long, text string, n_tokens int, batch string")


def test_histogram_and_suffix_sums(spark, scratch, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    lengths = [n_tokens(t) for _, t in rows()]
    hist = scratch.table(token_counts.length_histogram(frame(spark)), "h")
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == {x: lengths.count(x) for x in lengths}
    sums = token_counts.suffix_sums(hist).collect()
    assert len(sums) == len(set(lengths))
    for r in sums:
        over = [x for x in lengths if x > r.n_tokens]
        assert (r.docs_over, r.tokens_over, r.total_docs, r.total_tokens) == (len(over), sum(over), len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.quantile == pytest.approx(1 - len(over) / len(lengths))


def test_any_limit_and_quantiles(spark, scratch):
    lengths = sorted(n_tokens(t) for _, t in rows())
    hist = scratch.table(token_counts.length_histogram(frame(spark)), "h")
    limits = [0, 1, 7, 50, 51, 2048, 10**9]
    got = {r.context_limit: (r.docs_over, r.truncated_total) for r in token_counts.truncated_totals(hist, limits).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    for r in token_counts.quantiles(token_counts.suffix_sums(hist), [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == next(x for x in lengths if sum(n <= x for n in lengths) >= r.share * len(lengths))


def test_empty_tables(spark, scratch):
    none = frame(spark, [])
    assert token_counts.suffix_sums(token_counts.length_histogram(none)).count() == 0
    assert packing.pack(none, scratch).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), int(rng.integers(1, 11)), replace=False))
    counts = rng.integers(1, 9, len(lengths))
    for k in (1, 2, 3, 5, 20):
        def padding(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))
        m = min(k, len(lengths))
        best = min(padding((*inner, lengths[-1])) for inner in itertools.combinations(lengths[:-1], m - 1))
        bounds, cost = packing.optimal_boundaries(lengths, counts, k)
        assert cost == best == padding(bounds) and len(bounds) == m and bounds == sorted(bounds)


def test_boundaries_of_a_wide_histogram():
    rng = np.random.default_rng(1)
    x, c = np.arange(1, 400), rng.integers(1, 100, 399)
    _, cost = packing.optimal_boundaries(x, c, 6)
    n, t = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]
    best = np.array([0, *(x * n[1:] - t[1:])], float)
    for _ in range(5):  # plain quadratic programme
        best = np.array([0] + [min(best[i] + x[j - 1] * (n[j] - n[i]) - (t[j] - t[i]) for i in range(j)) for j in range(1, 400)])
    assert cost == best[-1]


@pytest.mark.parametrize("shard", [4096, 5])
def test_every_token_is_packed_once(spark, scratch, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard)
    out = [r.asDict() for r in packing.pack(frame(spark), scratch, max_len=64, n_buckets=4, token_budget=300).collect()]
    want = sorted(((i, p, 64 * p, min(64, n - 64 * p)) for i, t in rows() for n in [n_tokens(t)] for p in range(max(1, -(-n // 64)))), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["start_token"], r["n_tokens"]) for r in out), key=str) == want
    full = [r for r in out if r["n_tokens"]]
    assert all(r["bucket_len"] is None and r["batch"] is None for r in out if not r["n_tokens"])
    sizes = [r["n_tokens"] for r in full]
    bounds, cost = packing.optimal_boundaries(*np.unique(sizes, return_counts=True), 4)
    assert sum(r["padding"] for r in full) == cost
    for b in bounds:
        own = [(r["batch"], r["slot"]) for r in full if r["bucket_len"] == b]
        per = max(1, 300 // b)
        assert sorted(own) == [(i // per, i % per) for i in range(len(own))]  # full batches, the last one partly
    assert all(r["n_tokens"] <= r["bucket_len"] and not any(r["n_tokens"] <= b < r["bucket_len"] for b in bounds) for r in full)


def test_very_long_texts_and_runs_of_white_space(spark, scratch):
    """Runs that the encoder's splitting can't take; the operator's own encoder tells the right counts."""
    from inspectra.llm import bpe
    texts = [" " * 1_000_000 + "x", "word  and\n\n more " * 60_000, "\n" * 700_000, "a" + "\u00a0" * 300_000 + " b", " \t" * 400_000 + "end " + " " * 20_000 + "\nz",
             "x" * 1_000_000, "\x1c" * 20_000 + "a" * 100_000]
    own = bpe.load(vocabulary_path("byte_bpe_50k.json")).encode(texts)[1].tolist()
    df = frame(spark, list(enumerate(texts)))
    hist = token_counts.length_histogram(df)
    assert sorted(r.n_tokens for r in hist.collect() for _ in range(r.n_docs)) == sorted(own)
    packed = packing.pack(df, scratch).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed} == dict(enumerate(own))
