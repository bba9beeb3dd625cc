"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from inspectra.llm import simhash
from inspectra.llm import components as graph
from inspectra.llm.components import components
from .conftest import union_find


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "ΔX", "eps ilon", "zeta", "eta", "theta", "iota", "a b"]
    out = [None, "", " \n\t", "one", "one two", "One  TWO\nthree", "one two three"]
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.choice([5, 60, 400]))]
        out += [" ".join(base), "\n".join(base)]
        for _ in range(rng.randrange(4)):
            near = list(base)
            near[rng.randrange(len(near))] = "swap"
            out.append("  ".join(near))
    out.append("w " * 40000)  # very long, several hash chunks
    return out


def test_fingerprint_matches_definition():
    for t in texts():
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def check(spark, scratch, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, scratch).collect()}
    fps = {r[0]: slow_fingerprint(r[1]) for r in rows}
    ids = list(fps)
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = union_find(near, ids)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_documents_match_brute_force(spark, scratch):
    check(spark, scratch, list(enumerate(texts())))


def test_clashing_columns_and_empty_table(spark, scratch):
    rows = [(5, "a b c d", 1, "x"), (2, "a b c d", 2, None), (9, None, 3, "y")]
    check(spark, scratch, rows, "doc_id long, text string, fp int, component_id string")
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), scratch).count() == 0


def test_repeated_rows_and_null_ids(spark, scratch):
    docs = spark.createDataFrame([(4, "x y z"), (4, "x y z"), (None, "x y z"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, scratch).collect()), key=str)
    assert got == [(4, 4), (4, 4), (None, 4), (None, None)]


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_links_connect_what_hamming_links_connect(spark, scratch, monkeypatch, bits, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)  # 40: full cells go block by block
    monkeypatch.setattr(simhash, "SHORT_RUN", 10)
    rng = np.random.default_rng(bits)
    fps = set()
    for _ in range(30):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        fps.add(x)
        for _ in range(int(rng.integers(0, 12))):
            x ^= sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, bits + 3)), replace=False))
            fps.add(x)
    centre = 0xFFFF0000FFFF0000
    fps |= {centre ^ (1 << k) for k in range(64)}  # a dense group
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash.links(df, scratch, bits)
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= bits for a, b in found.collect())
    nodes = [signed(x) for x in fps]
    want = union_find([(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits], nodes)
    got = {n: n for n in nodes} | {r.node: r.component for r in components(found, scratch).collect()}
    assert got == want


@pytest.mark.parametrize("last", [0, 20, 1 << 18])  # rounds to the end, rounds and then one task, one task
def test_components_of_a_chain_a_star_and_loops(spark, scratch, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST_EDGES", last)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    real = [(a, b) for a, b in edges if a is not None]
    nodes = {x for e in real for x in e}
    got = {r.node: r.component for r in components(df, scratch).collect()}
    assert got == {n: c for n, c in union_find(real, nodes).items()}
    assert components(spark.createDataFrame([], "a string, b string"), scratch).count() == 0
