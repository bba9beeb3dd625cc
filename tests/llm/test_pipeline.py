"""Every stage of the pipeline against brute force on its own input, and the whole of it."""

import numpy as np
import pytest

import corpus_pipeline as cp
from conftest import SF_SMALL
from inspectra.llm import langid, packing, quality, simhash
from inspectra.llm.common import read_table

from . import test_line_dedup, test_packing_and_counts, test_quality, test_simhash
from .conftest import union_find

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def states(spark):
    """The documents before the first stage and after each."""
    from inspectra.llm.common import Scratch
    scratch = Scratch(spark, "states")
    docs = read_table(spark, SF_SMALL, "documents")
    odd = [(900_001, None, "en", "odd", 0), (900_002, "", "en", "odd", 0), (900_003, "123 456", None, None, None), (None, "no id", "en", "odd", 5)]
    again = docs.where("doc_id < 3")
    docs = scratch.table(docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(again), "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(scratch.table(stage(spark, out[-1], SF_SMALL), name.replace(" ", "-")))
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_the_order_and_the_columns(states):
    assert [n for n, _ in cp.STAGES] == ["language ID", "quality rules", "line dedup", "SimHash near-dedup", "packing"]
    assert all(df.columns == COLUMNS for df in states[:5])


def test_language_stage(states):
    model = langid.fit(langid.learnable(states[0]))
    want = []
    for i, t in texts(states[0]):
        counts, letters = langid.ngram_counts([t or ""])
        v = np.log1p(counts[0]) * model.idf
        cos = model.centroids.astype(float) @ v / (np.linalg.norm(v) or 1)
        if letters[0] and cos.max() >= model.floor[int(np.argmax(cos))]:
            want.append((i, t))
    assert texts(states[1]) == sorted(want, key=str) and len(want) < states[0].count()


def test_quality_stage(spark, states):
    labels = [tuple(r) for r in read_table(spark, SF_SMALL, "labels", "doc_id", "quality", "toxic").collect()]
    data = texts(states[1])
    llr = test_quality.brute(spark, data, labels)
    ok = {i: not test_quality.base(t)[-1] for i, t in data}
    steps = {}
    for i, q, _ in labels:
        if ok.get(i):
            steps.setdefault(int(np.floor(llr[i] * 1000)), [0, 0])[q] += [i for i, _ in data].count(i)
    order = sorted(steps)
    total = [sum(s[k] for s in steps.values()) for k in (0, 1)]
    gain = [quality.GOOD_WEIGHT * sum(steps[s][1] for s in order[n:]) / total[1] - sum(steps[s][0] for s in order[n:]) / total[0] for n in range(len(order))]
    at = int(np.argmax(gain))
    cut = (order[at] + order[at - 1] + 1) / 2000 if at else order[0] / 1000
    assert texts(states[2]) == [(i, t) for i, t in data if ok[i] and llr[i] >= cut]


def test_line_stage(states):
    data = texts(states[2])
    gone = {(i, n) for i, n, *_, kept in test_line_dedup.brute(data) if not kept}
    want = []
    for i, t in data:
        left = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        if any(x.strip(" \t\x0b\x0c\r") for x in left):
            want.append((i, "\n".join(left)))
    assert texts(states[3]) == sorted(want, key=str)


def test_simhash_stage(states):
    data = texts(states[3])
    fps = {i: test_simhash.slow_fingerprint(t) for i, t in data if i is not None}
    group = union_find([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    want = {(i, t) for i, t in data if i is not None and group[i] == i}
    assert texts(states[4]) == sorted(want | {(i, t) for i, t in data if i is None}, key=str)


def test_packing_stage(states):
    got = states[5].collect()
    want = sorted((i, p, min(packing.MAX_LEN, n - p * packing.MAX_LEN)) for i, t in texts(states[4]) for n in [test_packing_and_counts.n_tokens(t)]
                  for p in range(max(1, -(-n // packing.MAX_LEN))) if i is not None)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got if r.doc_id is not None) == want


def test_run_and_empty_documents(spark, tmp_path):
    assert cp.run(spark, SF_SMALL).count() > 50
    read_table(spark, SF_SMALL, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, SF_SMALL, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash_and_long_white_space(spark):
    """Every stage passes columns on that are called like its own."""
    names = ["_gone", "_doc", "_rejected", "_near", "score", "lang_pred", "rejected", "kept", "row", "llr", "n_words", "fp", "class", "first", "id", "line"]
    docs = read_table(spark, SF_SMALL, "documents")
    long = spark.createDataFrame([(900_001, " " * 1_000_000 + "x and more words", "en", "odd", 1_000_016)], docs.schema)
    docs = docs.unionByName(long).select("*", *(docs.text.substr(1, 3).alias(n) for n in names))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.where("_gone = substring(text, 1, 3)").count() > 20, name
    assert cp.packing_stage(spark, docs, SF_SMALL).where("doc_id = 900001").first()["n_tokens"] > 0


def test_language_id_reads_texts_in_small_batches_and_leaves_the_session_as_it_was(spark, monkeypatch):
    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], cp.langid.identified
    monkeypatch.setattr(cp.langid, "identified", lambda docs, model: (seen.append(spark.conf.get(key)), real(docs, model))[1])
    before = spark.conf.get(key)
    rows = [(i, "the cat sat on the mat and looked at the dog" if i % 3 else None, "en", f"s{i}", i, 0.5, True) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, lang_pred double, rejected boolean")
    got = cp.language_id(spark, docs, "")
    assert int(seen[0]) == cp.ROWS_AT_ONCE < 10000 and spark.conf.get(key) == before
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [r for r in rows if r[1]]
