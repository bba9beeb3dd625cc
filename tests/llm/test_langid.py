"""Language ID: kernels against plain Python, held-out accuracy, odd inputs."""

import zlib

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from inspectra.llm import langid, queries


def test_counts_are_those_of_each_text_alone():
    texts = ["Ab c", "", "É 1x", "İstanbul", "a" * 5000, "...", "日本語 text"]
    counts, letters = langid.ngram_counts(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]
    assert counts.sum(axis=1).tolist() == [3 * n for n in letters]
    for i, t in enumerate(texts):
        assert (langid.ngram_counts([t])[0][0] == counts[i]).all()
    assert (langid.ngram_counts(["AB-C"])[0] == langid.ngram_counts(["ab1c"])[0]).all()


def test_held_out_rows_and_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op5_language_id"](spark, SF_SMALL).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_is_learnt_from_held_out_documents(spark):
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([("alpha beta", "xx"), ("gamma delta", None)] * 20)],
                                 "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.learnable(docs).collect()}
    assert kept == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2 and i % 2 == 0}


def test_odd_inputs(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the of and with this", "en"), (2, "the of and with this", "en"),
            (3, None, "en"), (4, "", "de"), (5, "123 ... !!", None), (None, "the this", "en"), (7, "und die " * 50_000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs)
    assert sorted(set(model.langs)) == ["de", "en"]
    out = langid.predict(docs.select("doc_id", "text"), model).collect()
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in out}
    assert len(out) == len(rows)
    assert got[3] == got[4] == got[5] == ("und", True)
    assert got[1][0] == got[7][0] == "de" and got[2][0] == got[None][0] == "en"
    empty = langid.fit(docs.limit(0))
    assert {(r.lang_pred, r.rejected) for r in langid.predict(docs.select("doc_id", "text"), empty).collect()} == {("und", True)}
    assert langid.predict(docs.limit(0).select("text"), model).count() == 0


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    strange = spark.createDataFrame([("ыъ щжц фхэ юя " * 40,), ("zqxj kvwq " * 40,)], "text string")
    assert [r.rejected for r in langid.predict(strange, model).collect()] == [True, True]
    assert langid.predict(docs.select("text"), model).where(F.col("rejected")).count() <= 1


def test_clusters_are_unit_and_deterministic():
    x = np.random.default_rng(1).random((50, langid.DIMS)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = langid.cluster(x, 4), langid.cluster(x, 4)
    assert (a == b).all() and np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-5) and len(langid.cluster(x[:2], 4)) == 2


def test_the_fit_equals_a_plain_version(spark, monkeypatch):
    """Document frequencies over all texts, the smallest hashes of each language as its sample, then the same clustering."""
    monkeypatch.setattr(langid, "_HASH_BITS", 4)  # several ids a bin: the ranking inside the last one matters
    words = {"xx": "alpha beta gamma delta", "yy": "eins zwei drei vier", "zz": "un deux trois quatre"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 8)) if i % 11 else "12 3", lang) for i in range(150) for lang in [sorted(words)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, n_centroids=2, sample_docs=20)
    counts = np.concatenate([langid.ngram_counts([t])[0] for _, t, _ in rows])
    letters = [any(c.isalpha() for c in t) for _, t, _ in rows]
    idf = np.log((1 + sum(letters)) / (1 + (counts > 0).sum(axis=0))) + 1
    assert np.allclose(model.idf, idf, atol=1e-6)
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = []
    for lang in sorted(words):
        own = sorted((h[i], i) for i, _, x in rows if x == lang and letters[i])[:20]
        x = np.log1p(counts[[i for _, i in own]]) * idf
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        c = langid.cluster(x, 2)
        want += [(lang, v, (x @ c.T).max(axis=1).min() * langid.REJECT_SHARE) for v in c]
    assert model.langs == [w[0] for w in want]
    assert np.allclose(model.centroids, [w[1] for w in want], atol=1e-5) and np.allclose(model.floor, [w[2] for w in want], atol=1e-5)


def test_result_columns_replace_those_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "der die das", "a", 2.0, "b", True)], "_near long, text string, lang_pred string, score double, lang string, rejected boolean")
    out = langid.predict(docs, langid.fit(docs.select(F.col("_near").alias("doc_id"), "text", "lang")))
    assert out.columns == ["_near", "text", "lang", "lang_pred", "score", "rejected"] and out.first()["_near"] == 1 and out.first()["lang_pred"] == "b"
