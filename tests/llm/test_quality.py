"""Quality rules against a plain Python version."""

import math
import random
import re

import pytest

from inspectra.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def corpus():
    rng = random.Random(5)
    good = [f"word{i}" for i in range(60)]
    texts = [None, "", " \t\n ", "one", "a a a a a a", "x y z x y z", "É日本     w\x0bv", "\n\nA\n A\nA\n", "a\r\nb\r\na\r\n", "a b " * 30]
    texts += [" ".join(rng.choice(good) for _ in range(rng.randrange(40, 200))) for _ in range(40)]
    texts += [" ".join(rng.choice(good) + rng.choice(["###", "%%%"]) for _ in range(120)) for _ in range(12)]
    texts += ["\n".join([texts[12]] * 3), " ".join(good * 2) + " " + " ".join(good[:40])]
    return texts


def test_base_statistics(spark):
    rows = list(enumerate(corpus()))
    out = quality.base_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out}
    assert got == {i: base(t) for i, t in rows}


def brute(spark, rows, labels):
    """LLR by dictionaries; hashes come from Spark on single values."""
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
            .selectExpr("doc_id", f"{quality._FOLD} f").collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    pairs = sorted({(a, None) for w in words.values() for a in w} | {p for w in words.values() for p in zip(w, w[1:])}, key=str)
    hashed = spark.createDataFrame(pairs, "a string, b string").selectExpr(
        "a", "b", f"{quality._UNIGRAM.format('a')} u", f"{quality._BIGRAM.format('a', 'b')} v").collect()
    h = {(r.a, r.b): r.u if r.b is None else r.v for r in hashed}
    grams = {i: [h[a, None] for a in w] + [h[p] for p in zip(w, w[1:])] for i, w in words.items()}
    trusted = {i for i, q, t in labels if q == 1 and not t}
    raw, by = {}, [{} for _ in range(quality.FOLDS)]
    for i, gs in grams.items():
        for g in gs:
            raw[g] = raw.get(g, 0) + 1
            if i in trusted:
                by[fold[i]][g] = by[fold[i]].get(g, 0) + 1
    n_raw = sum(raw.values())
    out = {}
    for i, gs in grams.items():
        rest = [b for f, b in enumerate(by) if f != fold[i]]
        n_t = sum(sum(b.values()) for b in rest)
        out[i] = sum(math.log((sum(b.get(g, 0) for b in rest) + 1) / (n_t + quality.BINS))
                     - math.log((raw[g] + 1) / (n_raw + quality.BINS)) for g in gs) / max(1, len(gs))
    return out


def test_scores_and_cut_match_brute_force(spark, scratch):
    rows = list(enumerate(corpus()))
    labels = [(i, 1, 0) for i in range(10, 40, 2)] + [(i, 0, 0) for i in range(50, 60, 2)] + [(11, 1, 1), (99, 1, 0)]
    out = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string"),
                                   spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch).collect()
    want = brute(spark, rows, labels)
    for r in out:
        assert r.llr == pytest.approx(want[r.doc_id], abs=1e-9)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] != r for i, r in ((r.doc_id, r.base_failed) for r in out) if 10 <= i < 50 and i != 12)  # clean ones stay
    assert not any(kept[i] for i in range(50, 62))  # labelled or not, the symbol texts go


def test_no_labels_empty_tables_nulls_and_clashing_columns(spark, scratch):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(None, "a b", 1), (7, " ".join(map(str, range(60))), 2), (7, " ".join(map(str, range(60))), 2)],
                                 "doc_id long, text string, quality int")
    out = quality.quality_verdicts(docs, none, scratch).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in out) == [(0, False), (7, True), (7, True)]
    assert quality.quality_verdicts(docs.limit(0), none, scratch).count() == 0
    labels = spark.createDataFrame([(None, 1, 0), (7, None, None), (7, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_verdicts(docs, labels, scratch).count() == 3


def test_native(spark, scratch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality.base_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_meet_the_labels_by_key_at_every_size(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    verdicts = quality.verdicts_of(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    weights = quality.ngram_weights(docs, verdicts)
    assert "strategy=merge" in weights._jdf.queryExecution().optimizedPlan().toString()
    assert len(weights.first()["weights"]) == quality.FOLDS * quality.BINS
