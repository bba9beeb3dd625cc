"""Correlation, impute, folds, weights, rare pooling, cluster naming, silhouette."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inspectra.operators import stats as ST


def test_correlation_pairwise_complete_matches_pandas(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(100, 5, 400)
    b = a * 0.3 + rng.normal(0, 1, 400)
    c = np.full(400, 7.0)
    a[::13] = np.nan
    b[::17] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(x), F.col(x)).alias(x) for x in "abc"])
    got = {(r.feature_a, r.feature_b): r.corr for r in ST.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(got[("a", "b")] - pdf["a"].corr(pdf["b"])) < 1e-9
    assert got[("a", "c")] is None and got[("b", "c")] is None       # MF11: constant column -> NULL


def test_safe_corr_constant_no_error(spark):  # MF11 under ANSI
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert df.select(ST.safe_corr("a", "b")).first()[0] is None


def test_rare_category_pool(spark):  # MF13
    train = spark.createDataFrame([("r",)] * 19 + [("k",)] * 20, "c string")
    test = spark.createDataFrame([("r",), ("k",), ("new",)], "c string")
    got = [r.c for r in ST.rare_category_pool(test, train, "c", 20).orderBy("c").collect()]
    assert sorted(got) == ["__infrequent__", "k", "new"]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(1,)] * 25 + [(0,)] * 75, "failed int")
    w = {r.failed: r.weight for r in ST.class_weights(df).collect()}
    assert abs(w[1] - 2.0) < 1e-12 and abs(w[0] - 100 / 150) < 1e-12


def test_stratified_folds_balanced(spark):
    rows = [(f"k{i}", i % 10 < 3) for i in range(500)]
    df = spark.createDataFrame([(k, "2020-01-01", int(y)) for k, y in rows], "camis string, d string, failed int")
    f = ST.stratified_folds(df, ["camis", "d"], 5)
    counts = f.groupBy("failed", "fold").count().toPandas()
    for _, g in counts.groupby("failed"):
        assert g["count"].max() - g["count"].min() <= 1 and len(g) == 5


def test_cluster_names_rules(spark):  # MF18
    prof = spark.createDataFrame(
        [(0, 0.10, 5.0, 0.9, 0.05, 0.9), (1, 0.30, 1.0, 0.05, 0.95, 0.1), (2, 0.25, 9.0, 0.85, 0.1, 0.2)],
        "cluster int, failure_rate double, avg_prev_score double, history_rate double, "
        "first_inspection_rate double, yelp_coverage double")
    names = {r.cluster: r.cluster_name for r in ST.cluster_names(prof).collect()}
    assert names == {0: "Yelp-Matched Stable Compliant", 1: "No-History Higher Risk",
                     2: "Repeat Operators With Prior Risk"}


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(5, 1, (30, 2))])
    lab = np.array([0] * 30 + [1] * 30)
    df = spark.createDataFrame(pd.DataFrame({"cluster": lab, "x0": X[:, 0], "x1": X[:, 1]}))
    got = ST.silhouette_euclidean(df, ["x0", "x1"]).first()["silhouette"]
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(60):
        same = lab == lab[i]
        a = D[i, same].sum() / (same.sum() - 1)
        b = D[i, ~same].mean()
        s.append((b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-9


def test_median_impute_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    got = sorted(r.x for r in ST.median_impute(df, ["x"]).collect())
    assert got == [1.0, 2.0, 2.5, 3.0, 4.0]
