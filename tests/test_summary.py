"""Global rank, quartiles, top-k, histograms and box statistics."""

import random

import pandas as pd
from pyspark.sql import functions as F

from inspectra.operators import cleaning as C
from inspectra.operators import summary as SM


def test_rank_quartiles_not_ntile(spark):  # MF8
    df = spark.createDataFrame([(float(i), str(i)) for i in range(6)], "v double, k string")
    q = SM.rank_quartiles(df, "v", ["k"], "q", ["1", "2", "3", "4"]).orderBy("v")
    assert [r.q for r in q.collect()] == ["1", "1", "2", "3", "4", "4"]


def test_global_rank_matches_sort_with_hot_value(spark):
    random.seed(3)
    rows = [(0.0 if random.random() < 0.4 else float(random.randint(0, 50)), f"k{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, k string")
    got = SM.global_rank(df, ["v", "k"], "r").toPandas().sort_values("r")
    exp = pd.DataFrame(rows, columns=["v", "k"]).sort_values(["v", "k"]).reset_index(drop=True)
    assert list(got["r"]) == list(range(1, 3001))
    assert list(got["k"]) == list(exp["k"])


def test_running_totals(spark):
    df = spark.createDataFrame([(i % 7, i, float(i)) for i in range(200)], "g int, i int, x double")
    got = SM.running_totals(df, ["g", "i"], {"cum": F.col("x")}).toPandas().sort_values(["g", "i"])
    exp = pd.DataFrame([(i % 7, i, float(i)) for i in range(200)], columns=["g", "i", "x"]).sort_values(["g", "i"])
    assert list(got["cum"].round(9)) == list(exp["x"].cumsum().round(9))


def test_topk_ties_by_name(spark):  # MF14
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert [r.x for r in C.top_k_values(df, "x", 2).collect()] == ["c", "a"]


def test_group_top_k_other(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    got = sorted((r.x or "", r.g) for r in C.group_top_k_other(df, "x", "g", 1).collect())
    assert got == [("", "Other"), ("a", "a"), ("a", "a"), ("b", "Other")]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "s double")
    h = {r.bin: r.n for r in SM.histogram_equal_width(df, "s", 5).collect()}
    assert h[4] == 1 and sum(h.values()) == 6


def test_box_stats(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 100]], "k string, v double")
    r = SM.box_stats(df, "v", "k").first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_crosstab_rows_sum_to_one(spark):
    df = spark.createDataFrame([(0, "A"), (0, "B"), (1, "A")], "c int, b string")
    rows = SM.crosstab_share(df, "c", "b", ["A", "B"]).collect()
    for r in rows:
        assert abs(r["A"] + r["B"] - 1.0) < 1e-12


def test_box_stats_many_equals_single(spark):
    df = spark.createDataFrame([("g", float(x), float(x) * 2 if x != 3 else None) for x in [1, 2, 3, 4, 100]],
                               "k string, v double, w double")
    many = {(r.variable, r.k): tuple(r)[2:] for r in SM.box_stats_many(df, ["v", "w"], "k").collect()}
    for col in ["v", "w"]:
        one = SM.box_stats(df, col, "k").first()
        assert many[(col, "g")] == (one.q1, one.median, one.q3, one.n, one.whisker_lo, one.whisker_hi, one.n_outliers)


def test_seeded_sample_equals_full_order(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(2000)], "camis string, v int")
    got = [r.camis for r in SM.seeded_sample(df, ["camis"], 50).collect()]
    full = (df.withColumn("_h", F.md5(F.concat_ws("|", "camis", F.lit("42"))))
              .orderBy("_h", "camis").limit(50))
    assert got == [r.camis for r in full.collect()]
    assert SM.seeded_sample(df, ["camis"], 5000).count() == 2000


def test_box_stats_ranked_equals_box_stats(spark):
    import random
    rng = random.Random(4)
    rows = [(i, "ab"[i % 3 == 0], None if i % 17 == 0 else round(rng.gauss(0, 3), 2)) for i in range(200)] + [(999, "c", 1.5)]
    df = spark.createDataFrame(rows, "k int, g string, v double")
    want = {r.g: r for r in SM.box_stats(df, "v", "g").collect()}
    for r in SM.box_stats_ranked(df, "v", "g", ["k"]).collect():
        w = want[r.g]
        assert all(abs(r[c] - w[c]) < 1e-9 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")) and (r.n, r.n_outliers) == (w.n, w.n_outliers)
