"""SQL statistics: M1-M5, M10, M12, M13, M15, M17, M21.

All are aggregates or joins against small fitted tables; the one pairwise
statistic (M10) adds up distances in cogrouped pairs of blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import written
from .summary import global_rank


def safe_corr(a: str, b: str) -> F.Column:
    """Pairwise-complete Pearson correlation; a constant column gives NULL
    (``corr`` raises DIVIDE_BY_ZERO under ANSI)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    sa = F.stddev_pop(F.when(both, F.col(a)))
    sb = F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(F.col(a), F.col(b)), sa * sb)


def pairwise_moments(df: DataFrame, cols, pairs) -> DataFrame:
    """Sufficient statistics of pairwise-complete correlation for ``pairs``.

    Values are shifted by the column means (one aggregate row, broadcast) for
    numerical stability; each task then forms the partial Gram products of
    its rows with NumPy (mask^T mask, x^T mask, x^2^T mask, x^T x) and emits
    one row per pair; a ``groupBy`` on the pair adds the partials.  Work is
    O(rows * columns^2) spread over the tasks; only pairs x partitions rows
    are shuffled.
    """
    cols = list(cols)
    pos = {c: i for i, c in enumerate(cols)}
    pi = np.array([pos[a] for a, _ in pairs])
    pj = np.array([pos[b] for _, b in pairs])
    names_a = [a for a, _ in pairs]
    names_b = [b for _, b in pairs]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    shift = np.array([0.0 if means[c] is None else float(means[c]) for c in cols])
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])

    def partials(batches):
        p = len(cols)
        N = np.zeros((p, p)); SA = np.zeros((p, p)); SAA = np.zeros((p, p)); SAB = np.zeros((p, p))
        seen = False
        for pdf in batches:
            X = pdf[cols].to_numpy(dtype=float) - shift
            M = (~np.isnan(X)).astype(float)
            Z = np.where(M > 0, X, 0.0)
            N += M.T @ M
            SA += Z.T @ M
            SAA += (Z * Z).T @ M
            SAB += Z.T @ Z
            seen = True
        if seen:
            yield pd.DataFrame({"feature_a": names_a, "feature_b": names_b, "n": N[pi, pj],
                                "sa": SA[pi, pj], "sb": SA[pj, pi], "saa": SAA[pi, pj], "sbb": SAA[pj, pi],
                                "sab": SAB[pi, pj]})

    schema = "feature_a string, feature_b string, n double, sa double, sb double, saa double, sbb double, sab double"
    return (src.mapInPandas(partials, schema).groupBy("feature_a", "feature_b")
               .agg(*[F.sum(c).alias(c) for c in ["n", "sa", "sb", "saa", "sbb", "sab"]]))


def corr_from_moments(m: DataFrame) -> DataFrame:
    """Pearson r from pairwise moments; a (numerically) constant side gives NULL."""
    n = F.col("n")
    ma, mb = F.col("sa") / n, F.col("sb") / n
    cov = F.col("sab") / n - ma * mb
    va = F.col("saa") / n - ma * ma
    vb = F.col("sbb") / n - mb * mb
    tiny_a = va <= F.lit(1e-12) * (F.col("saa") / n + F.lit(1e-300))
    tiny_b = vb <= F.lit(1e-12) * (F.col("sbb") / n + F.lit(1e-300))
    r = F.when((n < 1) | tiny_a | tiny_b, F.lit(None).cast("double")).otherwise(cov / F.sqrt(va * vb))
    return m.select("feature_a", "feature_b", r.alias("corr"))


def correlation_pairs(df: DataFrame, pairs) -> DataFrame:
    cols = sorted({c for pr in pairs for c in pr})
    return corr_from_moments(pairwise_moments(df, cols, pairs))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """M1: pairwise-complete Pearson correlation of all pairs i < j (one pass)."""
    return correlation_pairs(df, list(combinations(cols, 2)))


def target_correlation(df: DataFrame, cols, target: str = "failed", k: int = 20) -> DataFrame:
    """M2 + O4: correlation of each column with the target, top-k by |r|."""
    pairs = correlation_pairs(df, [(c, target) for c in cols])
    long = pairs.select(F.col("feature_a").alias("feature"), F.col("corr").alias("corr_with_target"))
    return (long.filter(F.col("corr_with_target").isNotNull())
                .orderBy(F.abs("corr_with_target").desc(), F.col("feature")).limit(k))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """M5: least-squares line y = slope * x + intercept over complete pairs."""
    return df.agg(F.lit(x).alias("x"), F.lit(y).alias("y"),
                  F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_count(F.col(y), F.col(x)).alias("n"))


def medians(df: DataFrame, cols) -> DataFrame:
    """M3: exact medians of many columns in one aggregate row (an all-NULL column gives NULL)."""
    return df.agg(*[F.percentile(c, 0.5).alias(c) for c in cols])


def median_impute(df: DataFrame, cols, fit: DataFrame | None = None) -> DataFrame:
    """M3: fill NULLs with medians fitted on ``fit`` (default: ``df``)."""
    m = medians(fit if fit is not None else df, cols).select(F.struct(*cols)).scalar()
    return df.select(*[F.coalesce(F.col(c), m[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


def zscore(df: DataFrame, cols, fit: DataFrame | None = None) -> DataFrame:
    """M4: (x - mean) / population std; a zero-variance column becomes 0."""
    src = fit if fit is not None else df
    m = src.agg(F.struct(*[F.avg(c).alias(f"mu_{c}") for c in cols],
                         *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols])).scalar()

    def z(c):
        sd = m[f"sd_{c}"]
        return F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - m[f"mu_{c}"]) / sd)
    return df.select(*[z(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def mode_values(df: DataFrame, cols) -> DataFrame:
    """Most frequent value per column (ties -> smallest), long form."""
    out = None
    for c in cols:
        m = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.col("n").desc(), F.col(c).asc()).limit(1)
               .select(F.lit(c).alias("feature"), F.col(c).cast("string").alias("mode"), "n"))
        out = m if out is None else out.unionByName(m)
    return out


def rare_category_pool(df: DataFrame, fit: DataFrame, col: str, min_count: int = 20,
                       label: str = "__infrequent__") -> DataFrame:
    """A category seen fewer than ``min_count`` times in ``fit`` becomes one
    pooled value; values unseen in ``fit`` stay as they are (the encoder later
    maps them to all zeros)."""
    counts = fit.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    j = df.join(counts, col, "left")
    return j.withColumn(col, F.when(F.col("_cnt") < min_count, F.lit(label)).otherwise(F.col(col))).drop("_cnt")


def class_weights(train: DataFrame, label: str = "failed") -> DataFrame:
    """Balanced weights n / (2 n_c) from the training rows."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy()
    return c.withColumn("weight", F.sum("n_c").over(tot) / (F.lit(2.0) * F.col("n_c")))


def with_class_weight(train: DataFrame, label: str = "failed", out: str = "weight") -> DataFrame:
    w = class_weights(train, label).select(label, F.col("weight").alias(out))
    return train.join(F.broadcast(w), label)


def stratified_folds(df: DataFrame, keys, k: int, label: str = "failed", seed: int = S.SEED) -> DataFrame:
    """Within each class, rows in seeded hash order are dealt to folds
    0..k-1 in turn, so every fold holds n_c / k (+-1) rows of each class.

    The per-class row number comes from the bucketed global rank (no window
    partitioned only by the label, which would put a class in one task).
    """
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed))))
    t = df.withColumn("_h", h)
    r = global_rank(t, [label, "_h", *keys], "_r")
    before = t.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    off = before.select(label, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    j = r.join(F.broadcast(off), label)
    return j.withColumn("fold", ((F.col("_r") - F.col("_off") - 1) % k).cast("int")).drop("_h", "_r", "_off")


def cluster_names(profile: DataFrame) -> DataFrame:
    """Name clusters from their profile rows (one row per cluster)."""
    allw = Window.partitionBy()
    p = profile.withColumns({"_min_fail": F.min("failure_rate").over(allw),
                             "_med_prev": F.percentile("avg_prev_score", 0.5).over(allw)})
    name = (F.when(F.col("failure_rate") == F.col("_min_fail"),
                   F.when(F.col("yelp_coverage") >= 0.8, F.lit(S.CLUSTER_NAME_STABLE_RATED))
                    .otherwise(F.lit(S.CLUSTER_NAME_STABLE)))
             .when((F.col("first_inspection_rate") >= 0.9) | (F.col("history_rate") <= 0.1),
                   F.lit(S.CLUSTER_NAME_NO_HISTORY))
             .when((F.col("history_rate") >= 0.8) & (F.col("avg_prev_score") >= F.col("_med_prev")),
                   F.lit(S.CLUSTER_NAME_REPEAT))
             .otherwise(F.lit(S.CLUSTER_NAME_MIXED)))
    return p.withColumn("cluster_name", name).drop("_min_fail", "_med_prev")


def profile_zscores(profile: DataFrame, cols) -> DataFrame:
    """Standardise profile columns across the (few) cluster rows; constant -> 0."""
    allw = Window.partitionBy()
    out = profile
    for c in cols:
        sd = F.stddev_pop(c).over(allw)
        out = out.withColumn(c, F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - F.avg(c).over(allw)) / sd))
    return out


#: Points of one block of the silhouette's distance sums.
SILHOUETTE_BLOCK = 2048


def silhouette_euclidean(points: DataFrame, features, cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with Euclidean distance over all ``points`` (the published use samples 10,000).

    Points are dealt into blocks; every pair of blocks is a cogrouped task that
    adds up, per point of the first block, its distances to each cluster of the
    second.  The sums (a row per point, block and cluster) are added per point;
    neither points nor distances reach the driver.  A point alone in its
    cluster, or whose distances are all 0, counts 0; without a second cluster
    all do.  Returns one row: n, silhouette.
    """
    feats = list(features)
    rows = written(points.select(F.col(cluster).cast("long").alias("c"), F.array(*(F.col(f).cast("double") for f in feats)).alias("x"),
                                 F.monotonically_increasing_id().alias("id")), "silhouette")
    blocks = max(1, -(-rows.count() // SILHOUETTE_BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = dealt.withColumn("other", every).select(F.col("block").alias("a"), F.col("other").alias("b"), "id", "c", "x")
    right = dealt.withColumn("other", every).select(F.col("other").alias("a"), F.col("block").alias("b"), "c", "x")

    def sums(own: pa.Table, other: pa.Table) -> pa.Table:
        def matrix(t):
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return x.reshape(t.num_rows, -1), t.column("c").to_numpy()

        out = [[], [], [], [], []]
        if own.num_rows and other.num_rows:
            (x, cx), (y, cy) = matrix(own), matrix(other)
            ids, ks = own.column("id").to_numpy(), np.unique(cy)
            member = (cy[:, None] == ks[None, :]).astype(float)
            for i in range(0, len(x), 256):                          # bounded memory: 256 x block
                p = x[i:i + 256]
                scale = (p * p).sum(1)[:, None] + (y * y).sum(1)[None, :]
                d2 = scale - 2.0 * (p @ y.T)
                d2[d2 <= 1e-12 * scale] = 0.0                         # self / duplicates: exactly 0
                total = np.sqrt(d2) @ member
                for j, k in enumerate(ks):
                    for kept, v in zip(out, (ids[i:i + 256], cx[i:i + 256], np.full(len(p), k), np.full(len(p), int(member[:, j].sum())), total[:, j])):
                        kept.append(v)
        kinds = (np.int64, np.int64, np.int64, np.int64, float)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.empty(0, t), *v]).astype(t)) for v, t in zip(out, kinds)],
                                    names=["id", "own", "c", "n", "total"])

    part = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(sums, "id long, own long, c long, n long, total double")
    per = part.groupBy("id", "own", "c").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    inside = F.col("c") == F.col("own")
    s = per.groupBy("id").agg(
        F.sum(F.when(inside, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"))
    width = F.greatest("a", "b")
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (width > 0), (F.col("b") - F.col("a")) / width).otherwise(0.0)
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silhouette"))
