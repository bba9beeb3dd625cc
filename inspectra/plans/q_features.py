"""Registered queries: engineered features, SQL statistics and evaluation (stages 4-5)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import stats as ST
from . import build as B
from .oracle_base import rounded
from .q_summary import FIXED_CLUSTER_SQL, PROFILE_DOUBLES, cluster_profile_of, fixed_cluster
from .registry import finish, query

CUT = S.STANDIN_CUTOFF
KEY = "camis, inspection_date"


def _fe_cols(*cols, doc=""):
    def fn(spark, d):
        return finish(B.features(spark, d).select("camis", "inspection_date", *cols))
    fn.__doc__ = doc
    return fn


query("risk_flags", rounded(f"SELECT {KEY}, poor_history_flag FROM fe", []))(_fe_cols("poor_history_flag", doc="P15: poor-history flag."))

query("complaint_features", rounded(
    f"SELECT {KEY}, complaint_intensity, complaint_density, high_complaint_flag FROM fe",
    ["complaint_intensity", "complaint_density"]))(
    _fe_cols("complaint_intensity", "complaint_density", "high_complaint_flag",
             doc="P16 P17 P18 J8 A8: complaint intensity, density and the global-p75 flag."))

query("cyclic_features", rounded(
    f"SELECT {KEY}, month_sin, month_cos, dow_sin, dow_cos, summer_flag FROM fe",
    ["month_sin", "month_cos", "dow_sin", "dow_cos"]))(
    _fe_cols("month_sin", "month_cos", "dow_sin", "dow_cos", "summer_flag",
             doc="F5 P19: cyclic month / weekday encodings and the summer flag."))


@query("time_split", rounded(
    f"SELECT {KEY}, failed, CASE WHEN inspection_date < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split "
    "FROM fe WHERE failed IS NOT NULL AND inspection_date IS NOT NULL", []))
def time_split(spark, d):
    """P25 + P26: drop rows without target/date, label train / test by the cut-off."""
    return FE.time_split(B.features(spark, d), CUT).select("camis", "inspection_date", "failed", "split")


@query("class_balance", rounded(
    "SELECT split, failed, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share "
    f"FROM (SELECT failed, CASE WHEN inspection_date < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM fe "
    "WHERE failed IS NOT NULL AND inspection_date IS NOT NULL) t GROUP BY 1, 2", ["share"]))
def class_balance(spark, d):
    """Label counts and rates in train and test."""
    return finish(EV.class_balance(FE.time_split(B.features(spark, d), CUT)))


def _audit_sql():
    cols = [c for c, _ in S.LEAKAGE_AUDIT if c in S.CLEAN_COLUMNS + ["cluster"]]
    present = [c for c in cols if c in S.CLEAN_COLUMNS]
    counts = ", ".join(f"CAST(count({c}) AS BIGINT) AS {c}" for c in present)
    vals = ", ".join("('{}', '{}')".format(c, r.replace("'", "''")) for c, r in S.LEAKAGE_AUDIT)
    feats = set(S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES)
    used = ", ".join(f"'{c}'" for c in sorted(feats))
    return rounded(
        "SELECT a.excluded_feature, a.reason, CAST(u.n_non_null IS NOT NULL AS INTEGER) AS in_table, "
        "u.n_non_null, CAST(a.excluded_feature IN (" + used + ") AS INTEGER) AS in_features "
        f"FROM (VALUES {vals}) a(excluded_feature, reason) LEFT JOIN (UNPIVOT (SELECT {counts} FROM fe) "
        f"ON {', '.join(present)} INTO NAME excluded_feature VALUE n_non_null) u "
        "ON u.excluded_feature = a.excluded_feature", [])


@query("leakage_audit", _audit_sql())
def leakage_audit(spark, d):
    """The excluded columns with reasons, their presence and non-NULL count in
    the feature table, and a check that none is a model input (in_features = 0)."""
    fe = B.features(spark, d)
    present = [c for c, _ in S.LEAKAGE_AUDIT if c in fe.columns]
    counts = fe.agg(*[F.count(c).alias(c) for c in present])
    pairs = ", ".join(f"'{c}', `{c}`" for c in present)
    long = counts.selectExpr(f"stack({len(present)}, {pairs}) AS (excluded_feature, n_non_null)")
    feats = S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES
    audit = FE.leakage_audit(spark)
    out = audit.join(long, "excluded_feature", "left")
    return out.select("excluded_feature", "reason", F.col("n_non_null").isNotNull().cast("int").alias("in_table"),
                      "n_non_null", F.col("excluded_feature").isin(feats).cast("int").alias("in_features"))


_CORR = S.CORR_FEATURES


def _corr_sql_expr(a, b):
    return (f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END")


@query("correlation_matrix", rounded(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr_sql_expr(a, b)} AS corr FROM clean"
        for a, b in combinations(_CORR, 2)) + ")", ["corr"]))
def correlation_matrix(spark, d):
    """M1: pairwise-complete Pearson correlation of the 28 predictors (378 pairs)."""
    return finish(ST.correlation_matrix(B.clean(spark, d), _CORR))


@query("target_correlation", rounded(
    "SELECT feature, corr_with_target FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, {_corr_sql_expr(a, 'failed')} AS corr_with_target FROM clean" for a in _CORR)
    + ") t WHERE corr_with_target IS NOT NULL ORDER BY abs(corr_with_target) DESC, feature LIMIT 20",
    ["corr_with_target"]))
def target_correlation(spark, d):
    """M2 + O4: correlation with the target, top 20 by absolute value."""
    return finish(ST.target_correlation(B.clean(spark, d), _CORR))


@query("top_bottom", rounded(
    "SELECT * FROM (SELECT feature, corr_with_target, 'positive' AS side FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, {_corr_sql_expr(a, 'failed')} AS corr_with_target FROM clean" for a in _CORR)
    + ") t WHERE corr_with_target > 0 ORDER BY corr_with_target DESC, feature LIMIT 15) UNION ALL "
    "SELECT * FROM (SELECT feature, corr_with_target, 'negative' AS side FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, {_corr_sql_expr(a, 'failed')} AS corr_with_target FROM clean" for a in _CORR)
    + ") t WHERE corr_with_target < 0 ORDER BY corr_with_target ASC, feature LIMIT 15)", ["corr_with_target"]))
def top_bottom(spark, d):
    """O5 + U2: top-15 positive and top-15 negative associations, stacked."""
    long = ST.correlation_pairs(B.clean(spark, d), [(c, "failed") for c in _CORR])
    t = long.select(F.col("feature_a").alias("feature"), F.col("corr").alias("corr_with_target"))
    pos = t.filter(F.col("corr_with_target") > 0).orderBy(F.col("corr_with_target").desc(), "feature").limit(15)
    neg = t.filter(F.col("corr_with_target") < 0).orderBy(F.col("corr_with_target").asc(), "feature").limit(15)
    return finish(pos.withColumn("side", F.lit("positive")).unionByName(neg.withColumn("side", F.lit("negative"))))


@query("linear_trend", rounded(
    "SELECT 'prev_score' AS x, 'score' AS y, CASE WHEN isnan(regr_slope(score, prev_score)) THEN NULL "
    "ELSE regr_slope(score, prev_score) END AS slope, CASE WHEN isnan(regr_intercept(score, prev_score)) THEN NULL "
    "ELSE regr_intercept(score, prev_score) END AS intercept, CAST(regr_count(score, prev_score) AS BIGINT) AS n "
    "FROM clean WHERE has_history = 1 AND prev_score >= 0 AND score IS NOT NULL UNION ALL "
    "SELECT 'yelp_rating', 'score', regr_slope(score, yelp_rating), regr_intercept(score, yelp_rating), "
    "CAST(regr_count(score, yelp_rating) AS BIGINT) FROM clean WHERE has_yelp = 1", ["slope", "intercept"]))
def linear_trend(spark, d):
    """M5 + P23: least-squares lines score ~ prev_score (history rows) and score ~ rating."""
    c = B.clean(spark, d)
    hist = c.filter((F.col("has_history") == 1) & (F.col("prev_score") >= 0) & F.col("score").isNotNull())
    return finish(ST.linear_fit(hist, "prev_score", "score")
                  .unionByName(ST.linear_fit(c.filter(F.col("has_yelp") == 1), "yelp_rating", "score")))


_TRAIN = f"(SELECT * FROM fe WHERE failed IS NOT NULL AND inspection_date < DATE '{CUT}')"


@query("median_impute", rounded(
    "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in S.NUMERIC_FEATURES) + f" FROM {_TRAIN} t",
    S.NUMERIC_FEATURES))
def median_impute(spark, d):
    """M3: exact medians of the 31 numeric inputs, fitted on the training rows."""
    train, _ = FE.train_test(B.features(spark, d), CUT)
    return finish(ST.medians(train, S.NUMERIC_FEATURES).select(
        *[F.col(c).cast("double").alias(c) for c in S.NUMERIC_FEATURES]))


_Z = ["prev_score", "inspection_count", "temp_mean", "complaint_density", "median_household_income"]


@query("zscore", rounded(
    f"SELECT {KEY}, " + ", ".join(
        f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS {c}" for c in _Z)
    + " FROM fe, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _Z)
    + f" FROM {_TRAIN} t) st", _Z))
def zscore(spark, d):
    """M4: z-scores with population std fitted on train (constant -> 0)."""
    fe = B.features(spark, d)
    train, _ = FE.train_test(fe, CUT)
    z = ST.zscore(fe.select("camis", "inspection_date", *_Z), _Z, fit=train)
    return finish(z.select("camis", "inspection_date", *[F.col(c).cast("double").alias(c) for c in _Z]))


@query("mode_impute", rounded(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS mode, CAST(count(*) AS BIGINT) AS n "
    f"FROM {_TRAIN} t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} ASC LIMIT 1)"
    for c in S.CATEGORICAL_FEATURES), []))
def mode_impute(spark, d):
    """Most frequent value of each categorical input on train (ties -> smallest)."""
    train, _ = FE.train_test(B.features(spark, d), CUT)
    return ST.mode_values(train, S.CATEGORICAL_FEATURES)


@query("rare_category_pool", rounded(
    "SELECT yelp_category_primary, CAST(count(*) AS BIGINT) AS n FROM ("
    "SELECT CASE WHEN c.cnt < 20 THEN '__infrequent__' ELSE f.yelp_category_primary END AS yelp_category_primary "
    "FROM fe f LEFT JOIN (SELECT yelp_category_primary, count(*) AS cnt FROM " + _TRAIN
    + " t GROUP BY 1) c ON c.yelp_category_primary = f.yelp_category_primary) x GROUP BY 1", []))
def rare_category_pool(spark, d):
    """Categories seen < 20 times in train pooled into one slot; unseen kept."""
    fe = B.features(spark, d)
    train, _ = FE.train_test(fe, CUT)
    pooled = ST.rare_category_pool(fe, train, "yelp_category_primary")
    return pooled.groupBy("yelp_category_primary").agg(F.count(F.lit(1)).alias("n"))


@query("class_weights", rounded(
    "SELECT failed, CAST(count(*) AS BIGINT) AS n_c, sum(count(*)) OVER () / (2.0 * count(*)) AS weight "
    f"FROM {_TRAIN} t GROUP BY failed", ["weight"]))
def class_weights(spark, d):
    """Balanced class weights n / (2 n_c) from the training rows."""
    train, _ = FE.train_test(B.features(spark, d), CUT)
    return finish(ST.class_weights(train))


@query("stratified_folds", rounded(
    "SELECT camis, inspection_date, failed, CAST((row_number() OVER (PARTITION BY failed ORDER BY md5(camis || '|' || "
    "CAST(inspection_date AS VARCHAR) || '|42'), camis, inspection_date) - 1) % 5 AS INTEGER) AS fold "
    f"FROM {_TRAIN} t", []))
def stratified_folds(spark, d):
    """Seeded stratified 5-fold assignment of every training row."""
    train, _ = FE.train_test(B.features(spark, d), CUT)
    return ST.stratified_folds(train.select("camis", "inspection_date", "failed"), ["camis", "inspection_date"], 5)


@query("cluster_names", rounded(
    "SELECT *, CASE WHEN failure_rate = min(failure_rate) OVER () THEN "
    f"CASE WHEN yelp_coverage >= 0.8 THEN '{S.CLUSTER_NAME_STABLE_RATED}' ELSE '{S.CLUSTER_NAME_STABLE}' END "
    f"WHEN first_inspection_rate >= 0.9 OR history_rate <= 0.1 THEN '{S.CLUSTER_NAME_NO_HISTORY}' "
    "WHEN history_rate >= 0.8 AND avg_prev_score >= quantile_cont(avg_prev_score, 0.5) OVER () THEN "
    f"'{S.CLUSTER_NAME_REPEAT}' ELSE '{S.CLUSTER_NAME_MIXED}' END AS cluster_name FROM ("
    + f"SELECT {FIXED_CLUSTER_SQL} AS cluster, CAST(count(*) AS BIGINT) AS inspections, "
    "avg(failed) AS failure_rate, avg(prev_score) AS avg_prev_score, avg(has_history) AS history_rate, "
    "avg(is_first_inspection) AS first_inspection_rate, avg(food_complaints_total) AS avg_food_complaints, "
    "quantile_cont(median_household_income, 0.5) AS median_income, avg(has_yelp) AS yelp_coverage "
    "FROM clean GROUP BY 1) p", PROFILE_DOUBLES))
def cluster_names(spark, d):
    """Rule-based cluster names over the (fixed-assignment) profile rows."""
    prof = cluster_profile_of(B.clean(spark, d).withColumn("cluster", fixed_cluster()))
    return finish(ST.cluster_names(prof))


_PROFILE_Z = ["failure_rate", "history_rate", "first_inspection_rate", "avg_food_complaints", "median_income",
              "yelp_coverage"]


@query("profile_zscores", rounded(
    "SELECT cluster, " + ", ".join(
        f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
        f"END AS {c}" for c in _PROFILE_Z)
    + f" FROM (SELECT {FIXED_CLUSTER_SQL} AS cluster, avg(failed) AS failure_rate, avg(has_history) AS history_rate, "
    "avg(is_first_inspection) AS first_inspection_rate, avg(food_complaints_total) AS avg_food_complaints, "
    "quantile_cont(median_household_income, 0.5) AS median_income, avg(has_yelp) AS yelp_coverage "
    "FROM clean GROUP BY 1) p", _PROFILE_Z))
def profile_zscores(spark, d):
    """The six published cluster profile columns, standardised over the clusters."""
    prof = cluster_profile_of(B.clean(spark, d).withColumn("cluster", fixed_cluster()))
    return finish(ST.profile_zscores(prof.select("cluster", *_PROFILE_Z), _PROFILE_Z))


# -- evaluation on a SQL-made score (the oracle applies; MLlib scores are rows-only) --

SCORED_CTE = (f"scored AS (SELECT camis, inspection_date, failed AS label, round((prev_score + 1) / 41.0, 3) AS prob "
              f"FROM fe WHERE failed IS NOT NULL AND inspection_date >= DATE '{CUT}')")


def scored(spark, d):
    """Test rows with a score made from the previous visit (many ties)."""
    _, test = FE.train_test(B.features(spark, d), CUT)
    return test.select("camis", "inspection_date", F.col("failed").alias("label"),
                       F.round((F.col("prev_score") + 1) / 41.0, 3).alias("prob"))


_CM = ("CAST(count(*) FILTER (WHERE prob >= {t} AND label = 1) AS DOUBLE) AS tp, "
       "CAST(count(*) FILTER (WHERE prob >= {t} AND label <> 1) AS DOUBLE) AS fp, "
       "CAST(count(*) FILTER (WHERE prob < {t} AND label <> 1) AS DOUBLE) AS tn, "
       "CAST(count(*) FILTER (WHERE prob < {t} AND label = 1) AS DOUBLE) AS fn")
_MET = ("coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, "
        "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, "
        "coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / "
        "nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0) AS f1")
_AUC_CTES = (SCORED_CTE + ", h AS (SELECT prob AS s, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, "
             "CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS neg FROM scored GROUP BY 1), "
             "h2 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
             "AS below FROM h), auc AS (SELECT coalesce(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 0) "
             "AS auc FROM h2)")
METRICS = ["accuracy", "precision", "recall", "f1"]


@query("classification_metrics", rounded(
    f"SELECT {_MET} FROM (SELECT {_CM.format(t=0.5)} FROM scored) c", METRICS, SCORED_CTE))
def classification_metrics(spark, d):
    """V1: accuracy, precision, recall, F1 at 0.5 (0 when undefined)."""
    return finish(EV.classification_metrics(scored(spark, d), 0.5))


@query("roc_auc", rounded("SELECT auc FROM auc", ["auc"], _AUC_CTES))
def roc_auc(spark, d):
    """V2: exact ROC-AUC with tied scores counted half."""
    return finish(EV.roc_auc(scored(spark, d)))


@query("roc_points", rounded(
    "SELECT s AS threshold, coalesce(sum(neg) OVER w / nullif(sum(neg) OVER (), 0), 0) AS fpr, "
    "coalesce(sum(pos) OVER w / nullif(sum(pos) OVER (), 0), 0) AS tpr FROM h "
    "WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", ["threshold", "fpr", "tpr"],
    _AUC_CTES))
def roc_points(spark, d):
    """ROC curve points from cumulative counts per distinct score."""
    return finish(EV.roc_points(scored(spark, d)))


_SWEEP_CTES = (SCORED_CTE + ", b AS (SELECT CAST(least(90, floor(prob * 100 + 1e-9)) AS INTEGER) AS k, "
               "CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS cnt "
               "FROM scored GROUP BY 1), tot AS (SELECT sum(pos) AS P, sum(cnt) AS N FROM b), "
               "g AS (SELECT r.k, coalesce(b.pos, 0) AS pos, coalesce(b.cnt, 0) AS cnt FROM "
               "(SELECT CAST(range AS INTEGER) AS k FROM range(10, 91)) r LEFT JOIN b ON b.k = r.k), "
               "g2 AS (SELECT k, sum(pos) OVER w AS tp, sum(cnt) OVER w AS pp FROM g "
               "WINDOW w AS (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
               "sweep AS (SELECT CAST(k AS DOUBLE) / 100.0 AS threshold, coalesce(tp / nullif(pp, 0), 0) AS precision, "
               "coalesce(tp / nullif(P, 0), 0) AS recall, "
               "coalesce(2 * coalesce(tp / nullif(pp, 0), 0) * coalesce(tp / nullif(P, 0), 0) / "
               "nullif(coalesce(tp / nullif(pp, 0), 0) + coalesce(tp / nullif(P, 0), 0), 0), 0) AS f1, "
               "coalesce((tp + (N - pp) - (P - tp)) / nullif(N, 0), 0) AS accuracy FROM g2, tot)")
SWEEP = ["threshold", "precision", "recall", "f1", "accuracy"]


@query("threshold_sweep", rounded("SELECT * FROM sweep", SWEEP, _SWEEP_CTES))
def threshold_sweep(spark, d):
    """V3: 81 thresholds .10-.90 in one pass (bucket, count, reverse running sum)."""
    return finish(EV.threshold_sweep(scored(spark, d)))


@query("best_threshold", rounded(
    "SELECT * FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1", SWEEP, _SWEEP_CTES))
def best_threshold(spark, d):
    """Best-F1 threshold, lowest on ties."""
    return finish(EV.best_threshold(EV.threshold_sweep(scored(spark, d))))


@query("confusion_matrix", rounded(
    "SELECT a.actual, a.predicted, coalesce(c.n, 0) AS n, coalesce(coalesce(c.n, 0) / "
    "nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY a.actual), 0), 0) AS row_share FROM "
    "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) a(actual, predicted) LEFT JOIN "
    "(SELECT CAST(label AS INTEGER) AS actual, CAST(prob >= 0.47 AS INTEGER) AS predicted, CAST(count(*) AS BIGINT) AS n "
    "FROM scored GROUP BY 1, 2) c ON a.actual = c.actual AND a.predicted = c.predicted", ["row_share"],
    SCORED_CTE).replace("SELECT a.actual, a.predicted", "SELECT CAST(a.actual AS INTEGER) AS actual, "
                        "CAST(a.predicted AS INTEGER) AS predicted"))
def confusion_matrix(spark, d):
    """V5: 2x2 confusion counts at the tuned threshold, with row shares."""
    return finish(EV.confusion_matrix(scored(spark, d), S.FINAL_THRESHOLD))


@query("majority_baseline", rounded(
    f"SELECT {_MET}, 0.5::DOUBLE AS roc_auc FROM (SELECT {_CM.format(t=2.0)} FROM scored) c", METRICS + ["roc_auc"],
    SCORED_CTE))
def majority_baseline(spark, d):
    """V6: always predict the majority class 0; AUC 0.5."""
    base = scored(spark, d).withColumn("prob", F.lit(0.0))
    return finish(EV.classification_metrics(base, 2.0).withColumn("roc_auc", F.lit(0.5)))


@query("metric_table", rounded(
    f"SELECT 'Majority-Class Baseline' AS model, 0.5::DOUBLE AS threshold, {_MET}, 0.5::DOUBLE AS roc_auc "
    f"FROM (SELECT {_CM.format(t=2.0)} FROM scored) c UNION ALL "
    f"SELECT 'History score', 0.5::DOUBLE, {_MET}, (SELECT auc FROM auc) FROM (SELECT {_CM.format(t=0.5)} FROM scored) c "
    f"UNION ALL SELECT 'History score', 0.47::DOUBLE, {_MET}, (SELECT auc FROM auc) FROM "
    f"(SELECT {_CM.format(t=0.47)} FROM scored) c", ["threshold"] + METRICS + ["roc_auc"], _AUC_CTES))
def metric_table(spark, d):
    """V7 + U3: baseline and model rows stacked, one row per (model, threshold)."""
    sc = scored(spark, d)
    auc = EV.roc_auc(sc)
    # one pass for every threshold; the majority baseline predicts no positive
    # at all, which is the count at a threshold above every score (2.0)
    m = EV.metrics_from_counts(EV.confusion_counts_at(sc, [2.0, 0.5, S.FINAL_THRESHOLD]))
    m = m.withColumn("auc", auc.select("auc").scalar())
    is_base = F.col("threshold") == 2.0
    out = m.select(F.when(is_base, F.lit("Majority-Class Baseline")).otherwise(F.lit("History score")).alias("model"),
                   F.when(is_base, F.lit(0.5)).otherwise(F.col("threshold")).alias("threshold"), *METRICS,
                   F.when(is_base, F.lit(0.5)).otherwise(F.col("auc")).alias("roc_auc"))
    return finish(out)


@query("class_report", rounded(
    "SELECT * FROM per UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), sum(support) FROM per", ["precision", "recall", "f1", "support"],
    SCORED_CTE + f", c AS (SELECT {_CM.format(t=0.5)} FROM scored), per AS ("
    "SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall, "
    "coalesce(2 * coalesce(tn / nullif(tn + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0) / nullif("
    "coalesce(tn / nullif(tn + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0), 0), 0) AS f1, tn + fp AS support FROM c "
    "UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), "
    "coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif("
    "coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), tp + fn FROM c)"))
def class_report(spark, d):
    """V9: per-class precision / recall / F1 / support with macro and weighted averages."""
    return finish(EV.class_report(scored(spark, d), 0.5))
