"""Registered queries: models, PCA and clustering (rows-only checks where no SQL twin is given)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import evaluation as EV
from ..operators import modeling as MD
from ..operators import stats as ST
from ..operators import summary as SM
from ..session import fingerprint, fresh_path, stored, written
from ..sources import sinks
from . import build as B
from .oracle_base import rounded
from .q_summary import cluster_profile_of
from .registry import finish, query

CUT = S.STANDIN_CUTOFF
_fits: dict = {}


def _frame(spark, d):
    key = (spark.sparkContext.applicationId, fingerprint(spark, d), "frame")
    if key not in _fits:
        train, test, nums, cats = MD.model_frame(B.features(spark, d), CUT)
        _fits[key] = (train.cache(), test.cache(), nums, cats)
    return _fits[key]


def _prepared(spark, d, folds, rare_min):
    """The coded training rows and their views, made once for the searches that share folds and pooling."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, d), "rows", folds, rare_min)
    if key not in _fits:
        train, _, nums, cats = _frame(spark, d)
        _fits[key] = MD.training_rows(train, ["camis", "inspection_date"], nums, cats, folds, rare_min)
    return _fits[key]


def _fit(spark, d, family):
    """A family's published search, done once per input: (model, table of the grid, best parameters)."""
    def make(path):
        train, _, nums, cats = _frame(spark, d)
        rare_min = MD.COMPARED.get(family)
        model, table, _ = MD.fit_family(train, nums, cats, family, rare_min=rare_min, prepared=_prepared(spark, d, MD.GRIDS[family]["folds"], rare_min))
        sinks.save_model(model, path)
        table.coalesce(1).write.parquet(f"{path}/grid")

    def load(path):
        model = sinks.load_model(path)
        return model, spark.read.parquet(f"{path}/grid"), model.params

    return stored(spark, f"model-{family}", d, make, load)


def _scored(spark, d, family):
    return MD.score(_fit(spark, d, family)[0], _frame(spark, d)[1]).select("label", "prob")


def _best(spark, d):
    """(family, test AUC) of the best compared model."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, d), "best")
    if key not in _fits:
        _fits[key] = MD.best_family(model_comparison(spark, d))
    return _fits[key]


@query("fit_logistic")
def fit_logistic(spark, d):
    """M18 + M21: the stage-4 logistic search (4 C x L1/L2) by 5-fold AUC."""
    return _fit(spark, d, "logistic")[1]


@query("fit_logistic_pooled")
def fit_logistic_pooled(spark, d):
    """M18 + M15: the stage-5 logistic search with rare categories pooled, 3 folds."""
    return _fit(spark, d, "logistic_pooled")[1]


@query("fit_forest")
def fit_forest(spark, d):
    """Random-forest search (8 points, sqrt features, balanced weights, 3 folds)."""
    return _fit(spark, d, "forest")[1]


@query("fit_boosted")
def fit_boosted(spark, d):
    """Gradient-boosted trees search (8 points, unweighted, 3 folds)."""
    return _fit(spark, d, "boosted")[1]


@query("pipeline_fit")
def pipeline_fit(spark, d):
    """M16 + M22: fit-on-train pipeline, class-1 probability on the test rows."""
    model = _fit(spark, d, "logistic")[0]
    return MD.score(model, _frame(spark, d)[1]).select("camis", "inspection_date", "label", "prob")


@query("one_hot")
def one_hot(spark, d):
    """Feature-vector slots (numbers, then one slot per seen category; unseen -> zeros)."""
    names = MD.slot_names(_fit(spark, d, "logistic")[0])
    return spark.createDataFrame(list(enumerate(names)), "slot int, feature string")


_CATS_SQL = " UNION ALL ".join(
    f"SELECT camis, inspection_date, '{c}' AS feature, CASE WHEN {c} IN (SELECT {c} FROM fe WHERE failed IS NOT NULL AND "
    f"inspection_date < DATE '{CUT}') THEN {c} END AS slot FROM test" for c in S.CATEGORICAL_FEATURES)


@query("one_hot_rows", rounded(
    f"SELECT * FROM ({_CATS_SQL}) r WHERE slot IS NOT NULL", [],
    f"test AS (SELECT * FROM fe WHERE failed IS NOT NULL AND inspection_date >= DATE '{CUT}')"))
def one_hot_rows(spark, d):
    """The slot that each test row sets per category; a value unseen in training sets none
    (a missing value would take the training mode; the inputs have none)."""
    train, test, nums, cats = _frame(spark, d)
    key = (spark.sparkContext.applicationId, fingerprint(spark, d), "encoder")
    if key not in _fits:
        _fits[key] = MD.preprocessor(nums, cats, train)
    prep = _fits[key]
    labels = [st for st in prep.stages if st.__class__.__name__ == "StringIndexerModel"][0].labelsArray
    rows = prep.transform(test)
    from pyspark.ml.functions import vector_to_array
    parts = [rows.select("camis", "inspection_date", F.lit(c).alias("feature"), F.get(
        F.array(*[F.lit(x) for x in names]), (F.array_position(vector_to_array(f"_ohe_{c}"), F.lit(1.0)) - 1).cast("int")).alias("slot"))
        for c, names in zip(cats, labels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("slot").isNotNull())


@query("coefficients")
def coefficients(spark, d):
    """M23 + F7 + F8: logistic coefficients with readable names, |coef| (rounded) and odds ratios."""
    return MD.coefficients(spark, _fit(spark, d, "logistic")[0])


@query("model_round_trip")
def model_round_trip(spark, d):
    """Every compared model saved and loaded; test rows whose probability changed (none) and rows scored."""
    test, out = _frame(spark, d)[1], None
    for family in MD.COMPARED:
        model, path = _fit(spark, d, family)[0], fresh_path(spark, f"model-{family}")
        sinks.save_model(model, path)
        keys = ["camis", "inspection_date"]
        a, b = (MD.score(m, test).select(*keys, F.col("prob").alias(p)) for m, p in ((model, "p"), (sinks.load_model(path), "q")))
        row = a.join(b, keys).agg(F.lit(family).alias("model"), F.count(F.lit(1)).alias("n_rows"),
                                  F.count_if(F.abs(F.col("p") - F.col("q")) > 1e-12).alias("n_changed"))
        out = row if out is None else out.unionByName(row)
    return out


@query("odds_ratios")
def odds_ratios(spark, d):
    """F7 + O5 + U2: top-15 positive and top-15 negative coefficients with odds ratios (ties by name)."""
    c = coefficients(spark, d)
    pos = c.filter(F.col("coefficient") > 0).orderBy(F.col("coefficient").desc(), "feature").limit(15)
    neg = c.filter(F.col("coefficient") < 0).orderBy(F.col("coefficient").asc(), "feature").limit(15)
    return pos.unionByName(neg)


@query("feature_importance")
def feature_importance(spark, d):
    """Top-15 importances of the best model (|value| order, then ascending)."""
    model = _fit(spark, d, _best(spark, d)[0])[0]
    return MD.feature_importance(spark, model)


@query("model_comparison")
def model_comparison(spark, d):
    """V7: test metrics of the three stage-5 models at 0.50, ordered by AUC."""
    rows = None
    for family in MD.COMPARED:
        row = EV.metric_row(family, _scored(spark, d, family), 0.5).withColumn("best_params", F.lit(_fit(spark, d, family)[2]))
        rows = row if rows is None else rows.unionByName(row)
    return rows.orderBy(F.col("roc_auc").desc(), "model")


@query("final_metrics")
def final_metrics(spark, d):
    """V8 + O7: the best model by test AUC at its best-F1 threshold, with the reason."""
    family, auc = _best(spark, d)
    sc = _scored(spark, d, family)
    t = EV.best_threshold(EV.threshold_sweep(sc)).first()["threshold"]
    return EV.metric_row(family, sc, t).withColumn("reason", F.lit(
        f"highest test AUC of {len(MD.COMPARED)} models ({auc:.4f}); threshold with the best F1"))


@query("final_metrics_train_tuned")
def final_metrics_train_tuned(spark, d):
    """V8 + O7 (H6 option): threshold tuned on the latest 20% of the training period,
    then applied unchanged to the test rows."""
    family, _ = _best(spark, d)
    model = _fit(spark, d, family)[0]
    train = _frame(spark, d)[0]
    cut = train.agg(F.percentile(F.unix_date("inspection_date"), 0.8)).scalar()
    tail = MD.score(model, train.filter(F.unix_date("inspection_date") >= cut)).select("label", "prob")
    t = EV.best_threshold(EV.threshold_sweep(tail)).first()["threshold"]
    return EV.metric_row(family, _scored(spark, d, family), t).withColumn("tuned_on", F.lit("train tail (latest 20%)"))


@query("score_batch")
def score_batch(spark, d):
    """Score any number of rows with the best model: probability and prediction at the tuned threshold."""
    model = _fit(spark, d, _best(spark, d)[0])[0]
    return MD.score(model, _frame(spark, d)[1], S.FINAL_THRESHOLD).select("camis", "inspection_date", "label", "prob", "predicted")


@query("scored_sample")
def scored_sample(spark, d):
    """The first 50 rows scored by the best model in key order, with their inputs."""
    model = _fit(spark, d, _best(spark, d)[0])[0]
    _, test, nums, cats = _frame(spark, d)
    p = MD.score(model, test, S.FINAL_THRESHOLD)
    return (p.select(F.col("label").alias("Actual_Label"), F.col("predicted").alias("Predicted_Label"),
                     F.col("prob").alias("Predicted_Probability"), "camis", "inspection_date", *nums, *cats)
             .orderBy("camis", "inspection_date").limit(50))


def _pca(spark, d):
    key = (spark.sparkContext.applicationId, fingerprint(spark, d), "pca")
    if key not in _fits:
        c = B.clean(spark, d)
        _fits[key] = MD.pca_fit(c, S.PCA_FEATURES)
    return _fits[key]


@query("pca_variance")
def pca_variance(spark, d):
    """M6 + W6: explained variance ratio, cumulative share and components for 80%."""
    return MD.pca_variance(spark, _pca(spark, d))


@query("pca_loadings")
def pca_loadings(spark, d):
    """M7: sign-fixed loadings of the 12 features on every component."""
    return MD.pca_loadings(spark, _pca(spark, d), S.PCA_FEATURES)


def _covariance_sql():
    cols = S.PCA_FEATURES
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM clean), 0) AS {c}" for c in cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = lambda a, b: f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 0 END"
    body = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {one(a, b)} AS covariance FROM filled" for a, b in pairs)
    return rounded(f"SELECT * FROM ({body}) t", ["covariance"], f"filled AS (SELECT {filled} FROM clean)")


@query("pca_reconstruction", _covariance_sql())
def pca_reconstruction(spark, d):
    """M6 + M7 certified: loadings and variances give the standardized columns' covariances back."""
    return finish(MD.pca_reconstruction(spark, _pca(spark, d), S.PCA_FEATURES))


@query("pca_scores")
def pca_scores(spark, d):
    """M8: PC1 / PC2 for every row."""
    return MD.pca_scores(_pca(spark, d), B.clean(spark, d), S.PCA_FEATURES)


def _cluster_X(spark, d):
    key = (spark.sparkContext.applicationId, fingerprint(spark, d), "clusterX")
    if key not in _fits:
        X, cores = written(MD.cluster_matrix(B.clean(spark, d), S.CLUSTER_FEATURES), "cluster-matrix"), spark.sparkContext.defaultParallelism
        # many passes follow: small data is dealt over the cores once
        _fits[key] = X if X.rdd.getNumPartitions() >= cores else written(X.repartition(cores), "cluster-matrix")
    return _fits[key]


@query("histogram_pc1")
def histogram_pc1(spark, d):
    """50-bin density histogram of PC1 per outcome."""
    return SM.histogram_equal_width(MD.pca_scores(_pca(spark, d), B.clean(spark, d), S.PCA_FEATURES),
                                    "pc1", 50, group="failed", density=True)


@query("box_pc1")
def box_pc1(spark, d):
    """Box statistics of PC1 by region."""
    scores = MD.pca_scores(_pca(spark, d), B.clean(spark, d), S.PCA_FEATURES, carry=("boro",))
    return SM.box_stats_ranked(scores, "pc1", "boro", ["camis", "inspection_date"])


@query("kmeans_sweep")
def kmeans_sweep(spark, d):
    """M9 + M10: inertia and Euclidean silhouette for k = 2..8 (25 seeded restarts)."""
    return MD.kmeans_sweep(_cluster_X(spark, d))


def _silhouette_sql():
    """Mean silhouette over all pairs of the sample, from the definition."""
    cols = S.CLUSTER_FEATURES
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM clean)) AS {c}" for c in cols)
    scaled = ", ".join(f"CASE WHEN (SELECT stddev_pop({c}) FROM filled) = 0 THEN 0 ELSE "
                       f"({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled) END AS {c}" for c in cols)
    apart = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    ctes = (f"filled AS (SELECT camis, inspection_date, CASE WHEN has_yelp = 1 THEN 2 WHEN has_history = 1 THEN 0 ELSE 1 END AS cluster, {filled} FROM clean), "
            f"sampled AS (SELECT * FROM (SELECT camis, inspection_date, cluster, {scaled} FROM filled) z "
            "ORDER BY md5(camis || '|' || CAST(inspection_date AS VARCHAR) || '|42'), camis, inspection_date LIMIT 10000), "
            f"sums AS (SELECT a.camis, a.inspection_date, a.cluster AS own, b.cluster AS c, count(*) AS n, sum(sqrt({apart})) AS total "
            "FROM sampled a, sampled b GROUP BY ALL), "
            "ab AS (SELECT camis, inspection_date, sum(CASE WHEN c = own AND n > 1 THEN total / (n - 1) END) AS a, "
            "min(CASE WHEN c <> own THEN total / n END) AS b FROM sums GROUP BY ALL)")
    return rounded("SELECT CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0 "
                   "THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab", ["silhouette"], ctes)


@query("silhouette_euclidean", _silhouette_sql())
def silhouette_euclidean(spark, d):
    """Euclidean silhouette of the fixed profile assignment on a 10,000-row seeded sample."""
    X = _cluster_X(spark, d)
    c = B.clean(spark, d).select("camis", "inspection_date",
                                 (F.when(F.col("has_yelp") == 1, 2).when(F.col("has_history") == 1, 0)
                                  .otherwise(1)).alias("cluster"))
    j = X.join(c, ["camis", "inspection_date"])
    s = SM.seeded_sample(j, ["camis", "inspection_date"], 10000)
    dim = len(S.CLUSTER_FEATURES)
    flat = s.select("cluster", *[F.col("features")[i].alias(f"x{i}") for i in range(dim)])
    return finish(ST.silhouette_euclidean(flat, [f"x{i}" for i in range(dim)]))


@query("kmeans_final")
def kmeans_final(spark, d):
    """M11 + A17 + M12 + J10: K chosen among {3, 4} by silhouette, refit, profile and names."""
    X = _cluster_X(spark, d)
    sweep = MD.kmeans_sweep(X, ks=(3, 4))
    k = sweep.orderBy(F.col("silhouette").desc(), "k").first()["k"]
    centres = MD.kmeans_many(X, [k], MD.FINAL_RESTARTS)[k][0]
    assigned = MD.assign_clusters(X, centres).select("camis", "inspection_date", "cluster")
    c = B.clean(spark, d).join(assigned, ["camis", "inspection_date"])
    return finish(ST.cluster_names(cluster_profile_of(c)))


def _labels_sql():
    nums = ", ".join(f"('num__{c}')" for c in S.NUMERIC_FEATURES)
    cats = " UNION ALL ".join(
        f"SELECT DISTINCT 'cat__{c}_' || {c} AS feature FROM fe WHERE failed IS NOT NULL AND "
        f"inspection_date < DATE '{CUT}' AND {c} IS NOT NULL" for c in S.CATEGORICAL_FEATURES)
    clean = "feature"
    for a, b in S.FEATURE_LABEL_REPLACEMENTS:
        clean = f"replace({clean}, '{a}', '{b}')"
    return rounded(f"SELECT feature, {clean} AS feature_clean FROM (SELECT * FROM (VALUES {nums}) v(feature) "
                   f"UNION ALL {cats}) t", [])


@query("feature_labels", _labels_sql())
def feature_labels(spark, d):
    """readable names for every model input slot (numbers + seen categories)."""
    from ..operators import features as FE
    train, _ = FE.train_test(B.features(spark, d), CUT)
    nums = spark.createDataFrame([(f"num__{c}",) for c in S.NUMERIC_FEATURES], "feature string")
    parts = [nums] + [train.filter(F.col(c).isNotNull()).select(F.concat(F.lit(f"cat__{c}_"), F.col(c))
                                                              .alias("feature")).distinct()
                      for c in S.CATEGORICAL_FEATURES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("feature_clean", MD.readable(F.col("feature")))
