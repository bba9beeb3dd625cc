"""Modelling: M6-M9, M11, M14, M16, M18-M24, X5.

The searches fit all folds and grid points side by side: preprocessing by
leave-one-out sums (``prepare``), logistic regressions by batched Newton passes
(``linear``), forests and boosted trees by histograms and staged evaluation
(``trees``).  Folds come from ``stats.stratified_folds``.  PCA and k-means use MLlib.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import written
from . import linear as LN
from . import stats as ST
from . import trees as TR
from .evaluation import grouped_auc
from .prepare import INFREQUENT, Preparation, View, fit_views, prepare

# the published searches: parameter lists and stratified folds
GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2"], "folds": 5},      # stage 4, categories as they are
    "logistic_pooled": {"C": [0.1, 1.0], "penalty": ["l1", "l2"], "folds": 3},           # stage 5, rare ones pooled
    "forest": {"numTrees": [100, 200], "maxDepth": [8, 12], "minInstancesPerNode": [5, 10], "folds": 3},
    "boosted": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [2, 3], "folds": 3},
}
#: Stage 5 families, in the published order, with the rows a category needs to keep a slot of its own.
COMPARED = {"logistic_pooled": 20, "forest": 20, "boosted": 20}
#: Rows a task of a fit holds: a fit is many short jobs, so small data goes in few partitions, one per
#: MIN_ROWS_PER_TASK rows as far as there are cores.
MIN_ROWS_PER_TASK, ROWS_PER_TASK = 2_000, 20_000


def model_frame(features: DataFrame, cutoff: str, target: str = "failed"):
    """Time split with the label and the model inputs; nothing is fitted here."""
    from .features import train_test
    nums = S.resolve_features(features, S.NUMERIC_FEATURES)
    cats = S.resolve_features(features, S.CATEGORICAL_FEATURES)
    base = features.select("camis", "inspection_date", F.col(target).cast("int").alias("label"),
                           *[F.col(c).cast("double").alias(c) for c in nums], *cats)
    base = base.withColumn("failed", F.col("label"))
    train, test = train_test(base, cutoff, target="failed")
    return train, test, nums, cats


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def category_rules(fit: DataFrame, cats, rare_min: int | None) -> SQLTransformer:
    """M13 + M15 fitted on ``fit``: NULL -> the most frequent value, then a value
    seen fewer than ``rare_min`` times -> one pooled value.

    A stage of the pipeline (it is saved with the model).  The values it names
    are labels of a category, as the indexer behind it holds them too.
    """
    modes = {r["feature"]: r["mode"] for r in ST.mode_values(fit, cats).select("feature", "mode").collect()}
    out = []
    for c in cats:
        value = f"coalesce(`{c}`, {_quoted(modes[c])})" if modes.get(c) is not None else f"`{c}`"
        if rare_min:
            counts = (fit.select(F.coalesce(F.col(c), F.lit(modes.get(c))).alias("v")).groupBy("v")
                      .agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") < rare_min) & F.col("v").isNotNull()))
            rare = sorted(r["v"] for r in counts.select("v").collect())
            if rare:
                value = f"CASE WHEN {value} IN ({', '.join(map(_quoted, rare))}) THEN '{INFREQUENT}' ELSE {value} END"
        out.append(f"{value} AS `_cat_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(out)} FROM __THIS__")


def preprocessor(numeric, categorical, fit: DataFrame, rare_min: int | None = None, scale: bool = True) -> PipelineModel:
    """M3 + M4 + M13-M16 fitted on ``fit`` alone: category rules, median impute,
    z-score, string index, one-hot, one feature vector."""
    imp_out = [f"_imp_{c}" for c in numeric]
    stages = [category_rules(fit, categorical, rare_min)] if categorical else []
    stages += [Imputer(inputCols=list(numeric), outputCols=imp_out, strategy="median"),
               VectorAssembler(inputCols=imp_out, outputCol="_num", handleInvalid="keep")]
    num_vec = "_num"
    if scale:
        stages.append(StandardScaler(inputCol="_num", outputCol="_num_z", withMean=True, withStd=True))
        num_vec = "_num_z"
    idx = [f"_idx_{c}" for c in categorical]
    ohe = [f"_ohe_{c}" for c in categorical]
    if categorical:
        stages += [StringIndexer(inputCols=[f"_cat_{c}" for c in categorical], outputCols=idx, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]   # drops the indexer's unseen slot
    stages.append(VectorAssembler(inputCols=[num_vec] + ohe, outputCol="features"))
    return Pipeline(stages=stages).fit(fit)


@dataclass
class Model:
    """A fitted classifier with its preprocessing: ``kind`` linear (coefficients, the intercept first), forest or boosted (trees)."""

    family: str
    params: str
    prep: Preparation
    view: int
    kind: str
    coefficients: np.ndarray | None = None
    trees: list | None = None
    cuts: list | None = None
    depth: int = 0
    rate: float = 0.0
    prior: float = 0.0

    def probabilities(self, nums: np.ndarray, cats: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.kind == "linear":
            eta = self.prep.matrix(nums, cats, self.view, True) @ self.coefficients[1:] + self.coefficients[0]
            return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        codes, n = TR.binned(self.prep, self.cuts, nums, cats, self.view), len(self.trees)
        if self.kind == "forest":
            return TR.forest_probabilities(self.trees, codes, [n], [self.depth])[n, self.depth]
        return 1 / (1 + np.exp(-TR.boosted_margins(self.trees, codes, [n], self.rate, self.prior)[n]))

    def slot_values(self) -> np.ndarray:
        """Per slot: coefficient, or the trees' mean share of the gain."""
        if self.kind == "linear":
            return self.coefficients[1:]
        total = np.zeros(self.prep.width)
        for t in self.trees:
            level = np.zeros(len(t["left"]), int)
            for node in np.flatnonzero(t["left"] >= 0):
                level[t["left"][node]:t["left"][node] + 2] = level[node] + 1
            used = (t["left"] >= 0) & (level < self.depth)
            own = np.bincount(t["slot"][used], weights=t["gain"][used], minlength=len(total))
            total += own / own.sum() if own.sum() else own
        return total / total.sum() if total.sum() else total

    def save(self, spark: SparkSession, path: str) -> None:
        """The description as JSON, the nodes of trees as a Parquet table."""
        spec = asdict(replace(self, trees=None))
        text = json.dumps(spec, default=lambda x: x.tolist())
        spark.createDataFrame([(text,)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        if self.trees is not None:
            nodes = pd.concat([pd.DataFrame({"tree": k, "node": np.arange(len(t["left"])), **t}) for k, t in enumerate(self.trees)])
            spark.createDataFrame(nodes.astype({"bin": "int32"})).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        spec = json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])
        views = [View(*(np.array(v[k], float) for k in ("medians", "means", "deviations")), v["modes"],
                      [np.array(s, int) for s in v["slots"]], tuple(v["weights"]), v["rows"]) for v in spec["prep"]["views"]]
        prep = Preparation(**{**spec["prep"], "views": views})
        out = cls(**{**spec, "prep": prep})
        if out.kind == "linear":
            out.coefficients = np.array(out.coefficients)
        else:
            out.cuts = [np.array(c) for c in out.cuts]
            nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
            kinds = {"slot": np.int32, "bin": np.uint8, "left": np.int32, "value": float, "gain": float}
            out.trees = [{c: g[c].to_numpy().astype(k) for c, k in kinds.items()} for _, g in nodes.groupby("tree")]
        return out


def _points(family: str, grid: dict) -> list[tuple[dict, str]]:
    """(parameters, parameter text) of every point of a grid, in the published order."""
    if family.startswith("logistic"):
        return [({"C": c, "penalty": p}, f"C={c}, penalty={p}") for c in grid["C"] for p in grid["penalty"]]
    if family == "forest":
        return [({"trees": t, "depth": d, "leaf": m}, f"trees={t}, depth={d}, leaf={m}")
                for t in grid["numTrees"] for d in grid["maxDepth"] for m in grid["minInstancesPerNode"]]
    return [({"trees": t, "rate": r, "depth": d}, f"trees={t}, rate={r}, depth={d}")
            for t in grid["maxIter"] for r in grid["stepSize"] for d in grid["maxDepth"]]


def _forest(prep: Preparation, view: int, leaf: int, trees: int, depth: int) -> list:
    return [TR.Forest(view, leaf, k, depth, prep.width, prep.views[view].weights, S.SEED) for k in range(trees)]


def _boosted(prep: Preparation, view: int, rate: float, depth: int, trees: int) -> TR.Boosted:
    w0, w1 = prep.views[view].weights  # n / (2 n_c): their ratio is the odds
    return TR.Boosted(view, rate, depth, trees, prep.width, float(np.log(w0 / w1)) if w0 and w1 else 0.0)


def training_rows(train: DataFrame, keys, nums, cats, folds: int, rare_min: int | None):
    """(rows, preparation, number of rows): fold, label, uid and the coded inputs, written once for all passes."""
    prep = prepare(train, nums, cats, rare_min)
    coded = train.select(*keys, F.col("label").cast("int").alias("label"), F.xxhash64(*keys).alias("uid"), *prep.inputs())
    folded = ST.stratified_folds(coded, keys, folds, label="label")  # of coded rows: fewer bytes are ranged and sorted
    rows = written(folded.select("fold", "label", "uid", "nums", "cats"), "rows")
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, n // MIN_ROWS_PER_TASK), n // ROWS_PER_TASK)
    if rows.rdd.getNumPartitions() != tasks:
        rows = written(rows.repartition(tasks).sortWithinPartitions("cats"), "rows")  # equal codes side by side
    return rows, fit_views(prep, rows, folds), n


def fit_family(train: DataFrame, nums, cats, family: str, grid: dict | None = None, rare_min: int | None = None, prepared=None):
    """M16 + M18/M19/M20 + M21: grid search by stratified k-fold AUC, refit on all train.

    Preprocessing is fitted per fold on the fold's own training part only, for
    all folds in one go; all points of the grid and all folds are fitted side by side.
    ``prepared``: what ``training_rows`` gave for these rows, folds and ``rare_min``, if they are prepared already.

    Returns (best Model, table of (model, params, cv_auc) rows, best params text).
    """
    grid = grid or GRIDS[family]
    folds, points, spark = grid["folds"], _points(family, grid), train.sparkSession
    rows, prep, n = prepared or training_rows(train, ["camis", "inspection_date"], nums, cats, folds, rare_min)
    every = list(range(folds))
    if family.startswith("logistic"):
        found = LN.fit(rows, prep, [(p["C"], p["penalty"]) for p, _ in points], every + [folds])
        held = spark.sparkContext.broadcast((prep, found))

        def score_own(batches):
            prep, found = held.value
            for batch in batches:
                x, codes = LN.rows_of(batch) if batch.num_rows else (None, None)
                fold, label = (batch.column(c).to_numpy() for c in ("fold", "label"))
                for v in np.unique(fold).tolist():
                    own = fold == v
                    m = prep.matrix(x[own], codes[own], v, True)
                    for j in range(len(points)):
                        eta = m @ found[v, j][1:] + found[v, j][0]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), j, np.int32)), pa.array(fold[own].astype(np.int32)),
                                                          pa.array(label[own].astype(np.int32)), pa.array(1 / (1 + np.exp(-np.clip(eta, -700, 700))))],
                                                         names=["point", "fold", "label", "prob"])

        own = written(rows.select("fold", "label", "nums", "cats").mapInArrow(score_own, "point int, fold int, label int, prob double"), "predictions")
    else:
        share = min(1.0, TR.EDGE_ROWS / max(n, 1))
        sample = rows.where(F.pmod("uid", F.lit(1 << 20)) < int(share * (1 << 20)))
        cuts = TR.edges(prep, sample, folds)
        searches = []
        for v in every:
            if family == "forest":
                trees, depth = max(grid["numTrees"]), max(grid["maxDepth"])
                for m in grid["minInstancesPerNode"]:
                    numbers = {(p["trees"], p["depth"]): j for j, (p, _) in enumerate(points) if p["leaf"] == m}
                    searches.append(TR.Search(v, _forest(prep, v, m, trees, depth), numbers))
            else:
                for r in grid["stepSize"]:
                    for d in grid["maxDepth"]:
                        numbers = {(p["trees"], d): j for j, (p, _) in enumerate(points) if (p["rate"], p["depth"]) == (r, d)}
                        searches.append(TR.Search(v, [_boosted(prep, v, r, d, max(grid["maxIter"]))], numbers))
        own = TR.validate(rows, prep, cuts, searches, n)
    auc = {(r["point"], r["fold"]): r["auc"] for r in grouped_auc(own, ["point", "fold"]).collect()}  # a row per point and fold
    mean = [sum(auc.get((j, f), 0.0) for f in every) / folds for j in range(len(points))]
    best = max(range(len(mean)), key=lambda i: mean[i])        # the first one on ties
    p, text = points[best]
    # the last view's own figures suffice from here on
    if family.startswith("logistic"):
        model = Model(family, text, prep, folds, "linear", coefficients=found[folds, best])
    elif family == "forest":
        grown = TR.grow(rows, prep, cuts, _forest(prep, folds, p["leaf"], p["trees"], p["depth"]), n)
        model = Model(family, text, prep, folds, "forest", trees=[g.tree.arrays() for g in grown], cuts=cuts[folds], depth=p["depth"])
    else:
        g = TR.grow(rows, prep, cuts, [_boosted(prep, folds, p["rate"], p["depth"], p["trees"])], n)[0]
        model = Model(family, text, prep, folds, "boosted", trees=g.done, cuts=cuts[folds], depth=p["depth"], rate=g.rate, prior=g.prior)
    table = spark.createDataFrame([(family, name, float(m)) for (_, name), m in zip(points, mean)], "model string, params string, cv_auc double")
    return model, table, text


def best_family(comparison: DataFrame) -> tuple[str, float]:
    """Name and AUC of the best row of a model comparison (a row per family; ties by name)."""
    r = comparison.orderBy(F.col("roc_auc").desc(), "model").first()
    return r["model"], r["roc_auc"]


def score(model: Model, df: DataFrame, threshold: float = S.FINAL_THRESHOLD) -> DataFrame:
    """M22 + X5: class-1 probability and the thresholded prediction, beside the columns of ``df``."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def prob(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = held.value
        for nums, cats in batches:
            if not len(nums):
                yield pd.Series([], dtype=float)
                continue
            x = np.array(nums.tolist(), float).reshape(len(nums), -1)
            yield pd.Series(m.probabilities(x, np.array(cats.tolist(), np.int64).reshape(len(cats), -1)))

    p = df.withColumn("prob", prob(*model.prep.inputs()))
    return p.withColumn("predicted", (F.col("prob") >= threshold).cast("int"))


def slot_names(model: Model) -> list[str]:
    """Names of the model's inputs: num__x, then cat__col_value of the values that have a slot."""
    return [name for name, _ in model.prep.names(model.view)]


def _slot_frame(spark: SparkSession, model: Model, column: str) -> DataFrame:
    values = model.slot_values()
    return spark.createDataFrame([(name, float(values[at])) for name, at in model.prep.names(model.view)], f"feature string, {column} double")


def readable(name_col) -> F.Column:
    """literal replacements to readable feature names, in the published order."""
    out = name_col
    for a, b in S.FEATURE_LABEL_REPLACEMENTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def coefficients(spark: SparkSession, model: Model) -> DataFrame:
    """M23 + F7 + F8: coefficient table with readable names, |coef| and odds ratio."""
    return _slot_frame(spark, model, "coefficient").withColumns({
        "abs_coefficient": F.round(F.abs("coefficient"), 3), "odds_ratio": F.exp("coefficient"), "feature_clean": readable(F.col("feature"))})


def feature_importance(spark: SparkSession, model: Model, k: int = 15) -> DataFrame:
    """Coefficients or tree importances, top-k by |value| then ascending."""
    df = _slot_frame(spark, model, "importance")
    top = df.withColumn("abs_importance", F.abs("importance")).orderBy(F.col("abs_importance").desc(), "feature").limit(k)
    return top.orderBy("abs_importance", F.col("feature").desc()).withColumn("feature_clean", readable(F.col("feature")))


def _standardized(df: DataFrame, cols, out: str) -> list:
    """Stages: exact median impute (an all-null column becomes 0), then z-score into ``out``."""
    row = ST.medians(df, cols).first()
    fill = ", ".join(f"coalesce(`{c}`, {0.0 if row[c] is None else float(row[c])!r}D) AS `_i_{c}`" for c in cols)
    return [SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_i_{c}" for c in cols], outputCol="_v"),
            StandardScaler(inputCol="_v", outputCol=out, withMean=True, withStd=True)]


def pca_fit(df: DataFrame, cols, k: int | None = None):
    """M6: median impute, z-score (withMean) and PCA with all components."""
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return Pipeline(stages=[*_standardized(src, cols, "_z"), PCA(k=k or len(cols), inputCol="_z", outputCol="pcs")]).fit(src)


def pca_reconstruction(spark: SparkSession, model: PipelineModel, cols) -> DataFrame:
    """M6 + M7 certified: the covariance of every pair of standardized columns as loadings and variances give it back.

    With all components kept it equals the data's own covariance exactly if the
    loadings are its eigenvectors and the variances its eigenvalues.
    """
    last, scaler = model.stages[-1], model.stages[-2]
    v, share = last.pc.toArray(), last.explainedVariance.toArray()
    whole = v @ np.diag(share * float((np.array(scaler.std) > 0).sum())) @ v.T
    rows = [(cols[i], cols[j], float(whole[i, j])) for i in range(len(cols)) for j in range(i, len(cols))]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, covariance double")


def pca_variance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """M6 + W6: explained-variance ratio per component, cumulative, and the
    first component count reaching 80%."""
    evr = model.stages[-1].explainedVariance.toArray()
    df = spark.createDataFrame([(f"PC{i + 1}", i + 1, float(v)) for i, v in enumerate(evr)],
                               "component string, k int, explained_variance_ratio double")
    from pyspark.sql import Window
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("cumulative", F.sum("explained_variance_ratio").over(w))
    n80 = df.filter(F.col("cumulative") >= 0.8).agg(F.min("k")).scalar()
    return df.withColumn("n_components_80", n80)


def pca_loadings(spark: SparkSession, model: PipelineModel, cols) -> DataFrame:
    """M7: loadings (features x components), sign fixed so the largest |loading| is positive."""
    pc = model.stages[-1].pc.toArray()
    rows = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        sign = 1.0 if col[abs(col).argmax()] >= 0 else -1.0
        rows += [(cols[i], f"PC{j + 1}", float(sign * col[i])) for i in range(pc.shape[0])]
    return spark.createDataFrame(rows, "feature string, component string, loading double")


def pca_scores(model: PipelineModel, df: DataFrame, cols, keys=("camis", "inspection_date"), carry=("failed",)) -> DataFrame:
    """M8: PC1 / PC2 scores per row (sign convention of ``pca_loadings``), with the ``carry`` columns."""
    pc = model.stages[-1].pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    t = model.transform(df.select(*keys, *carry, *[F.col(c).cast("double").alias(c) for c in cols]))
    arr = vector_to_array("pcs")
    return t.select(*keys, *carry, (arr[0] * signs[0]).alias("pc1"), (arr[1] * signs[1]).alias("pc2"))


#: Published restarts of the sweep and of the final fit.
SWEEP_RESTARTS, FINAL_RESTARTS = 25, 50


KMEANS_ITERATIONS = 50
#: Rows that a restart's starting centres are chosen among, about.
_STARTS = 64


def cluster_matrix(df: DataFrame, cols):
    """Median impute + z-score the clustering inputs once (M9): camis, inspection_date, features (array), for the caller to write."""
    src = df.select("camis", "inspection_date", *[F.col(c).cast("double").alias(c) for c in cols])
    filled = ST.median_impute(src, cols)
    return ST.zscore(filled, cols).select("camis", "inspection_date", F.array(*cols).alias("features"))


def _starts(X: DataFrame, restarts: int, most: int) -> list[np.ndarray]:
    """Per restart, the ``most`` rows with the smallest hash (ties by key): any k of them are its first centres."""
    n = max(1, X.count())
    h = F.xxhash64("camis", "inspection_date", "restart")
    near = (X.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).withColumn("h", h)
            .where(F.pmod(F.xxhash64("h"), F.lit(n)) < _STARTS).select("restart", "h", "camis", "features").collect())  # about 64 a restart
    out = []
    for r in range(restarts):
        own = sorted((x for x in near if x["restart"] == r), key=lambda x: (x["h"], x["camis"]))[:most]
        out.append(np.array([x["features"] for x in own], float).reshape(len(own), len(own[0]["features"]) if own else 0))
    return out


#: Rows whose distances to all centres of the runs of one k are held at once.
_ROWS_AT_ONCE = 512


def _distance_terms(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(-2 x centre, its square) of the centres of several runs, c: runs x k x dim.

    A centre equal to an earlier one of its run has an infinite square: the first of them takes the rows.
    """
    same = (c[:, :, None, :] == c[:, None, :, :]).all(axis=3)
    again = np.tril(same, -1).any(axis=2)
    return -2 * c.reshape(-1, c.shape[2]), np.where(again, np.inf, (c * c).sum(axis=2)).reshape(-1, 1)


def _nearest_sums(x, one, square, twice, square_c, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run, its centres' sums and counts of the rows nearest to them (ties: the first), and the cost; ``one``: x with a column of ones."""
    runs, n = len(twice) // k, len(x)
    d = twice @ x.T
    d += square_c
    d = d.reshape(runs, k, n)
    low = d.min(axis=1)
    near = d == low[:, None, :]
    sums = (near.reshape(runs * k, n).astype(float) @ one).reshape(runs, k, -1)
    for r in np.flatnonzero(sums[:, :, -1].sum(axis=1) != n):  # a row as near to two centres
        first = np.zeros((k, n))
        first[d[r].argmin(axis=0), np.arange(n)] = 1.0
        sums[r] = first @ one
    low += square
    return sums.reshape(runs, -1), np.maximum(low, 0, out=low).sum(axis=1)


def kmeans_many(X: DataFrame, ks, restarts: int = SWEEP_RESTARTS, iterations: int = KMEANS_ITERATIONS) -> dict:
    """{k: (centres, inertia)}, the best of ``restarts`` Lloyd runs for every k; one scan an iteration for all of them.

    Tasks add up per centre the rows it is nearest to (ties: the first centre);
    a centre without rows stays.  A run ends when its centres no longer move.
    """
    ks, spark = list(ks), X.sparkSession
    starts = _starts(X, restarts, max(ks))
    models = [(k, s[:k].copy()) for k in ks for s in starts if len(s) >= k]
    if not models:
        return {}
    dim = models[0][1].shape[1]
    width, size = max(ks), max(ks) * (dim + 1) + 1
    active, cost = np.ones(len(models), bool), np.zeros(len(models))
    for step in range(iterations + 1):
        held = spark.sparkContext.broadcast([(k, at, np.array([models[i][1] for i in at])) for k in dict.fromkeys(ks)
                                             if (at := [i for i in np.flatnonzero(active).tolist() if models[i][0] == k])])

        def run(batches, held=held):
            groups = [(k, at, c, *_distance_terms(c)) for k, at, c in held.value]
            total = np.zeros((len(models), size))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for i in range(0, len(x), _ROWS_AT_ONCE):
                    part = x[i:i + _ROWS_AT_ONCE]
                    one = np.concatenate([part, np.ones((len(part), 1))], axis=1)
                    square = (part * part).sum(axis=1)
                    for k, at, c, twice, square_c in groups:
                        sums, cost = _nearest_sums(part, one, square, twice, square_c, k)
                        total[at, :k * (dim + 1)] += sums
                        total[at, -1] += cost
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["key", "data"])

        sums = LN.sum_arrays(X.select("features").mapInArrow(run, "key int, data binary"), 1, (len(models), size))[0]
        held.unpersist()
        for i in np.flatnonzero(active):
            k, c = models[i]
            part = sums[i, :-1].reshape(width, dim + 1)[:k]
            cost[i] = sums[i, -1]
            new = np.where(part[:, dim:] > 0, part[:, :dim] / np.maximum(part[:, dim:], 1), c)
            active[i] = np.abs(new - c).max(initial=0) > 1e-9 and step < iterations
            if active[i]:
                models[i] = (k, new)
        if not active.any():
            break
    out = {}
    for i, (k, c) in enumerate(models):
        if k not in out or cost[i] < out[k][1]:
            out[k] = (c, float(cost[i]))
    return out


def assign_clusters(X: DataFrame, centres: np.ndarray) -> DataFrame:
    """X with its nearest centre's number (ties: the first) as ``cluster``."""
    d = F.array(*(F.aggregate(F.zip_with("features", F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
                  for c in centres))
    return X.withColumn("_d", d).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def kmeans_sweep(X: DataFrame, ks=range(2, 9), restarts: int = SWEEP_RESTARTS, silhouette_n: int = 10000):
    """M9 + M10: inertia and Euclidean silhouette (on a seeded sample) per k."""
    from .summary import seeded_sample
    sample = written(seeded_sample(X, ["camis", "inspection_date"], silhouette_n), "sample")
    rows = []
    for k, (centres, inertia) in sorted(kmeans_many(X, ks, restarts).items()):
        flat = assign_clusters(sample, centres).select("cluster", *[F.col("features")[i].alias(f"x{i}") for i in range(centres.shape[1])])
        sil = ST.silhouette_euclidean(flat, [f"x{i}" for i in range(centres.shape[1])]).first()["silhouette"]
        rows.append((int(k), inertia, float(sil)))
    return X.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
