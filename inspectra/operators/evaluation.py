"""Model evaluation on a (label, probability) table: V1-V10, W8, O7.

Every metric is one aggregate pass over the scored rows; curves aggregate by
distinct score (or by threshold bucket) first and take running sums over that
aggregated table with the bucketed ``summary.running_totals``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .summary import running_totals

EPS = 1e-9


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(scored: DataFrame, threshold: float, label: str = "label", prob: str = "prob") -> DataFrame:
    """TP, FP, TN, FN at ``prob >= threshold`` in one pass."""
    pred = F.col(prob) >= F.lit(threshold)
    y = F.col(label) == 1
    return scored.agg(F.count_if(pred & y).cast("long").alias("tp"),
                      F.count_if(pred & ~y).cast("long").alias("fp"),
                      F.count_if(~pred & ~y).cast("long").alias("tn"),
                      F.count_if(~pred & y).cast("long").alias("fn"))


def confusion_counts_at(scored: DataFrame, thresholds, label: str = "label", prob: str = "prob") -> DataFrame:
    """TP, FP, TN, FN at several thresholds in one pass: one row per threshold."""
    y = F.col(label) == 1
    cells = []
    for t in thresholds:
        pred = F.col(prob) >= F.lit(float(t))
        cells.append(F.struct(F.lit(float(t)).alias("threshold"),
                              F.count_if(pred & y).cast("long").alias("tp"),
                              F.count_if(pred & ~y).cast("long").alias("fp"),
                              F.count_if(~pred & ~y).cast("long").alias("tn"),
                              F.count_if(~pred & y).cast("long").alias("fn")))
    return scored.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """V1: accuracy, precision, recall, F1 (0 when undefined)."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    keep = [F.col("threshold")] if "threshold" in c.columns else []
    return c.select(*keep, _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _ratio(2 * prec * rec, prec + rec).alias("f1"))


def classification_metrics(scored: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    return metrics_from_counts(confusion_counts(scored, threshold, **kw))


def score_histogram(scored: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Positives and negatives per distinct score (the input of V2/V4)."""
    return scored.groupBy(F.col(prob).alias("s")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("pos"),
        F.count_if(F.col(label) != 1).cast("long").alias("neg"))


def roc_auc(scored: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """V2: exact AUC with ties counted half: sum pos * (neg below + neg tied / 2) / (P N)."""
    h = score_histogram(scored, label, prob)
    h = running_totals(h, ["s"], {"_cum_neg": F.col("neg")}).withColumn("_below", F.col("_cum_neg") - F.col("neg"))
    return h.agg(_ratio(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)),
                        F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def grouped_auc(scored: DataFrame, keys: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """V2 for every group of ``keys`` at once: (keys, auc), from one global running sum over (keys, score)."""
    h = scored.groupBy(*keys, F.col(prob).alias("s")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("pos"), F.count_if(F.col(label) != 1).cast("long").alias("neg"))
    h = running_totals(h, [*keys, "s"], {"_cum_neg": F.col("neg")})
    # a group's first row tells what came before the group
    before = F.min(F.col("_cum_neg") - F.col("neg"))
    area = F.sum(F.col("pos") * (F.col("_cum_neg") - F.col("neg") / 2.0)) - F.sum("pos") * before
    return h.groupBy(*keys).agg(_ratio(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_points(scored: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """(fpr, tpr) at every distinct score, descending, from cumulative counts."""
    h = score_histogram(scored, label, prob).withColumn("_ns", -F.col("s"))
    tot = h.agg(F.struct(F.sum("neg").alias("N"), F.sum("pos").alias("P"))).scalar()
    h = running_totals(h, ["_ns"], {"_fp": F.col("neg"), "_tp": F.col("pos")})
    return h.select(
        F.col("s").alias("threshold"),
        _ratio(F.col("_fp").cast("double"), tot["N"]).alias("fpr"),
        _ratio(F.col("_tp").cast("double"), tot["P"]).alias("tpr"))


def threshold_sweep(scored: DataFrame, label: str = "label", prob: str = "prob",
                    lo: int = S.SWEEP_FROM, hi: int = S.SWEEP_TO) -> DataFrame:
    """V3: precision / recall / F1 / accuracy at thresholds k/100, k = lo..hi, in one pass.

    Each row's bucket is the largest k with k/100 <= prob (tolerance 1e-9); a
    reverse running sum over the (hi - lo + 1) bucket rows gives predicted
    positives and true positives at every threshold.
    """
    spark = scored.sparkSession
    k = F.least(F.lit(hi), F.floor(F.col(prob) * 100 + EPS)).cast("int")
    b = scored.groupBy(k.alias("k")).agg(F.count_if(F.col(label) == 1).cast("long").alias("pos"),
                                         F.count(F.lit(1)).alias("cnt"))
    grid = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("k"))
    tot = b.agg(F.struct(F.sum("pos").alias("P"), F.sum("cnt").alias("N"))).scalar()
    g = grid.join(b, "k", "left").fillna(0, subset=["pos", "cnt"])
    rev = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"tp": F.sum("pos").over(rev), "pp": F.sum("cnt").over(rev)})
    tp, pp = F.col("tp").cast("double"), F.col("pp").cast("double")
    P, N = tot["P"].cast("double"), tot["N"].cast("double")
    prec, rec = _ratio(tp, pp), _ratio(tp, P)
    tn = (N - pp) - (P - tp)
    return g.select((F.col("k") / 100.0).alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                    _ratio(2 * prec * rec, prec + rec).alias("f1"), _ratio(tp + tn, N).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest threshold on ties."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1", "accuracy"),
                    F.struct(F.col("f1"), -F.col("threshold")))
    return sweep.agg(best.alias("b")).select("b.*")


def confusion_matrix(scored: DataFrame, threshold: float, label: str = "label", prob: str = "prob") -> DataFrame:
    """V5: 2x2 counts completed with zeros and row percentages."""
    spark = scored.sparkSession
    cells = spark.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    c = scored.groupBy(F.col(label).cast("int").alias("actual"),
                       (F.col(prob) >= threshold).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    m = cells.join(c, ["actual", "predicted"], "left").fillna(0, subset=["n"])
    return m.withColumn("row_share", _ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("actual"))))


def class_report(scored: DataFrame, threshold: float, label: str = "label", prob: str = "prob") -> DataFrame:
    """V9: per class precision / recall / F1 / support, plus macro and weighted averages."""
    c = confusion_counts(scored, threshold, label, prob)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))

    def row(name, t, f_p, f_n, support):
        p, r = _ratio(t, t + f_p), _ratio(t, t + f_n)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        _ratio(2 * p * r, p + r).alias("f1"), support.alias("support"))
    rows = c.select(F.explode(F.array(row("0", tn, fn, fp, tn + fp), row("1", tp, fp, fn, tp + fn))).alias("r"))
    per = rows.select("r.*")
    agg = per.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
                  F.sum("support").alias("n"))
    avgs = agg.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")))).alias("r"))
    return per.unionByName(avgs.select("r.*"))


def class_balance(df: DataFrame, label: str = "failed", split: str = "split") -> DataFrame:
    """Counts and rate per (split, label)."""
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def metric_row(name: str, scored: DataFrame, threshold: float, auc: DataFrame | None = None,
               label: str = "label", prob: str = "prob") -> DataFrame:
    """One metric-table row (U3 input): model, threshold, V1 metrics and AUC."""
    m = classification_metrics(scored, threshold, label=label, prob=prob)
    a = (auc if auc is not None else roc_auc(scored, label, prob)).select("auc").scalar()
    return m.select(F.lit(name).alias("model"), F.lit(float(threshold)).alias("threshold"),
                    "accuracy", "precision", "recall", "f1", a.alias("roc_auc"))
