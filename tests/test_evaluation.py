"""Exact AUC with ties, threshold sweep against brute force, confusion matrix."""

import numpy as np

from inspectra.operators import evaluation as EV


def _scored(spark, labels, probs):
    return spark.createDataFrame(list(zip(labels, probs)), "label int, prob double")


def test_auc_ties_count_half(spark):  # MF12
    assert abs(EV.roc_auc(_scored(spark, [1, 0, 1, 0], [0.9, 0.9, 0.4, 0.1])).first().auc - 0.625) < 1e-12


def test_sweep_matches_brute_force(spark):  # includes MF17 (score exactly .47)
    rng = np.random.default_rng(5)
    probs = np.round(rng.random(300), 2).tolist() + [0.47, 0.47]
    labels = (rng.random(302) < 0.4).astype(int).tolist()
    sweep = {round(r.threshold, 2): r for r in EV.threshold_sweep(_scored(spark, labels, probs)).collect()}
    y, p = np.array(labels), np.array(probs)
    for k in range(10, 91):
        t = k / 100
        pred = p >= t - 1e-9
        tp = int((pred & (y == 1)).sum())
        prec = tp / pred.sum() if pred.sum() else 0.0
        rec = tp / (y == 1).sum()
        assert abs(sweep[t].precision - prec) < 1e-12 and abs(sweep[t].recall - rec) < 1e-12
        assert abs(sweep[t].accuracy - (pred == (y == 1)).mean()) < 1e-12


def test_recall_non_increasing(spark):
    rng = np.random.default_rng(2)
    s = _scored(spark, (rng.random(200) < 0.3).astype(int).tolist(), rng.random(200).tolist())
    rec = [r.recall for r in EV.threshold_sweep(s).orderBy("threshold").collect()]
    assert all(a >= b for a, b in zip(rec, rec[1:]))


def test_confusion_cells_sum_to_n(spark):
    s = _scored(spark, [1, 1, 0, 0, 0], [0.9, 0.2, 0.8, 0.1, 0.47])
    m = {(r.actual, r.predicted): r.n for r in EV.confusion_matrix(s, 0.47).collect()}
    assert m == {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 1}


def test_metrics_zero_when_undefined(spark):
    r = EV.classification_metrics(_scored(spark, [0, 1], [0.1, 0.2]), 0.5).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0) and r.accuracy == 0.5


def test_best_threshold_first_on_ties(spark):
    sw = spark.createDataFrame([(0.1, 0.5, 0.5, 0.4, 0.5), (0.2, 0.5, 0.5, 0.4, 0.5), (0.3, 0.1, 0.1, 0.1, 0.1)],
                               "threshold double, precision double, recall double, f1 double, accuracy double")
    assert EV.best_threshold(sw).first().threshold == 0.1


def test_metric_identities_of_published_row(spark):
    # published test period: n = 23,591, positives 4,355; logistic at 0.50 has
    # recall .5378, precision .2533 and accuracy .6221 -> TP 2,342, predicted positive 9,245
    n, pos, tp, pp = 23591, 4355, 2342, 9245
    fp, fn = pp - tp, pos - tp
    tn = n - tp - fp - fn
    c = spark.createDataFrame([(tp, fp, tn, fn)], "tp long, fp long, tn long, fn long")
    r = EV.metrics_from_counts(c).first()
    assert round(r.recall, 4) == 0.5378 and round(r.precision, 4) == 0.2533
    assert round(r.f1, 4) == 0.3444 and round(r.accuracy, 4) == 0.6221
    # majority baseline on the same rows: accuracy .8154, everything else 0
    b = EV.metrics_from_counts(spark.createDataFrame([(0, 0, n - pos, pos)], "tp long, fp long, tn long, fn long")).first()
    assert round(b.accuracy, 4) == 0.8154 and (b.precision, b.recall, b.f1) == (0.0, 0.0, 0.0)
