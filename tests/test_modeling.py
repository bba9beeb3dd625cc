"""Model search: views against plain fits, optimality, staged and distributed trees, save/load round trip."""

import numpy as np
import pandas as pd

from inspectra.operators import modeling as MD
from inspectra.sources import sinks

SMALL = {"C": [0.1, 1.0], "penalty": ["l2"], "folds": 3}


def test_logistic_pipeline_and_roundtrip(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(0, 1, n)
    y = (x + rng.normal(0, 0.5, n) > 0).astype(int)
    pdf = pd.DataFrame({"camis": [f"k{i}" for i in range(n)], "inspection_date": ["2020-01-01"] * n,
                        "label": y, "x": x, "cat": np.where(rng.random(n) < 0.5, "a", "b"), "weight": 1.0})
    train = spark.createDataFrame(pdf)
    model, table, best = MD.fit_family(train, ["x"], ["cat"], "logistic", SMALL)
    assert table.count() == 2
    scored = MD.score(model, train)
    from inspectra.operators.evaluation import roc_auc
    assert roc_auc(scored.select("label", "prob")).first().auc > 0.8
    sinks.save_model(model, f"{tmpdir_path}/m")
    again = MD.score(sinks.load_model(f"{tmpdir_path}/m"), train)
    a = sorted(r.prob for r in scored.select("prob").collect())
    b = sorted(r.prob for r in again.select("prob").collect())
    assert np.allclose(a, b)


def test_logistic_deterministic_across_partitionings(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"camis": [f"k{i}" for i in range(n)], "inspection_date": ["2020-01-01"] * n,
                        "label": (x + rng.normal(0, 1, n) > 0).astype(int), "x": x,
                        "cat": np.where(rng.random(n) < 0.3, "a", "b"), "weight": 1.0})
    base = spark.createDataFrame(pdf)
    coefs = []
    for parts in (2, 5):
        model, _, _ = MD.fit_family(base.repartition(parts), ["x"], ["cat"], "logistic", SMALL)
        coefs.append(model.coefficients)
    assert np.allclose(coefs[0], coefs[1], atol=1e-6)


def _train(spark, n=240):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, n)
    return spark.createDataFrame(pd.DataFrame({
        "camis": [f"k{i}" for i in range(n)], "inspection_date": ["2020-01-01"] * n, "label": (x > 0).astype(int), "x": x,
        "cat": [None if i % 9 == 0 else "rare" if i % 40 == 1 else "it's" if i % 2 else "b" for i in range(n)]}))


def test_five_folds_and_l1(spark):
    grid = {"C": [1.0], "penalty": ["l1", "l2"], "folds": 5}
    _, table, best = MD.fit_family(_train(spark), ["x"], ["cat"], "logistic", grid, rare_min=20)
    assert [r.params for r in table.collect()] == ["C=1.0, penalty=l1", "C=1.0, penalty=l2"] and best.startswith("C=1.0")


def test_tree_families_run(spark):
    train = _train(spark, 120)
    for family, grid in (("forest", {"numTrees": [3], "maxDepth": [3], "minInstancesPerNode": [1], "folds": 2}),
                         ("boosted", {"maxIter": [3], "stepSize": [0.1], "maxDepth": [2], "folds": 2})):
        model, table, _ = MD.fit_family(train, ["x"], ["cat"], family, grid, rare_min=20)
        assert table.count() == 1 and MD.score(model, train).count() == 120
        assert MD.feature_importance(spark, model).count() >= 2


def test_preprocessing_sees_its_own_rows_only(spark):
    train = _train(spark)
    prep = MD.preprocessor(["x"], ["cat"], train.filter("cat IS NULL OR cat <> 'b'"), rare_min=20)
    labels = [s for s in prep.stages if s.__class__.__name__ == "StringIndexerModel"][0].labelsArray[0]
    assert list(labels) == ["__infrequent__", "it's"]
    got = {r.cat: r._cat_cat for r in prep.transform(train).collect()}
    assert got == {None: "it's", "rare": "__infrequent__", "it's": "it's", "b": "b"}  # b is unseen: no slot
    row = prep.transform(train.filter("cat = 'b'")).first()
    assert row["_ohe_cat"].toArray().sum() == 0


def test_each_family_can_be_the_best(spark):
    names = list(MD.COMPARED)
    for k, name in enumerate(names):
        rows = [(n, 0.6 if i == k else 0.5) for i, n in enumerate(names)]
        assert MD.best_family(spark.createDataFrame(rows, "model string, roc_auc double")) == (name, 0.6)
    assert MD.best_family(spark.createDataFrame([("b", 0.5), ("a", 0.5)], "model string, roc_auc double"))[0] == "a"


def _frame(spark, n=260, seed=8):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(0, 1, n), rng.integers(0, 4, n).astype(float)
    y = (x + 0.5 * (z == 2) + rng.normal(0, 0.8, n) > 0.3).astype(int)
    cat = rng.choice(["a", "b", "it's", "rare"], n, p=[0.5, 0.3, 0.15, 0.05])
    rows = [(f"k{i}", "2020-01-01", int(y[i]), None if i % 17 == 0 else float(x[i]), 1e9 + float(z[i]), None if i % 13 == 0 else str(cat[i])) for i in range(n)]
    return spark.createDataFrame(rows, "camis string, inspection_date string, label int, x double, z double, cat string").repartition(3)


def _data(spark, folds=3, rare_min=20):
    rows, prep, n = MD.training_rows(_frame(spark), ["camis", "inspection_date"], ["x", "z"], ["cat"], folds, rare_min)
    return rows, prep, n, rows.toPandas()


def test_views_equal_separate_fits(spark):
    _, prep, n, pdf = _data(spark)
    nums = np.array([[np.nan if v is None else v for v in r] for r in pdf["nums"]], float)
    cats = np.array(pdf["cats"].tolist())[:, 0]
    for v in range(4):
        own = (pdf["fold"] != v).to_numpy()
        view, a = prep.views[v], nums[own]
        med = np.nanmedian(a, axis=0)
        filled = np.where(np.isnan(a), med, a)
        assert view.rows == own.sum() and np.allclose(view.medians, med)
        assert np.allclose(view.means, filled.mean(axis=0), rtol=1e-12) and np.allclose(view.deviations, filled.std(axis=0), rtol=1e-9)
        code = cats[own]
        count = {c: int((code == c).sum()) for c in range(1, 5)}
        mode = max(count, key=lambda c: (count[c], -c))
        count[mode] += int((code < 0).sum())
        assert view.modes == [mode]
        assert view.slots[0].tolist() == [-1] + [-1 if not count[c] else 4 if count[c] < 20 else c - 1 for c in range(1, 5)]
        label = pdf["label"][own]
        assert np.allclose(view.weights, [own.sum() / (2 * (label == k).sum()) for k in (0, 1)])


def test_logistic_meets_the_optimality_conditions(spark):
    rows, prep, n, pdf = _data(spark)
    points = [(c, p) for c in (0.01, 1.0, 10.0) for p in ("l1", "l2")]
    found = MD.LN.fit(rows, prep, points, [0, 1, 2, 3])
    nums = np.array([[np.nan if v is None else v for v in r] for r in pdf["nums"]], float)
    cats, label, fold = np.array(pdf["cats"].tolist()), pdf["label"].to_numpy(), pdf["fold"].to_numpy()
    for v in range(4):
        own = fold != v
        m = np.c_[np.ones(own.sum()), prep.matrix(nums[own], cats[own], v, True)]
        w = np.where(label[own] == 1, prep.views[v].weights[1], prep.views[v].weights[0])
        for j, (c, penalty) in enumerate(points):
            b = found[v, j]
            g = m.T @ (w * (1 / (1 + np.exp(-m @ b)) - label[own]))
            assert abs(g[0]) < 1e-5
            if penalty == "l2":
                assert np.abs(g[1:] + b[1:] / c).max() < 1e-5
            else:
                on = b[1:] != 0
                assert np.abs(g[1:][on] + np.sign(b[1:][on]) / c).max(initial=0) < 1e-5 and (np.abs(g[1:][~on]) <= 1 / c + 1e-6).all()


def _grown(spark, data, make, monkeypatch, distributed):
    rows, prep, n, _ = data
    cuts = MD.TR.edges(prep, rows, 3)
    with monkeypatch.context() as m:
        if distributed:
            for name, value in (("BROADCAST_BYTES", 0), ("PASS_BYTES", 20_000), ("MARGIN_TREES", 2)):
                m.setattr(MD.TR, name, value)
        growers = MD.TR.grow(rows, prep, cuts, make(prep), n)
    return [t for g in growers for t in (g.done if isinstance(g, MD.TR.Boosted) else [g.tree.arrays()])]


def test_distributed_trees_equal_local_ones(spark, monkeypatch):
    data = _data(spark)
    for make in (lambda p: MD._forest(p, 0, 2, 3, 5) + MD._forest(p, 3, 5, 2, 4), lambda p: [MD._boosted(p, 1, 0.1, 2, 5), MD._boosted(p, 3, 0.3, 3, 4)]):
        a, b = (_grown(spark, data, make, monkeypatch, far) for far in (False, True))
        assert len(a) == len(b) > 4
        for s, t in zip(a, b):
            assert (s["left"] == t["left"]).all() and (s["slot"] == t["slot"]).all() and (s["bin"] == t["bin"]).all()
            assert np.allclose(s["value"], t["value"]) and np.allclose(s["gain"], t["gain"])


def test_smaller_models_are_prefixes(spark, monkeypatch):
    data = _data(spark)
    for make in (lambda n, d: lambda p: MD._forest(p, 3, 3, n, d), ):
        large, few, flat = (_grown(spark, data, make(n, d), monkeypatch, False) for n, d in ((6, 6), (3, 6), (6, 2)))
        assert all((s["left"] == t["left"]).all() for s, t in zip(large, few)) and len(few) == 3
        rows, prep, n, pdf = data
        cuts = MD.TR.edges(prep, rows, 3)
        nums = np.array([[np.nan if v is None else v for v in r] for r in pdf["nums"]], float)
        codes = MD.TR.binned(prep, cuts[3], nums, np.array(pdf["cats"].tolist()), 3)
        got = MD.TR.forest_probabilities(large, codes, [3, 6], [2, 6])
        assert np.allclose(got[6, 2], MD.TR.forest_probabilities(flat, codes, [6], [2])[6, 2])
        assert np.allclose(got[3, 6], MD.TR.forest_probabilities(few, codes, [3], [6])[3, 6])
    long, short = (_grown(spark, data, lambda p, n=n: [MD._boosted(p, 3, 0.1, 2, n)], monkeypatch, False) for n in (6, 3))
    assert all((s["left"] == t["left"]).all() and np.allclose(s["value"], t["value"]) for s, t in zip(long, short))


def test_first_split_of_a_boosted_tree_is_the_best(spark, monkeypatch):
    data = _data(spark)
    rows, prep, n, pdf = data
    tree = _grown(spark, data, lambda p: [MD._boosted(p, 3, 0.1, 1, 1)], monkeypatch, False)[0]
    nums = np.array([[np.nan if v is None else v for v in r] for r in pdf["nums"]], float)
    codes = MD.TR.binned(prep, MD.TR.edges(prep, rows, 3)[3], nums, np.array(pdf["cats"].tolist()), 3)
    y = pdf["label"].to_numpy()
    r = y - y.mean()
    best = max((r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r))
               for s in range(codes.shape[1]) for b in range(31) for left in [codes[:, s] <= b] if 0 < left.sum() < len(r))
    left = codes[:, tree["slot"][0]] <= tree["bin"][0]
    assert np.isclose(tree["gain"][0], best)
    h = y.mean() * (1 - y.mean())
    assert np.allclose(tree["value"][1:3], [r[left].sum() / (h * left.sum()), r[~left].sum() / (h * (~left).sum())])


def test_both_ways_validate_alike_and_models_survive_a_round_trip(spark, monkeypatch, tmpdir_path):
    train = _frame(spark)
    grids = {"forest": {"numTrees": [2, 4], "maxDepth": [2, 4], "minInstancesPerNode": [2, 5], "folds": 3},
             "boosted": {"maxIter": [2, 5], "stepSize": [0.1, 0.3], "maxDepth": [1, 2], "folds": 3}}
    for family, grid in grids.items():
        model, table, best = MD.fit_family(train, ["x", "z"], ["cat"], family, grid, rare_min=20)
        assert table.count() == 8 and best in {r.params for r in table.collect()}
        with monkeypatch.context() as m:
            m.setattr(MD.TR, "BROADCAST_BYTES", 0)
            _, far, _ = MD.fit_family(train, ["x", "z"], ["cat"], family, grid, rare_min=20)
        assert np.allclose([r.cv_auc for r in table.collect()], [r.cv_auc for r in far.collect()])
        assert max(r.cv_auc for r in table.collect()) > 0.7
        sinks.save_model(model, f"{tmpdir_path}/{family}")
        again = sinks.load_model(f"{tmpdir_path}/{family}")
        a, b = ({r.camis: r.prob for r in MD.score(x, train).collect()} for x in (model, again))
        assert a == b and len(a) == 260


def test_empty_and_strange_rows_are_scored(spark):
    model, _, _ = MD.fit_family(_frame(spark), ["x", "z"], ["cat"], "logistic", SMALL)
    odd = spark.createDataFrame([(None, None, None), (1.0, 2.0, "never seen"), (float("nan"), 1e9, "a")], "x double, z double, cat string")
    assert all(0 < r.prob < 1 for r in MD.score(model, odd).collect())
    assert MD.score(model, odd.limit(0)).count() == 0


def test_grouped_auc(spark):
    from inspectra.operators.evaluation import grouped_auc, roc_auc
    rng = np.random.default_rng(2)
    rows = [(int(g), int(rng.random() < 0.4), float(np.round(rng.random(), 1))) for g in rng.integers(0, 3, 300)] + [(7, 1, 0.5), (7, 1, 0.1)]
    df = spark.createDataFrame(rows, "g int, label int, prob double")
    got = {r.g: r.auc for r in grouped_auc(df, ["g"]).collect()}
    for g in (0, 1, 2):
        assert np.isclose(got[g], roc_auc(df.where(f"g = {g}")).first().auc)
    assert got[7] == 0.0


def test_many_restarts_equal_plain_lloyd_runs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (3, 0), (0, 4))])
    df = spark.createDataFrame([(str(i), "2020-01-01", [float(v) for v in r]) for i, r in enumerate(x)], "camis string, inspection_date string, features array<double>").repartition(3)
    starts = MD._starts(df, 4, 3)
    assert [len(s) for s in starts] == [3] * 4
    found = MD.kmeans_many(df, [2, 3], restarts=4)
    for k in (2, 3):
        best = None
        for s in starts:
            c = s[:k].copy()
            for _ in range(MD.KMEANS_ITERATIONS):
                near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            cost = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
            best = cost if best is None else min(best, cost)
        assert np.isclose(found[k][1], best)
        got = MD.assign_clusters(df, found[k][0]).collect()
        near = ((np.array([r.features for r in got])[:, None] - found[k][0][None]) ** 2).sum(axis=2).argmin(axis=1)
        assert [r.cluster for r in got] == near.tolist()
    assert MD.kmeans_many(df.limit(0), [2]) == {}


def test_silhouette_in_blocks_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(MD.ST, "SILHOUETTE_BLOCK", 16)
    rng = np.random.default_rng(3)
    x, c = rng.normal(0, 1, (70, 3)), rng.integers(0, 3, 70)
    x[5], c[5] = x[6], c[6]
    c[9] = 7  # alone in its cluster
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(c, x)], "cluster int, a double, b double, c2 double")
    want = []
    for i in range(70):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        own = (c == c[i]).sum() - 1
        a, b = (d[c == c[i]].sum() / own if own else 0), min(d[c == k].mean() for k in set(c) - {c[i]})
        want.append((b - a) / max(a, b) if own else 0)
    got = MD.ST.silhouette_euclidean(df, ["a", "b", "c2"]).first()
    assert got.n == 70 and np.isclose(got.silhouette, np.mean(want))


def test_correlation_of_a_column_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = 1e9 + rng.normal(0, 1, 5000)
    y = 0.5 * (x - 1e9) + rng.normal(0, 1, 5000) - 1e8
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    assert abs(MD.ST.correlation_matrix(df, ["x", "y"]).first()["corr"] - np.corrcoef(x - 1e9, y + 1e8)[0, 1]) < 1e-9
    assert abs(MD.ST.target_correlation(df, ["x"], "y").first()["corr_with_target"] - np.corrcoef(x - 1e9, y + 1e8)[0, 1]) < 1e-9


def test_shared_design_gives_every_views_matrix():
    rng = np.random.default_rng(4)
    views = []
    for v in range(3):
        slots = [np.array([-1, 0, 1, -1 if v else 2]), np.array([-1, 2, 1])]
        views.append(MD.View(rng.normal(0, 1, 2), rng.normal(0, 1, 2), rng.uniform(1, 2, 2), [2, 1], slots, (1.0, 1.0), 50))
    prep = MD.Preparation(["x", "z"], ["a", "b"], [["p", "q", "r"], ["s", "t"]], None, views)
    nums = rng.normal(0, 1, (50, 2))
    nums[::7, 0] = np.nan
    cats = np.c_[rng.integers(-1, 4, 50), rng.integers(-1, 3, 50)]
    base = MD.LN._Base(prep, [0, 1, 2])
    order, dense, places, starts, codes = base.rows(nums, cats)
    whole = np.zeros((50, base.size))
    whole[:, places] = dense
    for own in np.repeat(codes, np.diff(np.append(starts, 50)), axis=0).T:
        whole[np.arange(50), own] = 1.0
    for v in range(3):
        assert np.allclose((whole @ base.maps[v])[:, 1:], prep.matrix(nums[order], cats[order], v, True))


def test_layout_adds_up_every_slot():
    rng = np.random.default_rng(6)
    codes = np.c_[rng.integers(0, 32, (80, 2)), rng.integers(0, 2, 80), np.eye(4)[rng.integers(0, 4, 80)], np.zeros(80)].astype(np.uint8)
    local, stats = rng.integers(-1, 3, 80), (np.ones(80), rng.normal(0, 1, 80))
    want = np.zeros((3, codes.shape[1], 32, 2))
    for i, n in enumerate(local):
        for s, c in enumerate(codes[i]):
            if n >= 0:
                want[n, s, c] += [x[i] for x in stats]
    layout = MD.TR.Layout(codes)
    assert len(layout.row) == (codes[:, 2:] > 0).sum()  # a category's slots cost the rows that set them
    assert np.allclose(layout.histogram(local, stats, 3), want)


def test_equal_centres_and_ties_go_to_the_first(spark):
    # two starts are copies of one row, and rows lie half-way between centres
    x = [[0.0, 0.0]] * 6 + [[2.0, 0.0]] * 6 + [[1.0, 0.0]] * 3
    one = np.concatenate([np.array(x), np.ones((15, 1))], axis=1)
    centres = np.array([[[0.0, 0.0], [0.0, 0.0], [2.0, 0.0]], [[2.0, 0.0], [0.0, 0.0], [5.0, 5.0]]])
    sums, cost = MD._nearest_sums(one[:, :2], one, (one[:, :2] ** 2).sum(axis=1), *MD._distance_terms(centres), 3)
    assert sums.reshape(2, 3, 3)[:, :, 2].tolist() == [[9, 0, 6], [9, 6, 0]]
    assert np.allclose(cost, 3)


def test_l1_step_ends_where_inputs_depend_on_each_other():
    # slots of a category, of groups of its values and numbers that all but follow from it: single coordinates crawl
    rng = np.random.default_rng(11)
    a = rng.integers(0, 20, 4000)
    x = np.c_[np.ones(4000), rng.normal(0, 1, 4000), rng.normal(0, 1, 20)[a] + 1e-3 * rng.normal(0, 1, 4000), rng.normal(0, 1, 20)[a], np.eye(5)[a % 5], np.eye(20)[a]]
    y = (rng.random(4000) < 1 / (1 + np.exp(-rng.normal(0, 0.3, 20)[a]))).astype(float)
    beta = np.zeros((2, x.shape[1]))
    g, h, lam = np.stack([x.T @ (0.5 - y)] * 2), np.stack([x.T @ x / 4] * 2), [0.1, 10.0]
    move = MD.LN._steps(beta, g, h, lam, np.array([True, True]))
    for i in range(2):
        end, b = g[i] + h[i] @ move[i], move[i]
        on = b[1:] != 0
        assert abs(end[0]) < 1e-7
        assert np.abs(end[1:][on] + np.sign(b[1:][on]) * lam[i]).max(initial=0) < 1e-7 and (np.abs(end[1:][~on]) <= lam[i] + 1e-7).all()


def _packed(seed=12, n=500):
    rng = np.random.default_rng(seed)
    views = [MD.View(rng.normal(0, 1, 2), np.zeros(2), np.ones(2), [2, 1], [np.array([-1, 0, 1, 3]), np.array([-1, 0, -1])], (0.8, 1.3), n)]
    prep = MD.Preparation(["x", "z"], ["a", "b"], [["p", "q", "r"], ["s", "t"]], None, views)
    nums = np.c_[rng.normal(0, 1, n), rng.integers(0, 3, n)]
    nums[::9, 0] = np.nan
    cats = np.c_[rng.integers(-1, 4, n), rng.integers(-1, 3, n)]
    cuts = [np.linspace(-2, 2, 31), np.array([0.5, 1.5])]
    label = (rng.random(n) < 1 / (1 + np.exp(-np.nan_to_num(nums[:, 0]) - (cats[:, 0] == 2)))).astype(np.int8)
    return prep, cuts, nums, cats, label, rng.integers(-2**62, 2**62, n)


def test_packed_rows_are_the_binned_ones():
    prep, cuts, nums, cats, _, _ = _packed()
    columns = MD.TR.Columns(prep)
    packed = columns.pack(prep, cuts, nums, cats, 0)
    assert packed.shape == (500, 4) and packed.dtype == np.uint8  # a byte a number and a category, not one a slot
    assert (columns.dense(packed) == MD.TR.binned(prep, cuts, nums, cats, 0)).all()


def test_packed_growth_splits_on_whole_histograms(monkeypatch):
    prep, cuts, nums, cats, label, uid = _packed()
    columns = MD.TR.Columns(prep)
    packed, dense = columns.pack(prep, cuts, nums, cats, 0), MD.TR.binned(prep, cuts, nums, cats, 0)
    for name in ("TREE_CHUNK", "JOINT_CHUNK"):
        monkeypatch.setattr(MD.TR, name, 64)
    monkeypatch.setattr(MD.TR, "JOINT_CELLS", 40)  # several groups of columns

    def plain(g):
        margin, node = np.full(len(label), getattr(g, "prior", 0.0)), np.zeros(len(label), np.int64)
        while g.open:
            before, made = g.tree, len(getattr(g, "done", ()))
            g.grow(g.histogram(dense, label.astype(float), uid, margin, node))
            if len(getattr(g, "done", ())) > made:
                margin, node = margin + g.rate * g.done[-1]["value"][MD.TR.down(g.done[-1], dense, 64)], np.zeros(len(label), np.int64)
            else:
                node = MD.TR.down(before.arrays(), dense, 1, node)
        return g

    make = lambda: [MD.TR.Forest(0, 3, k, 6, prep.width, prep.views[0].weights, 42) for k in range(4)]
    pairs = [(a.tree.arrays(), MD.TR._complete_forest(b, columns, packed, label, uid).tree.arrays()) for a, b in zip(map(plain, make()), make())]
    boosted = lambda: MD.TR.Boosted(0, 0.3, 4, 6, prep.width, -0.4)
    done = MD.TR._complete_boosted(boosted(), columns, np.ascontiguousarray(packed.T), label).done
    pairs += list(zip(plain(boosted()).done, done))
    assert len(pairs) == 10 and max(len(a["left"]) for a, _ in pairs) > 20
    for a, b in pairs:
        assert (a["left"] == b["left"]).all() and (a["slot"] == b["slot"]).all() and (a["bin"] == b["bin"]).all()
        assert np.allclose(a["value"], b["value"]) and np.allclose(a["gain"], b["gain"])


def test_searches_with_the_same_folds_share_their_rows(spark):
    grid = {"numTrees": [2], "maxDepth": [2], "minInstancesPerNode": [2], "folds": 3}
    prepared = MD.training_rows(_frame(spark), ["camis", "inspection_date"], ["x", "z"], ["cat"], 3, 20)
    own, shared = (MD.fit_family(_frame(spark), ["x", "z"], ["cat"], "forest", grid, rare_min=20, prepared=p)[1].first() for p in (None, prepared))
    assert np.isclose(own["cv_auc"], shared["cv_auc"])
