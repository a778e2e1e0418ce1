"""Model and attribution tests: AUC floor, save/load, SHAP exactness and additivity."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanscope.operators import explain as X
from loanscope.operators import metrics as E
from loanscope.operators import models as M
from loanscope.operators import trees as T
from loanscope.plans import catalog as C
from loanscope.sources import sinks


def _rand_tree(rng, m, depth):
    f, t, l, r, c, v = [], [], [], [], [], []

    def build(d, cover):
        i = len(f)
        f.append(-1); t.append(0.0); l.append(-1); r.append(-1); c.append(cover); v.append(rng.random())
        if d < depth and rng.random() < 0.85:
            f[i] = int(rng.integers(0, m)); t[i] = float(rng.random())
            cl = cover * rng.uniform(0.2, 0.8)
            l[i] = build(d + 1, cl); r[i] = build(d + 1, cover - cl)
        return i

    build(0, 100.0)
    return {k: np.array(x) for k, x in zip(["feature", "threshold", "left", "right", "cover", "value"], [f, t, l, r, c, v])}


def _cond(t, x, S, j=0):
    if t["feature"][j] < 0:
        return t["value"][j]
    f, l, r = t["feature"][j], t["left"][j], t["right"][j]
    if f in S:
        return _cond(t, x, S, l if x[f] <= t["threshold"][j] else r)
    return (t["cover"][l] * _cond(t, x, S, l) + t["cover"][r] * _cond(t, x, S, r)) / t["cover"][j]


def _brute(t, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for size in range(m):
            for S in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += w * (_cond(t, x, set(S) | {i}) - _cond(t, x, set(S)))
    return phi


def test_tree_shap_equals_brute_force_shapley():
    rng = np.random.default_rng(11)
    for _ in range(10):
        t = _rand_tree(rng, 4, 5)
        X_ = rng.random((6, 4))
        phi = np.zeros((6, 5))
        X._tree_shap_batch(t, X_, phi)
        for r in range(6):
            assert np.allclose(phi[r, :4], _brute(t, X_[r], 4), atol=1e-12)


@pytest.mark.parametrize("depth", [0, 1, 6, 9])
def test_tables_equal_the_recursion_over_leaves(depth):
    """Looked-up credits equal those of the recursion, in fewer lookups than leaves and features; leaves of more sides
    than a table has are credited without one."""
    rng = np.random.default_rng(depth)
    trees, x, z = [_rand_tree(rng, 31, depth) for _ in range(4)], rng.random((40, 31)), rng.random((30, 31))
    x[3, :9] = np.nan
    want = np.zeros((40, 32))
    for t in trees:
        X._tree_shap_batch(t, x, want)
    forest, against = X.Forest(trees), X.Background(trees, z)
    assert np.allclose(forest.values(x), want[:, :-1] / 4, atol=1e-12)
    got = against.values(x)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(X, "TABLE_BITS", 0)
        assert np.allclose(got, X.Background(trees, z).values(x), atol=1e-12)
    if depth == 6:
        for i, t in enumerate(trees):
            assert not forest.table(i).deep
            looked_up, leaves = sum(len(c[3]) for c in forest.table(i).chunks), int((t["feature"] < 0).sum())
            assert looked_up < 2.5 * leaves


@pytest.fixture(scope="module")
def fitted(spark, book):
    return C.training_frame(spark, book), C.logistic(spark, book), C.forest(spark, book)


def test_models_beat_auc_floor(fitted):
    (enc, feats), lr, rf = fitted
    test = enc.filter("IsTest = 1")
    for model in (lr, rf):
        auc = E.roc_auc(M.score(model, test)).first()[0]
        assert auc > 0.7


def test_importances_sum_to_one(spark, fitted):
    _, _, rf = fitted
    total = M.importances(rf, spark).agg(F.sum("Importance")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-9)


def test_save_load_same_scores(spark, fitted, tmp_path):
    (enc, _), _, rf = fitted
    path = str(tmp_path / "rf")
    sinks.save_model(rf.model, path)
    loaded = M.Fitted(sinks.load_model(path), rf.features, rf.name)
    test = enc.filter("IsTest = 1")
    a = M.score(rf, test).select("LoanID", "PredProb")
    b = M.score(loaded, test).select("LoanID", "PredProb")
    assert a.exceptAll(b).count() == 0


def test_forest_shap_additive(spark, fitted):
    (enc, _), _, rf = fitted
    sample = enc.orderBy("LoanID").limit(300)
    phi = X.tree_shap(rf, sample)
    s = phi.groupBy("LoanID").agg((F.sum("Phi") + F.first("BaseValue")).alias("recon"))
    p = M.score(rf, sample, None).select("LoanID", "PredProb")
    worst = s.join(p, "LoanID").agg(F.max(F.abs(F.col("recon") - F.col("PredProb")))).first()[0]
    assert worst < 1e-9


def test_linear_shap_additive(spark, fitted):
    (enc, _), lr, _ = fitted
    sample = enc.orderBy("LoanID").limit(300)
    phi = X.linear_shap(lr, sample)
    s = phi.groupBy("LoanID").agg((F.sum("Phi") + F.first("BaseValue")).alias("margin"))
    raw = lr.model.transform(M.as_double_features(sample, lr.features)).select(
        "LoanID", vector_to_array("rawPrediction").getItem(1).alias("m"))
    worst = s.join(raw, "LoanID").agg(F.max(F.abs(F.col("margin") - F.col("m")))).first()[0]
    assert worst < 1e-9


def test_knn_exact_against_brute_force(spark):
    from loanscope.operators import smote as SM
    rng = np.random.default_rng(5)
    n, m = 300, 4
    X_ = np.round(rng.normal(size=(n, m)) * [100, 1, 1, 10], 1)
    X_[:40] = X_[0]  # a block of exact duplicates: ties broken by key
    rows = [(int(i), *map(float, x)) for i, x in enumerate(X_)]
    df = spark.createDataFrame(rows, "LoanID long, a double, b double, c double, d double")
    got = SM.knn(df, "LoanID", ["a", "b", "c", "d"], 5).toPandas()
    D = ((X_[:, None, :] - X_[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(n):
        want = sorted(range(n), key=lambda j: (D[i, j], j))[:5]
        have = list(got[got.LoanID == i].sort_values("Rank").Neighbor)
        assert have == want


def test_smote_counts_and_interpolation(spark, book):
    from loanscope.operators import smote as SM
    train, feats = C.imputed_train(spark, book)
    out = SM.smote(train, feats, ratio=0.3, k=5)
    counts = {r.DefaultFlag: r["count"] for r in out.groupBy("DefaultFlag").count().collect()}
    assert counts[1] == int(0.3 * counts[0])
    # every synthetic point lies inside the bounding box of the minority class
    mino = train.filter("DefaultFlag = 1")
    lo = mino.agg(*[F.min(f) for f in feats[:5]]).first()
    hi = mino.agg(*[F.max(f) for f in feats[:5]]).first()
    syn = out.filter("Synthetic = 1")
    for i, f in enumerate(feats[:5]):
        a, b = syn.agg(F.min(f), F.max(f)).first()
        assert a >= lo[i] - 1e-9 and b <= hi[i] + 1e-9
    with pytest.raises(ValueError):
        SM.smote(train, feats, ratio=0.01)


def test_knn_hot_copy_group_and_small_copy_group(spark):
    from loanscope.operators import smote as SM
    rng = np.random.default_rng(9)
    n = 240
    X_ = np.round(rng.normal(size=(n, 3)) * [50, 2, 1], 2)
    X_[:80] = X_[200]          # a third of all points are copies of one vector
    X_[100:103] = X_[150]      # a small group: 4 copies (< k + 1)
    keys = rng.permutation(10_000)[:n]
    df = spark.createDataFrame([(int(keys[i]), *map(float, x)) for i, x in enumerate(X_)],
                               "LoanID long, a double, b double, c double")
    got = SM.knn(df, "LoanID", ["a", "b", "c"], 5).toPandas()
    D = ((X_[:, None, :] - X_[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(n):
        want = [int(keys[j]) for j in sorted(range(n), key=lambda j: (D[i, j], keys[j]))[:5]]
        have = list(got[got.LoanID == keys[i]].sort_values("Rank").Neighbor)
        assert have == want, (i, have, want)


def _tiny_book(spark, n=400):
    import random

    rng = random.Random(5)
    rows = [(i, int(rng.random() < 0.3), rng.random(), rng.random(), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "LoanID long, DefaultFlag int, a double, b double, d int")


@pytest.mark.parametrize("parts", [2, 4, 9])
def test_forest_does_not_follow_input_partitions(spark, parts):
    df = _tiny_book(spark)
    args = dict(weight=None, num_trees=10, max_depth=4)
    want = {r.LoanID: r.PredProb for r in M.score(M.train_forest(df.repartition(1), ["a", "b"], **args), df, None).collect()}
    got = {r.LoanID: r.PredProb for r in M.score(M.train_forest(df.repartition(parts), ["a", "b"], **args), df, None).collect()}
    assert got == want


@pytest.mark.parametrize("k", [2, 5])
def test_random_search_takes_any_number_of_folds(spark, k):
    from loanscope.operators import sampling as S

    df = S.add_folds(_tiny_book(spark), k=k)
    space = {"numTrees": [3], "maxDepth": [2, 3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}
    _, results = M.random_search(df, ["a", "b"], folds=k, n_iter=2, weight=None, space=space)
    assert len(results) == 2 and all(0 <= auc <= 1 for _, auc in results)


def test_registered_search_draws_twenty_points(spark, monkeypatch):
    """Every draw of the reference (20 x 3 folds) is a row, best first; the fits themselves are left out."""
    asked = {}

    def search(train, features, folds, n_iter):
        asked.update(folds=folds, n_iter=n_iter)
        return None, [({"point": i}, i / n_iter) for i in range(n_iter)]

    monkeypatch.setattr(M, "random_search", search)
    monkeypatch.setattr(C, "_CACHE", {})
    rows = C.REGISTRY["m6_random_search"](spark, "/root/testdata/sf0.001").collect()
    assert asked == {"folds": 3, "n_iter": 20}
    assert len(rows) == 20 and [r.AvgAUC for r in rows] == sorted((r.AvgAUC for r in rows), reverse=True)


# ---- node tables: forests cut back, importances, background attributions ----------------------------

def _deep_forest(spark, **more):
    df = _tiny_book(spark, 600)
    return df, M.train_forest(df, ["a", "b", "d"], weight=None, num_trees=6, max_depth=12, seed=3, **more)


def _brute_tree(t, x, j=0, depth=0, min_rows=2, max_depth=99):
    """Value of the first node on the row's way that would not have been split."""
    if t["feature"][j] < 0 or t["rows"][j] < min_rows or depth >= max_depth:
        return t["value"][j]
    child = t["left"][j] if x[t["feature"][j]] <= t["threshold"][j] else t["right"][j]
    return _brute_tree(t, x, int(child), depth + 1, min_rows, max_depth)


@pytest.mark.parametrize("rows,depth,trees", [(2, None, None), (5, None, None), (40, None, 4), (2, 3, 6), (30, 2, 1), (10_000, None, 2), (2, 0, 3)])
def test_forest_cut_back_equals_stopping_there(spark, rows, depth, trees):
    df, fitted = _deep_forest(spark)
    path = T.save_forest(spark, fitted.model.stages[-1])
    full = T.tree_arrays(spark, path)
    cut = T.cut_back(spark, path, rows, depth, trees)
    assert cut.getNumTrees == (trees or 6) and cut.numFeatures == 3
    nodes = T.node_table(spark, T.save_forest(spark, cut))
    assert nodes.where((F.col("left") >= 0) & (F.col("rows") < rows)).count() == 0
    sample = df.limit(60)
    x = np.array([[r.a, r.b, r.d] for r in sample.collect()], dtype=float)
    want = [np.mean([_brute_tree(t, row, 0, 0, rows, 99 if depth is None else depth) for t in full[:trees or 6]]) for row in x]
    got = [r.PredProb for r in M.score(M.Fitted(T.with_forest(fitted.model, cut), fitted.features, "cut"), sample, None).collect()]
    assert np.allclose(got, want, atol=1e-12)
    settings = [{"numTrees": trees or 6, "maxDepth": 99 if depth is None else depth, "minSamplesSplit": rows}]
    assert np.allclose(T.scores_of_settings(full, x, settings)[:, 0], want, atol=1e-12)


def test_training_with_a_least_split_size(spark):
    _, fitted = _deep_forest(spark, min_split=50)
    nodes = T.node_table(spark, T.save_forest(spark, fitted.model.stages[-1]))
    assert nodes.where("left >= 0 AND rows < 50").count() == 0 and nodes.where("left >= 0").count() > 6


def test_importances_equal_the_models_own(spark):
    _, fitted = _deep_forest(spark)
    own = fitted.model.stages[-1].featureImportances.toArray()
    got = {r.Feature: r.Importance for r in M.importances(fitted, spark).collect()}
    assert np.allclose([got[f] for f in fitted.features], own, atol=1e-12)
    stump = T.cut_back(spark, T.save_forest(spark, fitted.model.stages[-1]), max_depth=0)   # no split anywhere
    none = T.importances_of(T.node_table(spark, T.save_forest(spark, stump)), ["a", "b", "d"]).collect()
    assert [r.Importance for r in none] == [0.0, 0.0, 0.0]


def test_search_grid_has_all_five_dimensions():
    assert math.prod(len(v) for v in M.SEARCH_SPACE.values()) == 324
    points = M.draw(M.SEARCH_SPACE, 20, 42)
    assert len({str(p) for p in points}) == 20
    served = sorted(i for _, at in M.shared_fits(points) for i in at)
    assert served == list(range(20))
    for fit, at in M.shared_fits(points):
        assert all(points[i]["numTrees"] <= fit["numTrees"] and points[i]["maxDepth"] <= fit["maxDepth"] for i in at)


def test_search_refits_the_best_point(spark):
    from loanscope.operators import sampling as S

    df = S.add_folds(_tiny_book(spark), k=2)
    space = {"numTrees": [3, 5], "maxDepth": [2, 4], "minSamplesSplit": [2, 60], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}
    best, results = M.random_search(df, ["a", "b"], folds=2, n_iter=8, weight=None, space=space)
    top = max(results, key=lambda r: r[1])[0]
    assert len(results) == 8 and best.model.stages[-1].getNumTrees == top["numTrees"]


def _game(trees, x, z, s):
    """Mean over the background of the forest with the features of ``s`` from x, the others from z."""
    mixed = z.copy()
    mixed[:, list(s)] = x[list(s)]
    return np.mean([[_brute_tree(t, row) for row in mixed] for t in trees])


def test_background_shap_equals_brute_force_shapley():
    rng = np.random.default_rng(4)
    m = 4
    for _ in range(4):
        trees = [_rand_tree(rng, m, 6) | {"rows": np.full(200, 99)} for _ in range(3)]
        z, x = rng.random((9, m)), rng.random((5, m))
        z[3] = z[4]
        against = X.Background(trees, z)
        got = against.values(x)
        assert against.base == pytest.approx(_game(trees, x[0], z, ()), abs=1e-12)
        for r in range(len(x)):
            for i in range(m):
                want = sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                           * (_game(trees, x[r], z, (*s, i)) - _game(trees, x[r], z, s))
                           for k in range(m) for s in itertools.combinations([j for j in range(m) if j != i], k))
                assert got[r, i] == pytest.approx(want, abs=1e-12)


def test_background_shap_is_additive_and_bounded(spark, monkeypatch):
    df, fitted = _deep_forest(spark)
    z = df.limit(80)
    rows = X.background_shap(fitted, df.repartition(3), z)
    base = M.score(fitted, z, None).agg(F.avg("PredProb")).first()[0]
    both = rows.join(M.score(fitted, df, None, keep=["LoanID"]), "LoanID").collect()
    assert len(both) == 600 and max(abs(sum(r.Phis) + r.BaseValue - r.PredProb) for r in both) < 1e-9
    assert all(abs(r.BaseValue - base) < 1e-9 for r in both)
    monkeypatch.setattr(X, "MAX_BACKGROUND", 79)
    with pytest.raises(ValueError):
        X.background_shap(fitted, df, z)


def test_gradient_is_flat_at_the_fit_and_not_beside_it(spark, fitted, book):
    _, lr, _ = fitted
    train = C._train_weighted(spark, book)
    worst = M.logistic_gradient(lr, train).agg(F.max(F.abs("Gradient"))).first()[0]
    assert worst < 1e-4
    wrong = M.Fitted(lr.model, lr.features, lr.name, {f: (m, s * 1.2) for f, (m, s) in lr.scale.items()})
    assert M.logistic_gradient(wrong, train).agg(F.max(F.abs("Gradient"))).first()[0] > 1e-3


# ---- what a fit carries -----------------------------------------------------------------------------

def test_fits_carry_only_the_columns_that_they_read(spark):
    feats = ["LoanAmount", "b"]
    df = _tiny_book(spark).withColumnRenamed("a", "LoanAmount").withColumn("Comment", F.repeat(F.lit("x"), 500)).withColumn("weight", F.lit(1.0))
    assert M.training_rows(df, feats, "weight", None).columns == ["LoanID", *feats, "label", "weight"]
    asked = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(M, "laid_out", lambda d, *a, _real=M.laid_out, **k: asked.append(d.columns) or _real(d, *a, **k))
        M.train_forest(df, feats, num_trees=2, max_depth=2)
        M.train_logistic(df, feats, max_iter=2)
    assert asked == [["LoanID", *feats, "label", "weight"]] * 2


def test_shallow_forests_keep_no_node_ids_and_are_the_same(spark):
    assert not M._forest(spark, None, 1, numTrees=200, maxDepth=6).getCacheNodeIds()
    assert M._forest(spark, None, 1, numTrees=200, maxDepth=30).getCacheNodeIds()
    df, got = _tiny_book(spark), []
    for shallow in (0, 30):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(M, "SHALLOW", shallow)
            fitted = M.train_forest(df, ["a", "b"], weight=None, num_trees=8, max_depth=6)
        got.append({r.LoanID: r.PredProb for r in M.score(fitted, df, None).collect()})
    assert got[0] == got[1]


def test_feature_table_is_written_once_for_all_fits(spark, book, monkeypatch):
    """One Parquet table stands behind the fits; the logistic fit on all features reads the same."""
    monkeypatch.setattr(C, "_CACHE", {})
    built = []
    monkeypatch.setattr(C, "written", lambda df, name, _real=C.written: built.append(name) or _real(df, name))
    enc, feats = C.training_frame(spark, book)
    monkeypatch.setattr(M, "train_logistic", lambda train, features, **k: M.Fitted(None, features, "all"))
    monkeypatch.setattr(M, "score", lambda fitted, df, *a, **k: df.select(*fitted.features))
    every = C.REGISTRY_RAW["m4_all_features_scores"](spark, book)
    assert built == ["features"] and len(feats) == 31 and len(every.columns) == 35
    assert all("/features-" in f for f in enc.inputFiles())


def test_training_frame_derives_the_snapshots_once_and_splits_by_loans(spark, book, monkeypatch):
    """Labels and feature table share one pass over the repayments; customers that come twice
    repeat rows of the table and leave the split of the loans as it is."""
    import dataclasses

    from loanscope.operators import features as FT

    want = {r.LoanID: r.IsTest for r in C.label_split(book).collect()}
    monkeypatch.setattr(C, "_CACHE", {})
    passes = []
    monkeypatch.setattr(FT, "latest_snapshot", lambda s, _real=FT.latest_snapshot: passes.append(1) or _real(s))
    twice = book.customers.unionAll(book.customers.where("CustomerID % 3 = 0"))
    enc, _ = C.training_frame(spark, dataclasses.replace(book, customers=twice))
    assert len(passes) == 1
    rows = enc.select("LoanID", "IsTest").collect()
    assert len(rows) > len(want) and {(r.LoanID, r.IsTest) for r in rows} == set(want.items())


def test_dependence_bins_read_one_feature(spark, monkeypatch):
    """The bins come from the top feature's values alone, not from the long form of all features."""
    rows = spark.createDataFrame([(i, [float(i), float(i % 7)], [i / 10, -i / 5], 0.5) for i in range(200)],
                                 "LoanID long, Values array<double>, Phis array<double>, BaseValue double")
    want = X.dependence(X.long_form(rows, ["a", "b"]), "b", C.DEPENDENCE_BINS).collect()
    monkeypatch.setattr(C, "forest", lambda *a: M.Fitted(None, ["a", "b"], "forest"))
    monkeypatch.setattr(M, "importances", lambda *a: spark.createDataFrame([("a", 0.2), ("b", 0.8)], "Feature string, Importance double"))
    monkeypatch.setattr(C, "_tree_phi", lambda *a: rows)
    monkeypatch.setattr(X, "long_form", lambda *a: pytest.fail("exploded"))
    got = C.REGISTRY_RAW["x4_dependence_bins"](spark, None).collect()
    by_bin = lambda rs: {r.Bin: (pytest.approx(r.Value), pytest.approx(r.Phi), r.N) for r in rs}
    assert len(got) == 7 and {r.Bin: (r.Value, r.Phi, r.N) for r in got} == by_bin(want)


def test_attributions_broadcast_plain_arrays(spark, monkeypatch):
    """Executors have numpy, not this package: no class of it may travel in a broadcast."""
    import pickletools

    df, fitted = _deep_forest(spark)
    sent = []
    monkeypatch.setattr(X, "explained", lambda data, feats, key, value: sent.append(value.value) or data)
    X.tree_shap_rows(fitted, df)
    X.background_shap(fitted, df, df.limit(20))
    import pickle
    for value in sent:
        names = {str(arg) for _, arg, _ in pickletools.genops(pickle.dumps(value)) if isinstance(arg, str)}
        assert not any("loanscope" in n for n in names)
