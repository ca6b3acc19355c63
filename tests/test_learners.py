"""Learners on small sets: score floors, invariants and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bayes, clustering, decomposition, ensemble, kernel, linear, manifold, metric_learning, metrics, neighbors, neural, preprocessing, selection, tree
from quern.operators.base import Estimator
from quern.streaming.partial import learner


def frame(spark, x, **columns):
    kinds = {k: "array<double>" if np.ndim(v) > 1 else "int" if np.asarray(v).dtype.kind == "i" else "double" for k, v in columns.items()}
    rows = [(i, r.tolist(), *(v[i].tolist() for v in columns.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long", "features array<double>", *(f"{k} {t}" for k, t in kinds.items())])).repartition(2).persist()


@pytest.fixture(scope="module")
def two(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.normal((-10, 0), 0.5, (60, 2)), r.normal((10, 0), 0.5, (60, 2))])
    return frame(spark, x, label=np.repeat([0, 1], 60), target=x @ [1.0, 2.0])


@pytest.fixture(scope="module")
def three(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(c, 0.5, (40, 2)) for c in ((0, 5), (-5, -5), (5, -5))])
    return frame(spark, x, label=np.repeat([0, 1, 2], 40), target=x @ np.array([[1.0, 2.0], [2.0, 1.0]]))


@pytest.fixture(scope="module")
def xor(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(c, 0.6, (40, 2)) for c in ((-5, 5), (5, -5), (5, 5), (-5, -5))])
    return frame(spark, x, label=np.repeat([0, 1], 80))


def kernels(df):
    return preprocessing.KernelCalculator(gamma=0.1).fit_transform(df)


@pytest.mark.parametrize("make", [bayes.GaussianNB, linear.LogisticRegression, lambda: linear.SVC(0.01, probability=True), lambda: linear.SGDClassifier(max_iter=20), lambda: neighbors.KNeighborsClassifier(5), lambda: tree.DecisionTreeClassifier(), lambda: tree.ExtraTreeClassifier(), lambda: tree.VRTreeClassifier(), lambda: neural.RVFLClassifier(16), lambda: neural.RBFClassifier(6, gamma=0.1), lambda: neural.MLPClassifier((16,), 0.0, 0.01, max_iter=60)])
def test_classifiers(three, make):
    model = make().fit(three)
    assert model.score(three) >= 0.98
    if hasattr(model, "predict_proba"):
        for r in model.predict_proba(three).limit(5).collect():
            assert abs(sum(r.probability) - 1) < 1e-6


@pytest.mark.parametrize("make", [lambda: tree.DecisionTreeClassifier("entropy"), lambda: ensemble.RandomForestClassifier(5, max_depth=4), lambda: ensemble.ExtraTreesClassifier(5), lambda: ensemble.VRTreesClassifier(5), lambda: ensemble.AdaBoostClassifier(3, max_depth=3), lambda: ensemble.GradientBoostingClassifier(5, 0.5, max_depth=3)])
def test_forests_on_xor(xor, make):
    model = make().fit(xor)
    assert model.score(xor) >= 0.95 and len(model.apply(xor).first().leaves) >= 1


@pytest.mark.parametrize("make", [linear.LinearRegression, lambda: linear.LinearRegression(solver="lbfgs", tol=1e-9), lambda: linear.Ridge(0.01), lambda: linear.Lasso(0.01), lambda: linear.ElasticNet(0.01), lambda: linear.NNLS(1e-6), lambda: linear.SVR(1e-4), lambda: linear.SGDRegressor(max_iter=60, learning_rate=0.001, reg_param=1e-4), lambda: neighbors.KNeighborsRegressor(3), lambda: tree.DecisionTreeRegressor(), lambda: ensemble.RandomForestRegressor(5), lambda: ensemble.ExtraTreesRegressor(5), lambda: ensemble.VRTreesRegressor(5), lambda: ensemble.GradientBoostingRegressor(10, 0.5, max_depth=3), lambda: ensemble.AdaBoostRegressor(3), lambda: neural.RVFLRegressor(16), lambda: neural.RBFRegressor(20, gamma=0.01), lambda: neural.MLPRegressor((32,), 0.0, 0.01, max_iter=80)])
def test_regressors(two, make):
    assert make().fit(two).score(two) >= 0.95


@pytest.mark.parametrize("make", [lambda: linear.Ridge(0.01), lambda: linear.Lasso(0.01), lambda: tree.DecisionTreeRegressor(), lambda: neighbors.KNeighborsRegressor(3), lambda: neural.RVFLRegressor(16)])
def test_several_outputs(three, make):
    model = make().fit(three)
    assert model.score(three) >= 0.95 and len(model.predict(three).first().prediction) == 2


@pytest.mark.parametrize("make", [lambda: clustering.KMeans(3, random_seed=2), lambda: clustering.MiniBatchKMeans(3, max_iter=12, random_seed=2), lambda: clustering.KMedoids(3, random_seed=2), lambda: clustering.GaussianMixture(3, max_iter=10, random_seed=2), lambda: clustering.GaussianMixture(3, covariance_type="full", max_iter=10, random_seed=2), lambda: clustering.DBSCAN(1.0, 5), lambda: clustering.SNN(10, 3, 5), lambda: clustering.HDBSCAN(8), lambda: clustering.SingleLinkage(3), lambda: clustering.MeanShift(4.0), lambda: clustering.PowerIteration(3, gamma=1.0, random_seed=2), lambda: clustering.SpectralClustering(3, gamma=1.0, random_seed=2)])
def test_clusterings(three, make):
    assert make().score(three) >= 0.9


def test_kernel_machines(xor, two):
    k = kernels(xor)
    assert kernel.KernelSVC(0.1, 400).fit(k).score(k) >= 0.95 and kernel.KernelRidgeClassifier(0.1).fit(k).score(k) >= 0.95
    flat = kernels(two)
    assert kernel.KernelRidge(0.01).fit(flat).score(flat) >= 0.95
    assert kernel.KernelPCA(2).fit_transform(k).count() == kernel.KernelFDA(1).fit_transform(k).count() == 160
    near = kernel.Nystroem(gamma=0.1, n_components=80).fit_transform(xor)
    x = np.array([r.features for r in near.orderBy("id").collect()])
    want = np.array([r.features for r in k.orderBy("id").collect()])
    assert ((x @ x.T - want) ** 2).mean() < 0.01
    waves = np.array([r.features for r in kernel.RBF(0.1, 1024).fit_transform(xor).orderBy("id").collect()])
    assert ((waves @ waves.T - want) ** 2).mean() < 0.01


def test_least_squares_leave_no_correlation(two):
    model = linear.LinearRegression().fit(two.withColumn("target", F.col("target") + F.sin(F.col("id") * 1.0)))
    rows = model.predict(two.withColumn("target", F.col("target") + F.sin(F.col("id") * 1.0))).collect()
    gap, x = np.array([r.target - r.prediction for r in rows]), np.array([r.features for r in rows])
    assert np.abs(x.T @ gap).max() < 1e-6 and abs(gap.sum()) < 1e-6


def test_decompositions(spark):
    r = np.random.default_rng(3)
    x = r.random((80, 2)) @ r.random((2, 5)) + 0.001 * r.random((80, 5))
    df = frame(spark, x)
    pca = decomposition.PCA(2).fit(df)
    assert np.allclose(pca.components @ pca.components.T, np.eye(2))
    other = decomposition.PCA(2, solver="fpt", max_iter=1000, tol=1e-9).fit(df)
    assert np.allclose(np.abs(pca.components @ other.components.T), np.eye(2), atol=1e-3)
    for model in (pca, decomposition.NMF(2), decomposition.FastICA(2)):
        back = model.fit(df).inverse_transform(model.transform(df))
        assert ((np.array([v.features for v in back.orderBy("id").collect()]) - x) ** 2).mean() < 1e-3
    factors = decomposition.FactorAnalysis(2).fit(df)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(factors.loglike, factors.loglike[1:], strict=False))
    assert len(decomposition.SparsePCA(2).fit_transform(df).first().features) == 2 and len(factors.transform(df).first().features) == 2


@pytest.mark.parametrize("make", [metric_learning.FisherDiscriminantAnalysis, lambda: metric_learning.LocalFisherDiscriminantAnalysis(1), lambda: metric_learning.NeighbourhoodComponentAnalysis(1, max_iter=20)])
def test_metric_learning_keeps_classes_apart(two, make):
    z = make().fit_transform(two)
    assert neighbors.KNeighborsClassifier(3).fit(z).score(z) >= 0.95
    assert len(metric_learning.MLKR(1, max_iter=5).fit_transform(two).first().features) == 1


@pytest.mark.parametrize("make", [manifold.ClassicalMDS, lambda: manifold.MDS(init="pca", max_iter=30), lambda: manifold.TSNE(perplexity=10, max_iter=80, init="pca"), lambda: manifold.LaplacianEigenmaps(n_neighbors=50), lambda: manifold.LocallyLinearEmbedding(n_neighbors=50), lambda: manifold.LocalTangentSpaceAlignment(n_neighbors=50), lambda: manifold.HessianEigenmaps(50)])
def test_manifolds(three, make):
    model = make()
    z = model.fit_transform(three)
    assert np.isfinite([r.features for r in z.collect()]).all() and len(z.first().features) == 2
    if hasattr(model, "transform"):
        assert model.transform(three.limit(5)).count() == 5


def test_composition(three, tmp_path):
    pipe = selection.Pipeline({"scale": preprocessing.StandardScaler(), "none": None, "nb": bayes.GaussianNB()}).fit(three)
    assert pipe.score(three) >= 0.98
    grid = selection.GridSearchCV(selection.Pipeline({"scale": preprocessing.MinMaxScaler(), "tree": tree.DecisionTreeClassifier()}), {"tree__max_depth": [1, 3]}, selection.StratifiedKFold(2, True)).fit(three)
    assert grid.best_params == {"tree__max_depth": 3} and grid.score(three) >= 0.95
    report = selection.CrossValidation(bayes.GaussianNB(), selection.StratifiedKFold(3, True), metrics.accuracy, True).perform(three)
    assert len(report["test_score"]) == len(report["train_score"]) == 3 and min(report["test_score"]) > 0.95
    both = selection.FeatureUnion({"a": preprocessing.L2Normalizer(), "b": preprocessing.MinMaxScaler()}).fit_transform(three)
    assert len(both.first().features) == 4
    models = {"nb": bayes.GaussianNB(), "rvfl": neural.RVFLClassifier(8)}
    for vote in ("hard", "soft"):
        assert ensemble.VotingClassifier({"nb": bayes.GaussianNB(), "tree": tree.DecisionTreeClassifier(max_depth=3)}, voting=vote).fit(three).score(three) >= 0.95
    stack = ensemble.StackingClassifier(models, neural.RVFLClassifier(8), n_splits=2)
    assert stack.fit(three).score(three) >= 0.95
    pipe.save(str(tmp_path / "m"))
    assert Estimator.load(str(tmp_path / "m")).score(three) == pipe.score(three)


def test_regressor_ensembles(two):
    parts = {"ridge": linear.Ridge(0.01), "tree": tree.DecisionTreeRegressor(max_depth=4)}
    assert ensemble.VotingRegressor(parts).fit(two).score(two) >= 0.95 and ensemble.StackingRegressor(parts, n_splits=2).fit(two).score(two) >= 0.95


def test_platt_and_partial_fit(two):
    model = linear.SVC(0.01, probability=True).fit(two)
    assert all((r.probability[1] > 0.5) == (r.label == 1) for r in model.predict_proba(two).collect())
    sgd = linear.SGDClassifier(learning_rate=0.01)
    each = learner(sgd)
    for k in range(3):
        each(two, k)
    each(two, 1)  # handed over again: skipped
    assert sgd.score(two) == 1.0
    far = linear.SGDClassifier(distributed=True, max_iter=2).fit(two)
    assert far.score(two) == 1.0


def test_gradient_tree(two):
    df = two.withColumn("g", -F.col("target")).withColumn("h", F.lit(1.0))
    model = tree.GradientTreeRegressor(max_depth=6).fit(df)
    assert metrics.r2_score(model.predict(df)).first()[0] > 0.9 and model.feature_importances.sum() > 0


def test_native_bayes_variants(spark):
    x = np.array([[3, 0, 1, 0], [2, 1, 0, 0], [4, 0, 1, 1], [0, 3, 0, 2], [1, 2, 0, 3], [0, 4, 1, 2]], float)
    df = frame(spark, x, label=np.array([1, 1, 1, -1, -1, -1]))
    for make in (bayes.MultinomialNB, lambda: bayes.BernoulliNB(1.0, 1.0), lambda: bayes.BernoulliNB(1.0, 1.0, compat=True), bayes.ComplementNB, bayes.NegationNB):
        assert make().fit(df).score(df) >= 5 / 6


# ---- trees: nodes grown alone, by levels and by sorting agree


def _shape(nodes, at=0):
    n = nodes[at]
    return (round(n.n_samples, 6), tuple(np.round(n.value, 9))) if n.left < 0 else (n.feature_id, round(n.threshold, 9), _shape(nodes, n.left), _shape(nodes, n.right))


@pytest.mark.parametrize("make", [lambda: tree.DecisionTreeClassifier(), lambda: tree.DecisionTreeRegressor(min_samples_leaf=3), lambda: tree.DecisionTreeClassifier("entropy", max_depth=4)])
def test_trees_do_not_hang_on_where_nodes_are_grown(spark, monkeypatch, make):
    r = np.random.default_rng(5)
    x = np.round(r.normal(0, 1, (400, 3)), 1)
    data = [(i, x[i].tolist(), int(x[i, 0] * x[i, 1] > 0) + int(x[i, 2] > 1), float(x[i, 0] + np.round(r.normal(), 1))) for i in range(400)]
    df = spark.createDataFrame(data, "id long, features array<double>, label int, target double")
    want = _shape(make().fit(df).trees[0])
    for cells, few in ((60, 20), (2000, 1), (600, 100)):  # most levels by jobs in chunks of nodes; by bins; by both
        monkeypatch.setattr(tree, "CELLS", cells)
        monkeypatch.setattr(tree, "FEW", few)
        assert _shape(make().fit(df).trees[0]) == want


def test_forest_over_waiting_nodes_predicts(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (500, 4))
    df = spark.createDataFrame([(i, x[i].tolist(), int(x[i, 0] > 0) + int(x[i, 1] > 0)) for i in range(500)], "id long, features array<double>, label int")
    for model in (ensemble.RandomForestClassifier(8), ensemble.ExtraTreesClassifier(8), ensemble.VRTreesClassifier(8)):
        assert model.fit(df).score(df) > 0.9


# ---- groups without a name, and places that later steps agree on


def test_rows_without_a_group_are_a_group(spark):
    from quern.operators import selection

    df = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4]) for i in range(40)], "id long, group_id string")
    found = selection.GroupKFold(3).folds(df).collect()
    assert len(found) == 40 and len({r.fold for r in found if r.group_id is None}) == 1
    roles = selection.GroupShuffleSplit(2, 0.25).roles(df).collect()
    assert len(roles) == 80 and len({(r.split, r.role) for r in roles if r.id % 4 == 0}) == 2


def test_positions_lose_no_row(spark):
    from pyspark.sql import functions as F

    from quern.operators import selection

    df = spark.range(20_000).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3)).repartition(7)
    found = selection.positions(df, ["g"], [F.col("id")]).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("m"), F.max("position_of").alias("of")).collect()
    assert all(r.n == r.d == r.m + 1 == r["of"] for r in found) and sum(r.n for r in found) == 20_000
