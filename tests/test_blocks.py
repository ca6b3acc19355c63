"""Methods on all pairs beyond `limit` rows: the same results in blocks as from a table on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.blocks import krylov, preconditioned, solved
from quern.functions.numeric import collected, top_eigen
from quern.operators import clustering, kernel, manifold, metric_learning, pairwise, preprocessing


@pytest.fixture(scope="module")
def rows(spark):
    """150 rows in three groups, the last row a copy of the first."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)) + 4 * np.eye(6)[np.arange(150) % 3]
    x[-1] = x[0]
    return spark.createDataFrame([(int(i), [float(v) for v in r], int(i % 3), float(r[0])) for i, r in enumerate(x)], "id long, features array<double>, label int, target double").repartition(3).persist()


def values(df, column="features"):
    return collected(df, [column], 0)[0]


CLUSTERERS = {
    "single_linkage": lambda n: clustering.SingleLinkage(3, limit=n),
    "hdbscan": lambda n: clustering.HDBSCAN(5, limit=n),
    "power_iteration": lambda n: clustering.PowerIteration(3, gamma=0.2, max_iter=30, limit=n),
}


@pytest.mark.parametrize("name", CLUSTERERS)
def test_clusters_beyond_limit(rows, name):
    make = CLUSTERERS[name]
    assert make(1000).fit(rows).labels == make(50).fit(rows).labels


def test_snn_by_links_is_the_scan(rows):
    ids, x = collected(rows, ["id", "features"], 0)
    d = ((x[:, None] - x) ** 2).sum(2)
    for k, eps, least in ((10, 5, 5), (6, 3, 4), (8, 2, 30)):
        a = np.zeros((len(x), len(x)))
        a[np.arange(len(x))[:, None], np.argsort(d, axis=1, kind="stable")[:, :k]] = 1
        want = clustering._scan([np.flatnonzero(r > eps) for r in a @ a.T], least)
        model = clustering.SNN(k, eps, least, limit=50).fit(rows)
        assert model.labels == dict(zip(ids.tolist(), want.tolist(), strict=True))


TRANSFORMERS = {
    "classical_mds": lambda n: manifold.ClassicalMDS(2, limit=n),
    "mds": lambda n: manifold.MDS(2, max_iter=6, limit=n),
    "laplacian_eigenmaps": lambda n: manifold.LaplacianEigenmaps(2, n_neighbors=60, limit=n),
    "laplacian_eigenmaps_heat": lambda n: manifold.LaplacianEigenmaps(2, 0.1, n_neighbors=60, limit=n),
    "locally_linear_embedding": lambda n: manifold.LocallyLinearEmbedding(2, 60, limit=n),
    "local_tangent_space_alignment": lambda n: manifold.LocalTangentSpaceAlignment(2, 60, limit=n),
    "hessian_eigenmaps": lambda n: manifold.HessianEigenmaps(60, 2, limit=n),
    "local_fisher_discriminant_analysis": lambda n: metric_learning.LocalFisherDiscriminantAnalysis(2, limit=n),
    "neighbourhood_component_analysis": lambda n: metric_learning.NeighbourhoodComponentAnalysis(2, max_iter=5, limit=n),
    "mlkr": lambda n: metric_learning.MLKR(2, max_iter=5, limit=n),
}


@pytest.mark.parametrize("name", TRANSFORMERS)
def test_transformers_beyond_limit(rows, name):
    make = TRANSFORMERS[name]
    want, found = (values(make(n).fit_transform(rows)) for n in (1000, 50))
    assert np.abs(want - found).max() <= 1e-5 * max(1.0, np.abs(want).max())


KERNELS = {
    "kernel_ridge": (lambda n: kernel.KernelRidge(0.5, limit=n), "weight_vec"),
    "kernel_ridge_classifier": (lambda n: kernel.KernelRidgeClassifier(0.5, limit=n), "weight_vec"),
    "kernel_svc": (lambda n: kernel.KernelSVC(0.1, 400, limit=n), "weight_vec"),
    "kernel_pca": (lambda n: kernel.KernelPCA(2, limit=n), "transform_mat"),
}


@pytest.mark.parametrize("name", KERNELS)
def test_kernels_beyond_limit(rows, name):
    make, learnt = KERNELS[name]
    k = preprocessing.KernelCalculator(gamma=0.05).fit_transform(rows)
    want, found = (getattr(make(n).fit(k), learnt) for n in (1000, 50))
    assert np.abs(want - found).max() <= 1e-7 * np.abs(want).max()


def test_kernel_fda_beyond_limit(rows):
    df = preprocessing.KernelCalculator(gamma=0.05).fit_transform(rows)
    for make in (lambda n: kernel.KernelFDA(limit=n), lambda n: kernel.KernelFDA(1, 0.01, limit=n)):
        want, found = (values(make(n).fit(df).transform(df)) for n in (1000, 50))
        assert np.abs(want - found).max() <= 1e-5 * np.abs(want).max()
    with pytest.raises(ValueError, match="2 directions"):
        kernel.KernelFDA(3, limit=50).fit(df)


def test_preconditioned_solves():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    a = (q * np.concatenate([10.0 ** rng.uniform(0, 4, 20), 10.0 ** rng.uniform(-7, -5, 60), np.zeros(40)])) @ q.T
    b = rng.normal(size=(120, 3))
    want = np.linalg.solve(a + 1e-6 * np.eye(120), b)
    for rank in (1, 30, 120, 500):
        got = preconditioned(lambda v: a @ v, b, 1e-6, rank)
        assert np.abs(want - got).max() <= 1e-5 * np.abs(want).max()


def test_kernel_values_of_more_than_five_thousand_rows(spark):
    df = spark.range(5003).select("id", F.array((F.col("id") % 7).cast("double")).alias("features"))
    out = preprocessing.KernelCalculator(kernel="linear").fit_transform(df)
    got = out.filter("id = 6").select(F.size("features"), F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).first()
    assert got[0] == 5003 and got[1] == 6.0 * sum(i % 7 for i in range(5003))


PAIRS = {
    "cosine_similarity": (pairwise.cosine_similarity, lambda a, b: (a * b + 1.0) / (np.sqrt(a * a + 1.0) * np.sqrt(b * b + 1.0))),
    "cosine_distance": (pairwise.cosine_distance, lambda a, b: 0.0 if a == b else min(2.0, max(0.0, 1 - (a * b + 1.0) / (np.sqrt(a * a + 1.0) * np.sqrt(b * b + 1.0))))),
    "euclidean_distance": (pairwise.euclidean_distance, lambda a, b: abs(a - b)),
    "manhattan_distance": (pairwise.manhattan_distance, lambda a, b: abs(a - b)),
    "linear_kernel": (pairwise.linear_kernel, lambda a, b: a * b + 1.0),
}


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_are_made_in_blocks(spark, name):
    of, want = PAIRS[name]
    x = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)] + [(300, None), (301, [None, 1.0]), (302, [3.0])], "id int, features array<double>")
    assert "MapInArrow" in of(x)._jdf.queryExecution().executedPlan().toString()  # no row of two arrays for every pair
    out = of(x).collect()
    assert len(out) == 303 * 303 and {(r.i, r.j) for r in out} == {(i, j) for i in range(303) for j in range(303)}
    for r in out:
        if max(r.i, r.j) < 300:
            assert r[2] == want(r.i, r.j)
        elif r.i != r.j:
            assert r[2] is None


def test_products_are_enough():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 200))
    a = a @ a.T
    for largest in (True, False):
        want, got = top_eigen(a, 3, largest), krylov(lambda v: a @ v, 200, 3, largest, most=60)
        assert np.allclose(want[0], got[0], atol=1e-6 * want[0].max())
    b = rng.normal(size=(200, 2))
    assert np.allclose(solved(lambda v: a @ v + v, b), np.linalg.solve(a + np.eye(200), b), atol=1e-8)
    flat = np.diag([0.0] * 5 + [1.0] * 195)  # a value that several vectors share
    assert np.allclose(krylov(lambda v: flat @ v, 200, 3, largest=False)[0], 0, atol=1e-10)


@pytest.fixture(scope="module")
def flat_kernel(spark):
    """Kernel values near 1 of 400 rows of length 1, in three groups that hardly differ."""
    x = np.random.default_rng(5).normal(size=(400, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(int(i), r.tolist(), int(i % 3), float(r[0])) for i, r in enumerate(x)], "id long, features array<double>, label int, target double")
    return preprocessing.KernelCalculator(gamma=0.01).fit_transform(df)


def test_kernel_fda_of_known_rows_takes_few_products(flat_kernel, monkeypatch):
    from quern.functions.kernels import KernelTable

    calls, times = [], KernelTable.times
    monkeypatch.setattr(KernelTable, "times", lambda *a: calls.append(1) or times(*a))
    k, y = collected(flat_kernel, ["features", "label"], 0)
    model = kernel.KernelFDA(limit=50).fit(flat_kernel)
    assert 0 < len(calls) <= 30
    gaps = np.stack([(k[y == c].mean(0) - k.mean(0)) * np.sqrt((y == c).sum()) for c in range(3)], axis=1)
    own = k - np.stack([k[y == c].mean(0) for c in range(3)])[y]
    x = np.linalg.solve(own.T @ own + 1e-8 * np.eye(400), gaps)
    size, turn = top_eigen(gaps.T @ x, 2)
    want = k @ (x @ (turn / np.sqrt(size)))
    got = values(model.transform(flat_kernel))
    assert np.abs(np.abs(got - got.mean(0)) - np.abs(want - want.mean(0))).max() <= 1e-3 * np.abs(want - want.mean(0)).max()


MACHINES = {
    "kernel_ridge": (lambda n: kernel.KernelRidge(1.0, limit=n), 12),
    "kernel_ridge_classifier": (lambda n: kernel.KernelRidgeClassifier(1.0, limit=n), 12),
    "kernel_pca": (lambda n: kernel.KernelPCA(2, limit=n), 6),
}


@pytest.mark.parametrize("name", MACHINES)
def test_kernel_machines_of_known_rows_take_few_products(flat_kernel, monkeypatch, name):
    from quern.functions.kernels import KernelTable

    make, most = MACHINES[name]
    use = lambda model: model.transform(flat_kernel) if name == "kernel_pca" else model.predict(flat_kernel)
    column = "features" if name == "kernel_pca" else "prediction"
    want = values(use(make(1000).fit(flat_kernel)), column)
    calls, times = [], KernelTable.times
    monkeypatch.setattr(KernelTable, "times", lambda *a: calls.append(1) or times(*a))
    found = use(make(50).fit(flat_kernel))
    assert 0 < len(calls) <= most
    assert np.abs(want - values(found, column)).max() <= 1e-6 * np.abs(want).max()
    if column == "prediction":  # a wide row is made where somebody asks for it
        assert "ArrowEvalPython" not in found.select("id", column)._jdf.queryExecution().executedPlan().toString()
        assert np.abs(values(found) - values(flat_kernel)).max() <= 1e-15


def test_snn_sends_links_not_labels_of_all_rows_a_block(rows, monkeypatch):
    from quern.functions.blocks import Blocks

    sent, run = [], Blocks._run
    monkeypatch.setattr(Blocks, "_run", lambda *a: sent.append(out := run(*a)) or out)
    monkeypatch.setattr(clustering, "Blocks", lambda spark, x: Blocks(spark, x, 2 * len(x)))
    clustering.SNN(10, 5, 5).fit(rows)
    assert max(sum(a.size for part in out for a in part) for out in sent) <= 16 * 150


def test_mds_makes_a_tile_once_for_both_sides(spark, monkeypatch):
    from quern.functions.blocks import Blocks

    x = np.random.default_rng(8).normal(size=(1100, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    passes, paired = [], Blocks.paired
    monkeypatch.setattr(Blocks, "paired", lambda *a: passes.append(1) or paired(*a))
    want, found = (manifold.MDS(2, max_iter=2, limit=n).fit(df) for n in (2000, 50))
    assert len(passes) == 3
    assert np.abs(want.embedding - found.embedding).max() <= 1e-9 and abs(want.stress - found.stress) <= 1e-9 * want.stress


def test_lle_weighs_many_rows_at_a_time_beyond_limit(rows, monkeypatch):
    monkeypatch.setattr(manifold.LocallyLinearEmbedding, "_weights", None)  # a call for each row
    model = manifold.LocallyLinearEmbedding(2, 60, limit=50).fit(rows)
    x, near = model.training, model._near(rows, model.training)
    m = np.zeros((len(x), len(x)))
    for i, at in enumerate(near):
        g = (x[at] - x[i]) @ (x[at] - x[i]).T
        w = np.linalg.solve(g + np.eye(60) * 1e-3 * np.trace(g), np.ones(60))
        row = np.append(-w / w.sum(), 1.0)
        m[np.ix_(np.append(at, i), np.append(at, i))] += np.outer(row, row)
    want = top_eigen(m, 3, largest=False)[1][:, 1:]
    assert np.abs(want - model.embedding).max() <= 1e-5
