"""Kernel machines on precomputed kernels, and kernel approximations.

Features of row i are its kernel values with all fitted rows in order of id. Up to `limit` rows the n x n kernel is held on the
driver; beyond, its rows stay with the tasks, which give products with it, and solvers need no more than these. What
KernelCalculator.fit_transform has made is known by its rows: tasks make its tiles where a product needs them. Each product
makes n x n values, so for very many rows RBF or Nystroem features with a linear model are the way that scales.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.blocks import krylov, preconditioned, products, scatter_products, solved, subspace
from quern.functions.kernels import KernelTable, table_of, weighted
from quern.functions.numeric import CELLS, collected, general_eigen, sums, top_eigen, upright, width, with_numpy
from quern.operators.base import Classifier, Estimator, Regressor, Transformer, decided, labels, platt, samples, sigmoid, targets
from quern.operators.preprocessing import kernel

LIMIT = 5000


class KernelRidge(Estimator, Regressor):
    """(K + reg I) a = y; reg may be one value an output."""

    def __init__(self, reg_param: float | list[float] = 1.0, limit: int = LIMIT):
        self.reg_param, self.limit = reg_param, limit

    def fit(self, df: DataFrame) -> KernelRidge:
        if (table := table_of(df)) and len(table.x) > self.limit:
            rows = targets(table.source)
            self.many = dict(rows.dtypes)["target"].startswith("array")
            (y,) = collected(rows, ["target"], 0)
            self._by_tiles(table, y.reshape(len(y), -1).astype(float))
            return self
        df = targets(samples(df))
        self.many = dict(df.dtypes)["target"].startswith("array")
        (y,) = collected(df, ["target"], 0)
        self._solve(df, y.reshape(len(y), -1))
        return self

    def _solve(self, df: DataFrame, y: np.ndarray) -> None:
        regs = np.broadcast_to(np.asarray(self.reg_param, float), (y.shape[1],))
        if len(y) > self.limit:
            self.weight_vec = solved(lambda v: products(df, v) + regs * v, y.astype(float))
            return
        (k,) = collected(df, ["features"], self.limit)
        self.weight_vec = np.stack([np.linalg.solve(k + r * np.eye(len(k)), y[:, j]) for j, r in enumerate(regs)], axis=1)

    def _by_tiles(self, table: KernelTable, y: np.ndarray, landmarks: int = 1000) -> None:
        """Conjugate gradients on tiles of the kernel; Nystroem's eigenvectors of some rows, those that stand out over reg, take most steps out."""
        n, regs, eased = len(y), np.broadcast_to(np.asarray(self.reg_param, float), (y.shape[1],)), np.copy
        if (regs > 0).all():
            near, held, turn = table.landmarks(landmarks)
            keep = np.flatnonzero(held > max(1e-12 * held[0], 0.05 * regs.min() * len(near) / n))[: max(1, 5 * CELLS // n)]
            turn = turn[:, keep] / np.sqrt(held[keep])
            f = np.concatenate([table.of(table.x[at : at + 1024], near) @ turn for at in range(0, n, 1024)])
            held, turn = np.linalg.eigh(f.T @ f)
            eased = lambda r: (r - f @ (turn @ ((turn.T @ (f.T @ r)) / (held[:, None] + regs)))) / regs
        self.weight_vec = solved(lambda v: table.times(v)[0] + regs * v, y, eased=eased)
        table.close()

    def predict(self, df: DataFrame) -> DataFrame:
        if self.many:
            return weighted(samples(df), "prediction", "array<double>", self.weight_vec, lambda z: z)
        return weighted(samples(df), "prediction", "double", self.weight_vec, lambda z: z[:, 0])


class KernelRidgeClassifier(KernelRidge, Classifier):
    """Kernel ridge onto -1 and 1 for each class."""

    predict, score = Classifier.predict, Classifier.score

    def fit(self, df: DataFrame) -> KernelRidgeClassifier:
        if (table := table_of(df)) and len(table.x) > self.limit:
            (y,) = collected(labels(table.source), ["label"], 0)
            self.classes = np.unique(y).tolist()
            self._by_tiles(table, np.where(y[:, None] == np.array(self.classes), 1.0, -1.0))
            return self
        df = labels(samples(df))
        (y,) = collected(df, ["label"], 0)
        self.classes = np.unique(y).tolist()
        self._solve(df, np.where(y[:, None] == np.array(self.classes), 1.0, -1.0))
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return weighted(samples(df), "decision", "array<double>", self.weight_vec, lambda z: z)


class KernelSVC(Estimator, Classifier):
    """Pegasos steps, one class against the rest. Two classes predict labels; compat=True predicts -1 and 1."""

    def __init__(self, reg_param: float = 1.0, max_iter: int = 1000, probability: bool = False, random_seed: int = 0, limit: int = LIMIT, compat: bool = False):
        self.reg_param, self.max_iter, self.probability, self.random_seed, self.limit, self.compat = reg_param, max_iter, probability, random_seed, limit, compat

    def fit(self, df: DataFrame) -> KernelSVC:
        df = labels(samples(df))
        ids, y = collected(df, ["id", "label"], 0)
        self.classes = np.unique(y).tolist()
        sides = self.classes[-1:] if len(self.classes) <= 2 else self.classes
        self.weight_vec = self._pegasos(df, ids, np.where(y[:, None] == np.array(sides), 1.0, -1.0))
        self.prob_param = []
        if self.probability:
            for i, c in enumerate(sides):
                rows = with_numpy(df, "_f", "double", ["features"], lambda x, i=i: (x @ self.weight_vec)[:, i]).withColumn("_y", F.when(F.col("label") == c, 1).otherwise(-1))
                self.prob_param.append(platt(rows, "_f", "_y"))
        return self

    def _pegasos(self, df: DataFrame, ids: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Weights, a column a side; all sides draw the same rows, whose kernel values come to the driver some steps ahead."""
        rng, n, hits = np.random.default_rng(self.random_seed), len(t), np.zeros(t.shape)
        order: list[int] = []
        while len(order) < self.max_iter:
            order += rng.permutation(n).tolist()[::-1]
        order = order[: self.max_iter]
        ahead = self.max_iter if n <= self.limit else max(1, 4 * CELLS // n)
        for first in range(0, self.max_iter, max(1, ahead)):
            steps = order[first : first + ahead]
            places = np.unique(steps)
            rows = df if n <= self.limit else df.filter(F.col("id").isin(ids[places].tolist()))
            (k,) = collected(rows, ["features"], self.limit if n <= self.limit else 0)
            if n <= self.limit:
                places = np.arange(n)
            elif len(k) != len(places):
                raise ValueError("ids must differ")
            at = dict(zip(places.tolist(), range(len(places)), strict=True))
            for step, i in enumerate(steps, first):
                hits[i] += t[i] * (k[at[i]] @ (hits * t)) / (self.reg_param * (step + 1)) < 1
        return hits * t / (self.reg_param * self.max_iter)

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), lambda k: np.hstack([-(k @ self.weight_vec), k @ self.weight_vec]) if len(self.classes) == 2 else k @ self.weight_vec)

    def predict(self, df: DataFrame) -> DataFrame:
        out = Classifier.predict(self, df)
        return out.withColumn("prediction", F.when(F.col("prediction") == self.classes[-1], 1).otherwise(-1)) if self.compat and len(self.classes) == 2 else out

    def predict_proba(self, df: DataFrame) -> DataFrame:
        def of(k: np.ndarray) -> np.ndarray:
            p = np.stack([sigmoid(-(a * z + b)) for z, (a, b) in zip((k @ self.weight_vec).T, self.prob_param, strict=True)], axis=1)
            return np.hstack([1 - p, p]) if p.shape[1] == 1 else p / p.sum(1, keepdims=True)

        return with_numpy(samples(df), "probability", "array<double>", ["features"], of)


class KernelPCA(Estimator, Transformer):
    """Centred kernel's top eigenpairs."""

    def __init__(self, n_components: int = 2, limit: int = LIMIT):
        self.n_components, self.limit = n_components, limit

    def fit(self, df: DataFrame) -> KernelPCA:
        if (table := table_of(df)) and len(table.x) > self.limit:
            return self._by_tiles(table)
        df = samples(df)
        n = df.count()
        if n > self.limit:
            mean = products(df, np.full((n, 1), 1 / n))
            self.row_mean, self.all_mean = mean[:, 0], mean.mean()
            centred = lambda v: products(df, v) - v.sum(0) * mean + (self.all_mean * v.sum(0) - mean.T @ v)
            self.lambdas, self.alphas = krylov(centred, n, self.n_components, block=16)
            self.transform_mat = self.alphas / np.sqrt(np.maximum(self.lambdas, 1e-12))
            return self
        (k,) = collected(df, ["features"], self.limit)
        self.row_mean, self.all_mean = k.mean(0), k.mean()
        centred = k - self.row_mean - k.mean(1, keepdims=True) + self.all_mean
        self.lambdas, self.alphas = top_eigen(centred, self.n_components)
        self.transform_mat = self.alphas / np.sqrt(np.maximum(self.lambdas, 1e-12))
        return self

    def _by_tiles(self, table: KernelTable, landmarks: int = 1000) -> KernelPCA:
        """The same on tiles, from Nystroem's eigenvectors of some rows: as many as come before the largest drop of their eigenvalues."""
        n, k = len(table.x), self.n_components
        mean = table.times(np.full((n, 1), 1 / n))[0]
        self.row_mean, self.all_mean = mean[:, 0], mean.mean()
        near, _, _ = table.landmarks(landmarks)
        few = table.of(near, near)
        held, turn = top_eigen(few - few.mean(0) - few.mean(1, keepdims=True) + few.mean(), len(near))
        some = np.maximum(held[: max(k + 1, min(100, 5 * CELLS // n)) + 1], 1e-14 * held[0])
        take = k + int((some[k - 1 : -1] / some[k:]).argmax()) if len(some) > k else k
        start = np.concatenate([table.of(table.x[at : at + 1024], near) @ turn[:, :take] for at in range(0, n, 1024)])
        centred = lambda v: table.times(v, self.row_mean)[0]
        found = subspace(centred, start - start.mean(0), k)
        self.lambdas, self.alphas = found if found else krylov(centred, n, k, block=16)
        table.close()
        self.transform_mat = self.alphas / np.sqrt(np.maximum(self.lambdas, 1e-12))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        w, mean, every = self.transform_mat, self.row_mean, self.all_mean
        if table_of(df):  # a row's mean is the last product
            both = np.hstack([w, np.full((len(w), 1), 1 / len(w))])
            return weighted(samples(df), "features", "array<double>", both, lambda z: z[:, :-1] - z[:, -1:] * w.sum(0) + (every * w.sum(0) - mean @ w))
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda k: (k - k.mean(1, keepdims=True) - mean + every) @ w)


class KernelFDA(Estimator, Transformer):
    """Directions of most scatter between classes over within, in a kernel's space.

    The scatter between c classes is GG' with a column a class. Beyond `limit` rows the directions come from (within + ridge)^-1 G,
    solved on products with the within scatter, which tasks make from their rows; one pass over the kernel each.
    """

    def __init__(self, n_components: int | None = None, reg_param: float = 1e-8, limit: int = LIMIT):
        self.n_components, self.reg_param, self.limit = n_components, reg_param, limit

    def fit(self, df: DataFrame) -> KernelFDA:
        if (table := table_of(df)) and len(table.x) > self.limit:
            return self._by_tiles(table)
        df = labels(samples(df))
        if df.count() > self.limit:
            return self._by_products(df)
        k, y = collected(df, ["features", "label"], self.limit)
        classes = np.unique(y)
        n = self.n_components or min(len(k), len(classes) - 1)
        mean, between, within = k.mean(0), np.zeros_like(k), np.zeros_like(k)
        for c in classes:
            own = k[y == c]
            gap = own.mean(0) - mean
            between += len(own) * np.outer(gap, gap)
            within += (own - own.mean(0)).T @ (own - own.mean(0))
        _, self.alphas = general_eigen(between, within, n, ridge=max(self.reg_param, 1e-8) * max(1.0, np.trace(within) / len(k)))
        return self

    def _by_products(self, df: DataFrame) -> KernelFDA:
        (y,) = collected(df, ["label"], 0)
        classes, sizes = np.unique(y, return_counts=True)
        n, most = len(y), len(classes) - 1
        if (self.n_components or most) > most:
            raise ValueError(f"{most + 1} classes differ in {most} directions at most")

        def by_class(k: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.stack([k[y == c].sum(0) for c in classes])

        totals = sums(df, ["features", "label"], by_class).reshape(len(classes), n)
        means = totals / sizes[:, None]
        gaps = ((means - totals.sum(0) / n) * np.sqrt(sizes)[:, None]).T
        within = sums(df, ["features", "label"], lambda k, y: np.array([((k - means[np.searchsorted(classes, y)]) ** 2).sum()]))[0]
        ridge = max(self.reg_param, 1e-8) * max(1.0, within / n)
        x = preconditioned(lambda v: scatter_products(df, means, classes, v), gaps, ridge)
        values, vectors = top_eigen(gaps.T @ x, self.n_components or most)
        self.alphas = upright(x @ (vectors / np.sqrt(np.maximum(values, 1e-300))))
        return self

    def _by_tiles(self, table: KernelTable) -> KernelFDA:
        """The same from the rows. Products go through the centred kernel, as means that are far larger than the scatter would leave nothing of it but rounding."""
        (y,) = collected(labels(table.source), ["label"], 0)
        classes, sizes = np.unique(y, return_counts=True)
        n, most, share = len(y), len(classes) - 1, (y[:, None] == classes) / np.sqrt(sizes)
        if (self.n_components or most) > most:
            raise ValueError(f"{most + 1} classes differ in {most} directions at most")

        mean = table.times(np.full((n, 1), 1 / n))[0][:, 0]
        beside = mean - mean.mean()
        gaps, squares = table.times(share, mean)
        gaps += beside @ share
        within = squares + n * (beside @ beside) - (gaps**2).sum()
        ridge = max(self.reg_param, 1e-8) * max(1.0, within / n)

        def scatter(v: np.ndarray) -> np.ndarray:
            a = table.times(v, mean)[0] + beside[:, None] * v.sum(0)
            a -= share @ (share.T @ a)
            return table.times(a, mean)[0] + mean @ a

        x = solved(lambda v: scatter(v) + ridge * v, gaps, 1e-9, 2000, self._eased(table, share, ridge))
        table.close()
        values, vectors = top_eigen(gaps.T @ x, self.n_components or most)
        self.alphas = upright(x @ (vectors / np.sqrt(np.maximum(values, 1e-300))))
        return self

    @staticmethod
    def _eased(table: KernelTable, share: np.ndarray, ridge: float) -> Callable[[np.ndarray], np.ndarray]:
        """r -> nearly (within + ridge)^-1 r: exactly that for the scatter of a kernel F F' of features."""
        of, wide = table.features()
        gram = table.products_of(of, wide, np.eye(wide))
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        turn = turn[:, values > values[-1] * 1e-13] / np.sqrt(values[values > values[-1] * 1e-13])
        again = turn.T @ table.products_of(of, wide, turn)  # F turn is orthonormal but for rounding of the small eigenvalues
        turn = np.linalg.solve(np.linalg.cholesky((again + again.T) / 2), turn.T).T
        step = 1024
        means = sum(share[at : at + step].T @ of(table.x[at : at + step]) for at in range(0, len(share), step))
        inner = turn.T @ gram
        held, side = np.linalg.eigh(inner @ (gram - means.T @ means) @ inner.T)
        turn, change = turn @ side, (1 / (np.maximum(held, 0) + ridge) - 1 / ridge)[:, None]

        def eased(r: np.ndarray) -> np.ndarray:
            parts = sum(of(table.x[at : at + step]).T @ r[at : at + step] for at in range(0, len(r), step))
            parts = turn @ (change * (turn.T @ parts))
            return r / ridge + np.concatenate([of(table.x[at : at + step]) @ parts for at in range(0, len(r), step)])

        return eased

    def transform(self, df: DataFrame) -> DataFrame:
        return weighted(samples(df), "features", "array<double>", self.alphas, lambda k: k)


class RBF(Estimator, Transformer):
    """Random Fourier features: sin(x R + b) sqrt(2 / D), with b of 0 in the first half and pi / 2 in the rest."""

    def __init__(self, gamma: float = 1.0, n_components: int = 128, random_seed: int = 0):
        self.gamma, self.n_components, self.random_seed = gamma, n_components, random_seed

    def fit(self, df: DataFrame) -> RBF:
        half = self.n_components // 2
        mat = np.random.default_rng(self.random_seed).normal(0, np.sqrt(2 * self.gamma), (width(samples(df)), self.n_components - half))
        self.random_mat = np.hstack([mat[:, :half], mat])
        self.random_vec = np.concatenate([np.zeros(half), np.full(self.n_components - half, np.pi / 2)])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda x: np.sin(x @ self.random_mat + self.random_vec) * np.sqrt(2 / self.n_components))


class Nystroem(Estimator, Transformer):
    """Kernel values with random landmarks times U Lambda^(-1/2) of their own kernel, eigenvalues held above 1e-12."""

    def __init__(self, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef: float = 1.0, n_components: int = 100, random_seed: int = 0):
        self.kernel, self.gamma, self.degree, self.coef, self.n_components, self.random_seed = kernel, gamma, degree, coef, n_components, random_seed

    def fit(self, df: DataFrame) -> Nystroem:
        few = samples(df).orderBy(F.xxhash64("id", F.lit(self.random_seed)), "id").limit(self.n_components)
        (self.components,) = collected(few, ["features"], self.n_components)
        k = kernel(self.components, self.components, self.kernel, self.gamma, self.degree, self.coef)
        values, vectors = top_eigen(k, len(k))
        self.normalizer = vectors / np.sqrt(np.maximum(values, 1e-12))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda x: kernel(x, self.components, self.kernel, self.gamma, self.degree, self.coef) @ self.normalizer)
