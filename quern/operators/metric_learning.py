"""Supervised linear maps. FDA needs class sums only; the others look at pairs of rows, in blocks made in tasks beyond `limit` rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quern.functions.blocks import Blocks
from quern.functions.numeric import collected, general_eigen, lbfgs, sums, top_eigen, width, with_numpy
from quern.operators.base import Estimator, Transformer, classes_of, labels, samples, targets
from quern.operators.preprocessing import squared


class _Map(Estimator, Transformer):
    """x W', without centring."""

    def transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda x: x @ self.components.T)


class FisherDiscriminantAnalysis(_Map):
    """Generalised eigenvectors of scatter between classes against scatter within."""

    def __init__(self, n_components: int | None = None):
        self.n_components = n_components

    def fit(self, df: DataFrame) -> FisherDiscriminantAnalysis:
        df = labels(samples(df))
        known, d = np.array(classes_of(df)), width(df)
        hot = lambda y: (y[:, None] == known).astype(float)
        flat = sums(df, ["features", "label"], lambda x, y: np.hstack([hot(y).T @ x, hot(y).sum(0)[:, None]])).reshape(len(known), d + 1)
        n = flat[:, -1:]
        self.class_means, self.mean = flat[:, :-1] / n, flat[:, :-1].sum(0) / n.sum()
        means = self.class_means
        within = sums(df, ["features", "label"], lambda x, y: (g := x - means[np.searchsorted(known, y)]).T @ g).reshape(d, d)
        gap = means - self.mean
        k = self.n_components or min(d, len(known) - 1)
        _, v = general_eigen((gap * n).T @ gap, within, k, ridge=1e-12 * np.trace(within))
        self.components = v.T
        return self


class LocalFisherDiscriminantAnalysis(_Map):
    """FDA with pairs of a class weighted by their RBF affinity."""

    def __init__(self, n_components: int | None = None, gamma: float | None = None, limit: int = 5000):
        self.n_components, self.gamma, self.limit = n_components, gamma, limit

    def fit(self, df: DataFrame) -> LocalFisherDiscriminantAnalysis:
        x, y = collected(labels(samples(df)), ["features", "label"], 0)
        n, d = x.shape
        gamma, (names, at, counts) = self.gamma or 1 / d, np.unique(y, return_inverse=True, return_counts=True)
        size = counts[at].astype(float)

        def scatters(x: np.ndarray, lo: int, hi: int, y: np.ndarray, size: np.ndarray) -> tuple:
            a, same = np.exp(-gamma * squared(x[lo:hi], x)), y[lo:hi, None] == y
            of = lambda w: x[lo:hi].T @ (w.sum(1)[:, None] * x[lo:hi] - w @ x)
            return of(np.where(same, a * (1 / n - 1 / size), 1 / n)), of(np.where(same, a / size, 0.0))

        if n <= self.limit:
            between, s = scatters(x, 0, n, y, size)
        else:
            blocks = Blocks(df.sparkSession, x)
            between, s = blocks.total(scatters, y, size)
            blocks.close()
        _, v = general_eigen(between, s, self.n_components or d, ridge=1e-12 * np.trace(s))
        self.components = v.T
        return self


class _Softmax(_Map):
    def __init__(self, n_components: int | None = None, init: str = "random", max_iter: int = 100, tol: float = 1e-6, random_seed: int = 0, limit: int = 3000):
        self.n_components, self.init, self.max_iter, self.tol, self.random_seed, self.limit = n_components, init, max_iter, tol, random_seed, limit

    def _learn(self, df: DataFrame, x: np.ndarray, y: np.ndarray, of) -> None:
        k = self.n_components or x.shape[1]
        if self.init == "pca":
            gap = x - x.mean(0)
            w = top_eigen(gap.T @ gap, k)[1].T
        else:
            w = np.random.default_rng(self.random_seed).normal(0, 1, (k, x.shape[1])) / np.sqrt(x.shape[1])

        def part(x: np.ndarray, lo: int, hi: int, z: np.ndarray, y: np.ndarray) -> tuple:
            d = squared(z[lo:hi], z)
            d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
            p = np.exp(-(d - d.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            loss, pull = of(p, y[lo:hi], y)  # pull: derivative by each squared distance
            own, ahead = z[lo:hi] * pull.sum(1)[:, None] - pull @ z, z * pull.sum(0)[:, None] - pull.T @ z[lo:hi]
            return loss, own.T @ x[lo:hi] + ahead.T @ x

        blocks = Blocks(df.sparkSession, x) if len(x) > self.limit else None

        def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
            z = x @ flat.reshape(k, -1).T
            loss, slope = blocks.total(part, z, y) if blocks else part(x, 0, len(x), z, y)
            return float(loss), 2 * slope.ravel()

        self.components = lbfgs(at, w.ravel(), self.max_iter, self.tol).reshape(k, -1)
        if blocks:
            blocks.close()


class NeighbourhoodComponentAnalysis(_Softmax):
    """n - sum of the chances of a neighbour of one's own class."""

    def fit(self, df: DataFrame) -> NeighbourhoodComponentAnalysis:
        x, y = collected(labels(samples(df)), ["features", "label"], 0)

        def of(p: np.ndarray, mine: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
            same = (mine[:, None] == y).astype(float)
            own = (p * same).sum(1)
            return len(p) - own.sum(), p * (same - own[:, None])

        self._learn(df, x, y, of)
        return self


class MLKR(_Softmax):
    """Squared error of kernel regression on the other rows."""

    def fit(self, df: DataFrame) -> MLKR:
        x, y = collected(targets(samples(df)), ["features", "target"], 0)
        y = y.reshape(len(x), -1)

        def of(p: np.ndarray, mine: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
            found = p @ y
            gap = found - mine
            # d loss / d d_ij = -2 p_ij gap_i (y_j - found_i)
            return float((gap**2).sum()), -2 * p * (gap @ y.T - (gap * found).sum(1, keepdims=True))

        self._learn(df, x, y, of)
        return self
