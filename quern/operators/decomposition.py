"""Matrix factorisations: on the distributed covariance where that is enough, else by distributed sums at each step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quern.functions.numeric import gram, moments, sums, top_eigen, upright, width, with_numpy
from quern.operators.base import Estimator, Transformer, samples


class _Linear(Estimator, Transformer):
    """(x - mean) W'."""

    def transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda x: (x - self.mean) @ self.components.T)


class PCA(_Linear):
    """Top eigenvectors of the covariance (n - 1); transform centres. Solver 'fpt' finds them one by one by power steps."""

    def __init__(self, n_components: int = 2, solver: str = "auto", max_iter: int = 100, tol: float = 1e-4, random_seed: int = 0):
        self.n_components, self.solver, self.max_iter, self.tol, self.random_seed = n_components, solver, max_iter, tol, random_seed

    def fit(self, df: DataFrame) -> PCA:
        self.mean, cov, _ = moments(samples(df))
        if self.solver == "fpt":
            rng, found = np.random.default_rng(self.random_seed), []
            for _ in range(self.n_components):
                v = rng.normal(size=len(cov))
                for _ in range(self.max_iter):
                    new = cov @ v
                    for u in found:
                        new -= (new @ u) * u
                    new /= np.linalg.norm(new) or 1.0
                    done = 1 - abs(new @ v) <= self.tol**2
                    v = new
                    if done:
                        break
                found.append(v)
            self.components = upright(np.array(found).T).T
        else:
            self.explained, vectors = top_eigen(cov, self.n_components)
            self.components = vectors.T
        return self

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda z: z @ self.components + self.mean)


class SparsePCA(_Linear):
    """Components one by one: soft-thresholded power steps on the covariance, which is deflated after each."""

    def __init__(self, n_components: int = 2, reg_param: float = 0.001, max_iter: int = 1000, tol: float = 1e-6, random_seed: int = 0):
        self.n_components, self.reg_param, self.max_iter, self.tol, self.random_seed = n_components, reg_param, max_iter, tol, random_seed

    def fit(self, df: DataFrame) -> SparsePCA:
        self.mean, cov, _ = moments(samples(df))
        rng, found = np.random.default_rng(self.random_seed), []
        for _ in range(self.n_components):
            v = rng.normal(size=len(cov))
            v /= np.linalg.norm(v)
            for _ in range(self.max_iter):
                z = cov @ v
                z = np.sign(z) * np.maximum(np.abs(z) - self.reg_param, 0)
                z /= np.linalg.norm(z) or 1.0
                done = np.linalg.norm(z - v) <= self.tol
                v = z
                if done:
                    break
            found.append(v)
            out = np.eye(len(cov)) - np.outer(v, v)
            cov = out @ cov @ out
        self.components = upright(np.array(found).T).T
        return self


class FactorAnalysis(Estimator, Transformer):
    """Iterated eigenvectors of the covariance scaled by the noise: F = sqrt(Psi) u sqrt(s - 1)+, Psi = var - diag(F'F)."""

    def __init__(self, n_components: int = 2, max_iter: int = 100, tol: float = 1e-8):
        self.n_components, self.max_iter, self.tol = n_components, max_iter, tol

    def fit(self, df: DataFrame) -> FactorAnalysis:
        self.mean, cov, n = moments(samples(df))
        cov = cov * (n - 1) / n
        var, psi, self.loglike, last = np.diag(cov).copy(), np.ones(len(cov)), [], -np.inf
        for self.n_iter in range(1, self.max_iter + 1):
            scale = np.sqrt(psi) + 1e-12
            values, vectors = np.linalg.eigh(cov / scale[:, None] / scale)
            s, u = values[::-1][: self.n_components], upright(vectors[:, ::-1][:, : self.n_components])
            self.components = (scale[:, None] * u * np.sqrt(np.maximum(s - 1, 0))).T
            kept = np.log(np.maximum(s, 1e-300)).sum() + values[: len(cov) - self.n_components].sum()
            now = -0.5 * n * (kept + self.n_components + np.log(2 * np.pi * psi).sum())
            psi = np.maximum(var - (self.components**2).sum(0), 1e-12)
            self.loglike.append(now)
            if abs(now - last) <= self.tol * max(1.0, abs(now)):
                break
            last = now
        self.noise_variance = psi
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        by_noise = self.components / self.noise_variance
        z = np.linalg.solve(np.eye(self.n_components) + by_noise @ self.components.T, by_noise)
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda x: (x - self.mean) @ z.T)


class FastICA(_Linear):
    """Whitened data, fixed-point steps of g with symmetric decorrelation; each step is one distributed sum."""

    def __init__(self, n_components: int = 2, whiten: bool = True, fun: str = "logcosh", alpha: float = 1.0, max_iter: int = 200, tol: float = 1e-4, random_seed: int = 0):
        self.n_components, self.whiten, self.fun, self.alpha, self.max_iter, self.tol, self.random_seed = n_components, whiten, fun, alpha, max_iter, tol, random_seed

    def _g(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.fun == "exp":
            e = np.exp(-(z**2) / 2)
            return z * e, (1 - z**2) * e
        if self.fun == "cube":
            return z**3, 3 * z**2
        t = np.tanh(self.alpha * z)
        return t, self.alpha * (1 - t**2)

    def fit(self, df: DataFrame) -> FastICA:
        rows = samples(df).select("features").persist()
        mean, cov, n = moments(rows)
        self.mean = mean if self.whiten else np.zeros(len(mean))
        k = self.n_components if self.whiten else len(mean)
        values, vectors = top_eigen(cov * (n - 1) / n, k)
        white = (vectors / np.sqrt(np.maximum(values, 1e-12))).T if self.whiten else np.eye(len(mean))

        def even(w: np.ndarray) -> np.ndarray:
            u, _, v = np.linalg.svd(w)
            return u @ v

        w = even(np.random.default_rng(self.random_seed).normal(size=(k, k)))
        for self.n_iter in range(1, self.max_iter + 1):

            def part(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                z = (x - self.mean) @ white.T
                g, slope = self._g(z @ w.T)
                return np.hstack([g.T @ z, slope.sum(0)[:, None]])

            flat = sums(rows, ["features"], part).reshape(k, k + 1) / n
            new = even(flat[:, :k] - flat[:, k:] * w)
            done = np.abs(np.abs((new * w).sum(1)) - 1).max() <= self.tol
            w = new
            if done:
                break
        self.components = w @ white
        self.mixing = np.linalg.pinv(self.components)
        rows.unpersist()
        return self

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda z: z @ self.mixing.T + self.mean)


class NMF(Estimator, Transformer):
    """Multiplicative updates of non-negative W and H with rows of H of length one.

    Rows of W belong to rows of data and are never gathered: each step solves them for the current H in its own partition
    and adds up W'X and W'W, which are all that H needs.
    """

    def __init__(self, n_components: int = 2, max_iter: int = 500, tol: float = 1e-4, eps: float = 1e-16, random_seed: int = 0, inner: int = 30):
        self.n_components, self.max_iter, self.tol, self.eps, self.random_seed, self.inner = n_components, max_iter, tol, eps, random_seed, inner

    def _w(self, x: np.ndarray, h: np.ndarray, turns: int) -> np.ndarray:
        w = np.full((len(x), len(h)), x.mean() / len(h) + 1e-3)
        top, square = x @ h.T, h @ h.T
        for _ in range(turns):
            w *= top / (w @ square + self.eps)
        return w

    def fit(self, df: DataFrame) -> NMF:
        rows = samples(df).select("features").persist()
        k, d = self.n_components, width(rows)
        h = np.random.default_rng(self.random_seed).random((k, d)) + 0.1
        h /= np.linalg.norm(h, axis=1, keepdims=True)
        total = np.trace(gram(rows)[0])
        last = np.inf
        for self.n_iter in range(1, self.max_iter + 1):

            def part(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
                w = self._w(x, h, self.inner)
                return np.hstack([w.T @ x, w.T @ w])

            flat = sums(rows, ["features"], part).reshape(k, d + k)
            wx, ww = flat[:, :d], flat[:, d:]
            for _ in range(self.inner):
                h = h * wx / (ww @ h + self.eps)
            error = total - 2 * (wx * h).sum() + (ww @ h * h).sum()
            h /= np.linalg.norm(h, axis=1, keepdims=True) + self.eps
            if abs(last - error) <= self.tol * 1e-3 * max(total, 1e-12):
                break
            last = error
        self.components = h
        rows.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda x: self._w(x, self.components, 200))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "features", "array<double>", ["features"], lambda w: w @ self.components)
