"""Manifold learning: methods on all pairs of rows, whose results are joined back to the rows by id.

Tables of all pairs are held on the driver up to `limit` rows. Beyond, tasks make them in blocks (see `Blocks`), graphs of neighbours
are kept as lists, and eigenvectors come from products alone. t-SNE, and distances that are given, take `limit` rows at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quern.functions.blocks import Blocks, krylov, nearest_of
from quern.functions.numeric import collected, general_eigen, top_eigen, upright, with_numpy
from quern.operators.base import Estimator, samples
from quern.operators.preprocessing import squared


class _Embedding(Estimator):
    def _rows(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, x = collected(samples(df), ["id", "features"], self.limit if getattr(self, "metric", "") == "precomputed" else 0)
        return ids, x

    def _distances(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, x = collected(samples(df), ["id", "features"], self.limit)
        return ids, x if self.metric == "precomputed" else np.sqrt(squared(x, x))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.fit(df)
        known = {int(i): z for i, z in zip(self.ids, self.embedding, strict=True)}
        return with_numpy(df, "features", "array<double>", ["id"], lambda i: np.array([known[v] for v in i.tolist()]))


class ClassicalMDS(_Embedding):
    """Double centring of squared distances and top eigenpairs; beyond `limit` rows from the rows' covariance, as they are the same."""

    def __init__(self, n_components: int = 2, metric: str = "euclidean", limit: int = 5000):
        self.n_components, self.metric, self.limit = n_components, metric, limit

    def fit(self, df: DataFrame) -> ClassicalMDS:
        self.ids, x = self._rows(df)
        if len(x) > self.limit:
            self.embedding = _principal(x, self.n_components)
            return self
        s = (x if self.metric == "precomputed" else np.sqrt(squared(x, x))) ** 2
        b = -0.5 * (s - s.mean(0) - s.mean(1, keepdims=True) + s.mean())
        values, vectors = top_eigen(b, self.n_components)
        self.embedding = vectors * np.sqrt(np.maximum(values, 0))
        return self


def _principal(x: np.ndarray, k: int) -> np.ndarray:
    """The classical scaling of rows by Euclidean distances: their centred inner products have the covariance's eigenvalues."""
    gap = x - x.mean(0)
    _, axes = top_eigen(gap.T @ gap, min(k, x.shape[1]))
    out = upright(gap @ axes)
    return np.hstack([out, np.zeros((len(x), k - out.shape[1]))])


def _start(d: np.ndarray, k: int, init: str, seed: int) -> np.ndarray:
    if init == "pca":
        s = d**2
        values, vectors = top_eigen(-0.5 * (s - s.mean(0) - s.mean(1, keepdims=True) + s.mean()), k)
        return vectors * np.sqrt(np.maximum(values, 0))
    return np.random.default_rng(seed).random((len(d), k))


class MDS(_Embedding):
    """SMACOF: Guttman transforms until the stress, half the squared gaps of distances, settles."""

    def __init__(self, n_components: int = 2, metric: str = "euclidean", init: str = "random", max_iter: int = 300, tol: float | None = None, random_seed: int = 0, limit: int = 3000):
        self.n_components, self.metric, self.init, self.max_iter, self.tol, self.random_seed, self.limit = n_components, metric, init, max_iter, tol, random_seed, limit

    def fit(self, df: DataFrame) -> MDS:
        self.ids, x = self._rows(df)
        if len(x) > self.limit:
            return self._in_blocks(df, x)
        high = x if self.metric == "precomputed" else np.sqrt(squared(x, x))
        y, n, last = _start(high, self.n_components, self.init, self.random_seed), len(high), np.inf
        for self.n_iter in range(1, self.max_iter + 1):
            low = np.sqrt(squared(y, y))
            b = -np.divide(high, low, out=np.zeros_like(high), where=low > 1e-12)
            np.fill_diagonal(b, 0)
            np.fill_diagonal(b, -b.sum(1))
            y = b @ y / n
            self.stress = 0.5 * ((high - np.sqrt(squared(y, y))) ** 2).sum()
            if self.tol is not None and abs(last - self.stress) <= self.tol:
                break
            last = self.stress
        self.embedding = y
        return self

    def _in_blocks(self, df: DataFrame, x: np.ndarray) -> MDS:
        """The same steps; each pass over the tiles, which serve both of their sides, gives the stress of where rows stand and where they go next."""

        def tile(x: np.ndarray, one: slice, two: slice, y: np.ndarray) -> tuple[np.ndarray, float]:
            high, low = np.sqrt(squared(x[one], x[two])), np.sqrt(squared(y[one], y[two]))
            stress = 0.5 * ((high - low) ** 2).sum()
            b = np.divide(high, low, out=np.zeros_like(high), where=low > 1e-12)
            if one == two:
                np.fill_diagonal(b, 0)
            return b, float(stress)

        def step(y: np.ndarray) -> tuple[np.ndarray, float]:
            b, stress = blocks.paired(tile, np.hstack([y, np.ones((len(y), 1))]), y)
            return (y * b[:, -1:] - b[:, :-1]) / len(y), stress

        blocks, k, last = Blocks(df.sparkSession, x), self.n_components, np.inf
        y = _principal(x, k) if self.init == "pca" else np.random.default_rng(self.random_seed).random((len(x), k))
        ahead, _ = step(y)
        for self.n_iter in range(1, self.max_iter + 1):
            y = ahead
            ahead, self.stress = step(y)
            if self.tol is not None and abs(last - self.stress) <= self.tol:
                break
            last = self.stress
        blocks.close()
        self.embedding = y
        return self


class TSNE(_Embedding):
    """Perplexity by bisection for each row, then fixed-point updates y <- (sum b y + (a - b) y) / sum a."""

    def __init__(self, n_components: int = 2, perplexity: float = 30.0, metric: str = "euclidean", init: str = "random", max_iter: int = 500, tol: float | None = None, random_seed: int = 0, limit: int = 3000):
        self.n_components, self.perplexity, self.metric, self.init, self.max_iter, self.tol, self.random_seed, self.limit = n_components, perplexity, metric, init, max_iter, tol, random_seed, limit

    def _high(self, d: np.ndarray) -> np.ndarray:
        n, goal = len(d), np.log(self.perplexity)
        beta, low, top = np.ones(n), np.zeros(n), np.full(n, np.inf)
        for _ in range(100):  # all rows at once
            p = np.exp(-(d - np.where(np.eye(n, dtype=bool), np.inf, d).min(1, keepdims=True)) * beta[:, None])
            np.fill_diagonal(p, 0)
            p /= p.sum(1, keepdims=True)
            entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
            gap = entropy - goal
            if (np.abs(gap) <= 1e-5).all():
                break
            low, top = np.where(gap > 0, beta, low), np.where(gap > 0, top, beta)
            beta = np.where(np.isinf(top), beta * 2, (low + top) / 2)
        return np.maximum((p + p.T) / (2 * n), 1e-16)

    def fit(self, df: DataFrame) -> TSNE:
        self.ids, d = self._distances(df)
        p = self._high(d**2)
        y = _start(d, self.n_components, self.init, self.random_seed)
        for self.n_iter in range(1, self.max_iter + 1):
            kernel = 1 / (1 + squared(y, y))
            np.fill_diagonal(kernel, 0)
            q = np.maximum(kernel / kernel.sum(), 1e-16)
            a, b = p * kernel, q * kernel
            new = (b.sum(1, keepdims=True) * y + a @ y - b @ y) / a.sum(1, keepdims=True)
            moved = np.abs(new - y).max()
            y = new
            self.kl_divergence = float((p * np.log(p / q)).sum())
            if self.tol is not None and moved <= self.tol:
                break
        self.embedding = y
        return self


class _Graph(_Embedding):
    """Embeddings by nearest neighbours; new rows go by the same weights to the fitted ones."""

    def _near(self, df: DataFrame, x: np.ndarray) -> np.ndarray:
        k = self.n_neighbors

        def near(x: np.ndarray, lo: int, hi: int) -> tuple:
            d = squared(x[lo:hi], x)
            d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
            return (nearest_of(d, k),)

        if len(x) <= self.limit:
            return near(x, 0, len(x))[0]
        blocks = Blocks(df.sparkSession, x)
        (found,) = blocks.each(near)
        blocks.close()
        return found

    def _bottom(self, places: list[np.ndarray], parts: list[np.ndarray], n: int) -> None:
        """Bottom eigenvectors, but the first, of the sum of small matrices that stand at these places."""
        if n <= self.limit:
            m = np.zeros((n, n))
            for at, part in zip(places, parts, strict=True):
                m[np.ix_(at, at)] += part
            _, vectors = top_eigen(m, self.n_components + 1, largest=False)
        else:
            at, part = np.array(places), np.array(parts)
            times = lambda v: np.stack([np.bincount(at.ravel(), (part @ v[at])[:, :, j].ravel(), n) for j in range(v.shape[1])], axis=1)
            _, vectors = krylov(times, n, self.n_components + 1, largest=False)
        self.embedding = vectors[:, 1:]

    def _weights(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        gap = rows - x
        g = gap @ gap.T
        g += np.eye(len(g)) * self.reg_param * max(np.trace(g), 1e-12)
        w = np.linalg.solve(g, np.ones(len(g)))
        return w / w.sum()

    def transform(self, df: DataFrame) -> DataFrame:
        x, z, k = self.training, self.embedding, self.n_neighbors

        def of(rows: np.ndarray) -> np.ndarray:
            near = np.argsort(squared(rows, x), axis=1, kind="stable")[:, :k]
            return np.array([self._weights(r, x[n]) @ z[n] for r, n in zip(rows, near, strict=True)])

        return with_numpy(samples(df), "features", "array<double>", ["features"], of)


class LaplacianEigenmaps(_Graph):
    """Bottom generalised eigenvectors of the nearest neighbours' Laplacian; heat weights with gamma, else 0 and 1."""

    def __init__(self, n_components: int = 2, gamma: float | None = None, n_neighbors: int = 10, limit: int = 5000):
        self.n_components, self.gamma, self.n_neighbors, self.limit = n_components, gamma, n_neighbors, limit

    def fit(self, df: DataFrame) -> LaplacianEigenmaps:
        self.ids, self.training = self._rows(df)
        x, near = self.training, self._near(df, self.training)
        if len(x) > self.limit:
            return self._sparse(x, near)
        a = np.zeros((len(x), len(x)))
        a[np.arange(len(x))[:, None], near] = 1
        a = np.maximum(a, a.T) * (np.exp(-self.gamma * squared(x, x)) if self.gamma is not None else 1)
        degree = np.diag(np.maximum(a.sum(1), 1e-12))
        values, vectors = general_eigen(degree - a, degree, self.n_components + 1, largest=False)
        self.values, self.embedding = values[1:], vectors[:, 1:]
        return self

    def _sparse(self, x: np.ndarray, near: np.ndarray) -> LaplacianEigenmaps:
        """The same vectors as top ones of D^-1/2 A D^-1/2, whose eigenvalues are one less those of the Laplacian."""
        n = len(x)
        one, two = np.repeat(np.arange(n), near.shape[1]), near.ravel()
        one, two = np.divmod(np.unique(np.concatenate((one * n + two, two * n + one))), n)
        weights = np.ones(len(one))
        if self.gamma is not None:
            for at in range(0, len(one), 1 << 16):
                weights[at : at + (1 << 16)] = np.exp(-self.gamma * ((x[one[at : at + (1 << 16)]] - x[two[at : at + (1 << 16)]]) ** 2).sum(1))
        scale = 1 / np.sqrt(np.maximum(np.bincount(one, weights, n), 1e-12))
        weights *= scale[one] * scale[two]
        times = lambda v: np.stack([np.bincount(one, weights * v[two, j], n) for j in range(v.shape[1])], axis=1)
        values, vectors = krylov(times, n, self.n_components + 1)
        self.values, self.embedding = 1 - values[1:], upright(vectors * scale[:, None])[:, 1:]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x, z, k = self.training, self.embedding, self.n_neighbors

        def of(rows: np.ndarray) -> np.ndarray:
            d = squared(rows, x)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            w = np.exp(-(self.gamma or 0.0) * np.take_along_axis(d, near, 1))
            return (w[:, :, None] * z[near]).sum(1) / w.sum(1, keepdims=True) / (1 - np.minimum(self.values, 0.999))

        return with_numpy(samples(df), "features", "array<double>", ["features"], of)


class LocallyLinearEmbedding(_Graph):
    """Rows from their neighbours' weights; bottom eigenvectors of (I - W)'(I - W)."""

    def __init__(self, n_components: int = 2, n_neighbors: int = 10, reg_param: float = 1e-3, limit: int = 3000):
        self.n_components, self.n_neighbors, self.reg_param, self.limit = n_components, n_neighbors, reg_param, limit

    def fit(self, df: DataFrame) -> LocallyLinearEmbedding:
        self.ids, self.training = self._rows(df)
        if len(self.training) > self.limit:
            return self._sparse(self.training, self._near(df, self.training))
        x, places, parts = self.training, [], []
        for i, near in enumerate(self._near(df, x)):
            row = np.append(-self._weights(x[i], x[near]), 1.0)
            places.append(np.append(near, i))
            parts.append(np.outer(row, row))
        self._bottom(places, parts, len(x))
        return self

    def _sparse(self, x: np.ndarray, near: np.ndarray) -> LocallyLinearEmbedding:
        """The same vectors on products with I - W and its transpose, whose weights are made many rows at a time."""
        (n, k), w = near.shape, np.empty(near.shape)
        for at in range(0, n, 4096):
            gap = x[near[at : at + 4096]] - x[at : at + 4096, None]
            g = gap @ gap.transpose(0, 2, 1)
            g += np.eye(k) * (self.reg_param * np.maximum(np.trace(g, axis1=1, axis2=2), 1e-12))[:, None, None]
            some = np.linalg.solve(g, np.ones((len(g), k, 1)))[:, :, 0]
            w[at : at + 4096] = some / some.sum(1, keepdims=True)
        order = np.argsort(near.ravel(), kind="stable")
        holders, back = order // k, w.ravel()[order][:, None]
        seen, cuts = np.unique(near.ravel()[order], return_index=True)

        def times(v: np.ndarray) -> np.ndarray:
            u = v.copy()
            for j in range(k):
                u -= w[:, j, None] * v[near[:, j]]
            out = u.copy()
            out[seen] -= np.add.reduceat(back * u[holders], cuts, axis=0)
            return out

        _, vectors = krylov(times, n, self.n_components + 1, largest=False)
        self.embedding = vectors[:, 1:]
        return self


class LocalTangentSpaceAlignment(LocallyLinearEmbedding):
    """Alignment of each neighbourhood's tangent coordinates."""

    def fit(self, df: DataFrame) -> LocalTangentSpaceAlignment:
        self.ids, self.training = self._rows(df)
        x, k, parts = self.training, self.n_neighbors, []
        places = list(self._near(df, x))
        for near in places:
            gap = x[near] - x[near].mean(0)
            u = np.linalg.svd(gap, full_matrices=False)[0][:, : self.n_components]
            g = np.hstack([np.full((k, 1), 1 / np.sqrt(k)), u])
            parts.append(np.eye(k) - g @ g.T)
        self._bottom(places, parts, len(x))
        return self


class HessianEigenmaps(LocallyLinearEmbedding):
    """Null space of local Hessians, estimated in each neighbourhood's tangent coordinates."""

    def __init__(self, n_neighbors: int = 5, n_components: int = 2, reg_param: float = 1e-6, limit: int = 3000):
        super().__init__(n_components, n_neighbors, reg_param, limit)

    def fit(self, df: DataFrame) -> HessianEigenmaps:
        self.ids, self.training = self._rows(df)
        x, d = self.training, self.n_components
        pairs = [(a, b) for a in range(d) for b in range(a, d)]
        if self.n_neighbors <= d + len(pairs) - 1:
            raise ValueError("n_neighbors must exceed the number of Hessian terms")
        places, parts = list(self._near(df, x)), []
        for near in places:
            gap = x[near] - x[near].mean(0)
            u = np.linalg.svd(gap, full_matrices=False)[0][:, :d]
            terms = np.hstack([np.ones((len(near), 1)), u, np.stack([u[:, a] * u[:, b] for a, b in pairs], axis=1)])
            h = np.linalg.qr(terms)[0][:, d + 1 :]
            total = h.sum(0)
            h = h / np.where(np.abs(total) < 1e-4, 1.0, total)
            parts.append(h @ h.T)
        self._bottom(places, parts, len(x))
        return self
