"""Clustering. Centre-based methods sum over the distributed rows at each step. SNN, linkage, HDBSCAN and power iteration hold the table
of all pairs up to `limit` rows at most, and beyond make it in blocks that are let go again; the others on all pairs take `limit` at most.

Ties go to the smaller id or centre; clusters are numbered from 0 and noise is -1.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.blocks import Blocks, nearest_of
from quern.functions.numeric import collected, sums, top_eigen, with_numpy
from quern.operators.base import Clusterer, Estimator, samples
from quern.operators.preprocessing import squared

LIMIT = 20_000


def first_centres(df: DataFrame, k: int, init: str, seed: int, sample: int = 20_000) -> np.ndarray:
    """k rows: random ones, or by k-means++ (drawn in proportion to squared distance) over a hash sample of rows."""
    few = df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    (x,) = collected(few, ["features"], sample)
    rng = np.random.default_rng(seed)
    if init == "random":
        return x[rng.permutation(len(x))[:k]].copy()
    picked = [int(rng.integers(len(x)))]
    best = squared(x, x[picked])[:, 0]
    while len(picked) < min(k, len(x)):
        cdf = np.cumsum(best)
        at = int(np.searchsorted(cdf, rng.random() * cdf[-1])) if cdf[-1] > 0 else int(rng.integers(len(x)))
        picked.append(min(at, len(x) - 1))
        best = np.minimum(best, squared(x, x[picked[-1:]])[:, 0])
    return x[picked].copy()


class _Centres(Estimator, Clusterer):
    def predict(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "prediction", "int", ["features"], lambda x: squared(x, self.cluster_centers).argmin(1).astype(np.int32))


class KMeans(_Centres):
    """Lloyd's steps until the mean shift of centres is at most tol; an empty cluster keeps its centre."""

    def __init__(self, n_clusters: int = 8, init: str | np.ndarray = "k-means++", max_iter: int = 50, tol: float = 1e-4, random_seed: int = 0):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_seed = n_clusters, init, max_iter, tol, random_seed

    def fit(self, df: DataFrame) -> KMeans:
        rows = samples(df).select("id", "features").persist()
        c = np.array(self.init, float) if not isinstance(self.init, str) else first_centres(rows, self.n_clusters, self.init, self.random_seed)
        k, d = c.shape
        for self.n_iter in range(1, self.max_iter + 1):

            def part(x: np.ndarray, c: np.ndarray = c) -> np.ndarray:
                at = squared(x, c).argmin(1)
                out = np.zeros((k, d + 1))
                np.add.at(out, at, np.hstack([x, np.ones((len(x), 1))]))
                return out

            flat = sums(rows, ["features"], part).reshape(k, d + 1)
            new = np.where(flat[:, -1:] > 0, flat[:, :-1] / np.maximum(flat[:, -1:], 1), c)
            shift = np.sqrt(((new - c) ** 2).sum(1)).mean()
            c = new
            if shift <= self.tol:
                break
        self.cluster_centers = c
        rows.unpersist()
        return self


class MiniBatchKMeans(_Centres):
    """Centres move to a batch's means at a rate of one over the batches that each has seen; batches are hash classes of rows."""

    def __init__(self, n_clusters: int = 8, init: str = "k-means++", max_iter: int = 100, batch_size: int = 100, tol: float = 1e-4, random_seed: int = 0):
        self.n_clusters, self.init, self.max_iter, self.batch_size, self.tol, self.random_seed = n_clusters, init, max_iter, batch_size, tol, random_seed

    def partial_fit(self, batch: DataFrame) -> MiniBatchKMeans:
        """One batch; counts stay between calls."""
        batch = samples(batch)
        if not hasattr(self, "cluster_centers"):
            self.cluster_centers = first_centres(batch, self.n_clusters, self.init, self.random_seed)
            self.counters = np.zeros(len(self.cluster_centers))
        c = self.cluster_centers

        def part(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(c), c.shape[1] + 1))
            np.add.at(out, squared(x, c).argmin(1), np.hstack([x, np.ones((len(x), 1))]))
            return out

        flat = sums(batch, ["features"], part)
        if len(flat):
            self._move(flat.reshape(len(c), -1))
        return self

    def _move(self, flat: np.ndarray) -> None:
        for j in np.flatnonzero(flat[:, -1]):
            self.counters[j] += 1
            rate = 1 / self.counters[j]
            self.cluster_centers[j] = (1 - rate) * self.cluster_centers[j] + rate * flat[j, :-1] / flat[j, -1]

    def fit(self, df: DataFrame) -> MiniBatchKMeans:
        rows = samples(df).select("id", "features").persist()
        n = rows.count()
        batches = max(1, n // self.batch_size)
        rows = rows.withColumn("_class", F.pmod(F.xxhash64("id", F.lit(self.random_seed)), F.lit(batches)))
        self.cluster_centers = first_centres(rows, self.n_clusters, self.init, self.random_seed)
        self.counters = np.zeros(len(self.cluster_centers))
        steps = 0
        while steps < self.max_iter:
            before = self.cluster_centers.copy()
            for b in range(batches):
                self.partial_fit(rows.filter(F.col("_class") == b))
                steps += 1
                if steps >= self.max_iter:
                    break
            if np.sqrt(((before - self.cluster_centers) ** 2).sum(1)).mean() <= self.tol:
                break
        rows.unpersist()
        return self


class KMedoids(Estimator, Clusterer):
    """Assignment and least-sum medoids in turn; metric 'precomputed' takes distances by position."""

    def __init__(self, n_clusters: int = 8, metric: str = "euclidean", init: str = "k-means++", max_iter: int = 50, tol: float = 1e-4, random_seed: int = 0, limit: int = LIMIT):
        self.n_clusters, self.metric, self.init, self.max_iter, self.tol, self.random_seed, self.limit = n_clusters, metric, init, max_iter, tol, random_seed, limit

    def fit(self, df: DataFrame) -> KMedoids:
        (x,) = collected(samples(df), ["features"], self.limit)
        d = x if self.metric == "precomputed" else np.sqrt(squared(x, x))
        rng = np.random.default_rng(self.random_seed)
        ids = [int(rng.integers(len(d)))]
        while len(ids) < self.n_clusters:
            best = d[:, ids].min(1) ** 2
            ids.append(min(len(d) - 1, int(np.searchsorted(np.cumsum(best), rng.random() * best.sum()))) if self.init != "random" else int(rng.choice(np.setdiff1d(np.arange(len(d)), ids))))
        ids, last = np.array(ids), np.inf
        for _ in range(self.max_iter):
            own = d[:, ids].argmin(1)
            for k in range(self.n_clusters):
                rows = np.flatnonzero(own == k)
                if len(rows):
                    ids[k] = rows[d[np.ix_(rows, rows)].sum(0).argmin()]
            error = d[:, ids].min(1).mean()
            if abs(last - error) <= self.tol:
                break
            last = error
        self.medoid_ids, self.cluster_centers = ids, x[ids]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        ids, c = self.medoid_ids, self.cluster_centers
        of = (lambda x: x[:, ids]) if self.metric == "precomputed" else (lambda x: squared(x, c))
        return with_numpy(samples(df), "prediction", "int", ["features"], lambda x: of(x).argmin(1).astype(np.int32))


class GaussianMixture(Estimator, Clusterer):
    """EM with diagonal or full covariances, from k-means responsibilities; every step is one distributed sum of moments."""

    def __init__(self, n_clusters: int = 8, init: str = "k-means++", covariance_type: str = "diag", max_iter: int = 50, tol: float = 1e-4, reg_covar: float = 1e-6, random_seed: int = 0):
        self.n_clusters, self.init, self.covariance_type, self.max_iter, self.tol, self.reg_covar, self.random_seed = n_clusters, init, covariance_type, max_iter, tol, reg_covar, random_seed

    def _members(self, x: np.ndarray) -> np.ndarray:
        logs = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            gap = x - m
            if self.covariance_type == "diag":
                logs[:, k] = np.log(w) - 0.5 * (np.log(c).sum() + (gap**2 / c).sum(1))
            else:
                logs[:, k] = np.log(w) - 0.5 * (np.linalg.slogdet(c)[1] + (gap * np.linalg.solve(c, gap.T).T).sum(1))
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(1, keepdims=True)

    def fit(self, df: DataFrame) -> GaussianMixture:
        rows = samples(df).select("id", "features").persist()
        c = first_centres(rows, self.n_clusters, self.init, self.random_seed)
        d, k = c.shape[1], len(c)
        full = self.covariance_type == "full"
        members = lambda x: np.eye(k)[squared(x, c).argmin(1)]
        last = None
        for self.n_iter in range(self.max_iter):

            def part(x: np.ndarray, members=members) -> np.ndarray:
                r = members(x)
                second = np.einsum("nk,ni,nj->kij", r, x, x).reshape(k, -1) if full else r.T @ x**2
                return np.hstack([r.sum(0)[:, None], r.T @ x, second])

            flat = sums(rows, ["features"], part).reshape(k, -1)
            mass = np.maximum(flat[:, 0], 1e-12)
            self.weights, self.means = mass / mass.sum(), flat[:, 1 : d + 1] / mass[:, None]
            second = flat[:, d + 1 :] / mass[:, None]
            if full:
                self.covariances = second.reshape(k, d, d) - np.einsum("ki,kj->kij", self.means, self.means) + self.reg_covar * np.eye(d)
            else:
                self.covariances = np.maximum(second - self.means**2, 0) + self.reg_covar
            members = self._members
            now = np.hstack([self.weights[:, None], self.means])
            if last is not None and np.abs(now - last).max() <= self.tol:
                break
            last = now
        rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "prediction", "int", ["features"], lambda x: self._members(x).argmax(1).astype(np.int32))


def _scan(near: list[np.ndarray], min_samples: int) -> np.ndarray:
    """Density clusters by a scan in order: a cluster takes all neighbours of its core points that are not taken yet."""
    out, cluster = np.full(len(near), -2), 0
    for i in range(len(near)):
        if out[i] != -2:
            continue
        if len(near[i]) < min_samples:
            out[i] = -1
            continue
        todo = [i]
        out[i] = cluster
        while todo:
            at = todo.pop()
            if len(near[at]) < min_samples:
                continue
            for j in near[at]:
                if out[j] < 0:
                    out[j] = cluster
                    todo.append(j)
        cluster += 1
    return out


class DBSCAN(Estimator, Clusterer):
    """Density clusters: neighbours are closer than eps, core points have min_samples of them, themselves included.

    The scan goes by id and clusters are numbered in its order; a border point stays with the cluster that took it first.
    """

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean", limit: int = LIMIT):
        self.eps, self.min_samples, self.metric, self.limit = eps, min_samples, metric, limit

    def fit(self, df: DataFrame) -> DBSCAN:
        ids, x = collected(samples(df), ["id", "features"], self.limit)
        near: list[np.ndarray] = []
        for at in range(0, len(x), 512):
            d = x[at : at + 512] if self.metric == "precomputed" else np.sqrt(squared(x[at : at + 512], x))
            near += [np.flatnonzero(row < self.eps) for row in d]
        self.core_sample_ids = ids[[len(n) >= self.min_samples for n in near]]
        self.labels = dict(zip(ids.tolist(), _scan(near, self.min_samples).tolist(), strict=True))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        known = self.labels
        return with_numpy(df, "prediction", "int", ["id"], lambda i: np.array([known.get(v, -1) for v in i.tolist()], np.int32))


def _sharing(near: np.ndarray, n: int, eps: float):
    """Rows that share more than eps neighbours with row i, from every row's neighbours."""
    order = np.argsort(near.ravel(), kind="stable")
    holders, cuts = order // near.shape[1], np.searchsorted(near.ravel()[order], np.arange(n + 1))

    def over(i: int) -> np.ndarray:
        if eps < 0:
            return np.arange(n)
        rows, shared = np.unique(np.concatenate([holders[cuts[c] : cuts[c + 1]] for c in near[i].tolist()]), return_counts=True)
        return rows[shared > eps]

    return over


def _linked(n: int, links: Iterable[tuple[int, int]]) -> np.ndarray:
    """The smallest row of each row's set after the links."""
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
    for i in range(n):
        up[i] = up[up[i]]
    return np.array(up, np.int64)


class SNN(DBSCAN):
    """Density clusters on numbers of shared nearest neighbours above eps.

    Core rows that share enough are linked, clusters are what links reach, in order of their first core row, and a border row goes
    to the first cluster that has a core row near it: what the scan gives. Tables of all pairs exist in blocks alone.
    """

    def __init__(self, n_neighbors: int = 10, eps: float = 5, min_samples: int = 5, metric: str = "euclidean", limit: int = LIMIT):
        self.n_neighbors, self.eps, self.min_samples, self.metric, self.limit = n_neighbors, eps, min_samples, metric, limit

    def fit(self, df: DataFrame) -> SNN:
        ids, x = collected(samples(df), ["id", "features"], self.limit if self.metric == "precomputed" else 0)
        blocks, n, k, eps, given = Blocks(df.sparkSession, x), len(x), self.n_neighbors, self.eps, self.metric == "precomputed"
        (near,) = blocks.each(lambda x, lo, hi: (nearest_of(x[lo:hi] if given else squared(x[lo:hi], x), k),))

        parts = n, -(-n // (4 * max(1, df.sparkSession.sparkContext.defaultParallelism)))  # a task turns the lists round once

        def count(x: np.ndarray, lo: int, hi: int, near: np.ndarray) -> tuple:
            over = _sharing(near, n, eps)
            return (np.array([len(over(i)) for i in range(lo, hi)]),)

        core = blocks.each(count, near, parts=parts)[0] >= self.min_samples

        def link(x: np.ndarray, lo: int, hi: int, near: np.ndarray, core: np.ndarray) -> tuple:
            over = _sharing(near, n, eps)
            found = _linked(n, ((i, j) for i in range(lo, hi) if core[i] for j in over(i).tolist() if core[j]))
            at = np.flatnonzero(found != np.arange(n))
            return (np.stack([at, found[at]], axis=1),)

        found = _linked(n, map(tuple, blocks.each(link, near, core, parts=parts)[0].tolist()))
        heads = np.unique(found[core])
        cluster = np.where(core, np.searchsorted(heads, found), -1)

        def border(x: np.ndarray, lo: int, hi: int, near: np.ndarray, cluster: np.ndarray) -> tuple:
            over, out = _sharing(near, n, eps), cluster[lo:hi].copy()
            for i in np.flatnonzero(out < 0).tolist():
                around = cluster[over(lo + i)]
                out[i] = around[around >= 0].min(initial=n)
            return (np.where(out == n, -1, out),)

        (cluster,) = blocks.each(border, near, cluster, parts=parts)
        blocks.close()
        self.core_sample_ids = ids[core]
        self.labels = dict(zip(ids.tolist(), cluster.tolist(), strict=True))
        return self


def spanning_tree(n: int, row) -> list[tuple[float, int, int]]:
    """Prim's minimum spanning tree of n rows, row(i) being the distances of one: (weight, a, b) by weight."""
    best, frm, out, inside = row(0).copy(), np.zeros(n, int), [], np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        at = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[at]), int(frm[at]), at))
        inside[at] = True
        d = row(at)
        closer = d < best
        best[closer], frm[closer] = d[closer], at
    return sorted(out)


def dendrogram(edges: list[tuple[float, int, int]], n: int) -> list[tuple[int, int, float, int]]:
    """Merges (x, y, weight, size); the k-th makes cluster n + k."""
    up, size, out = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), []

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for k, (weight, a, b) in enumerate(edges):
        x, y = root(a), root(b)
        up[x] = up[y] = n + k
        size[n + k] = size[x] + size[y]
        out.append((min(x, y), max(x, y), weight, size[n + k]))
    return out


class _Tree(DBSCAN):
    def _distances(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray, object]:
        """ids, rows, and the distances of row i to all: from a table up to `limit` rows, beyond made as they are asked for."""
        ids, x = collected(samples(df), ["id", "features"], self.limit if self.metric == "precomputed" else 0)
        if self.metric == "precomputed" or len(x) <= self.limit:
            return ids, x, (x if self.metric == "precomputed" else np.sqrt(squared(x, x))).__getitem__
        sizes = (x * x).sum(1)
        return ids, x, lambda i: np.sqrt(np.maximum(sizes + sizes[i] - 2 * (x @ x[i]), 0.0))

    def _keep(self, ids: np.ndarray, found: np.ndarray) -> None:
        """Clusters numbered by their first row."""
        names: dict[int, int] = {}
        self.labels = {int(i): -1 if c < 0 else names.setdefault(int(c), len(names)) for i, c in zip(ids, found, strict=True)}


class SingleLinkage(_Tree):
    """The minimum spanning tree's merges, cut at n_clusters."""

    def __init__(self, n_clusters: int = 2, metric: str = "euclidean", limit: int = 5000):
        self.n_clusters, self.metric, self.limit = n_clusters, metric, limit

    def fit(self, df: DataFrame) -> SingleLinkage:
        ids, _, row = self._distances(df)
        n = len(ids)
        self.hierarchy = dendrogram(spanning_tree(n, row), n)
        up = list(range(2 * n))
        for k, (x, y, _, _) in enumerate(self.hierarchy[: max(0, n - self.n_clusters)]):
            up[x] = up[y] = n + k
        found = []
        for v in range(n):
            while up[v] != v:
                v = up[v]
            found.append(v)
        self._keep(ids, np.array(found))
        return self


class HDBSCAN(_Tree):
    """Mutual reachability (core distance at place min_samples + 1), single linkage, condensed tree, most stable clusters."""

    def __init__(self, min_samples: int = 10, min_cluster_size: int | None = None, metric: str = "euclidean", limit: int = 5000):
        self.min_samples, self.min_cluster_size, self.metric, self.limit = min_samples, min_cluster_size, metric, limit

    def fit(self, df: DataFrame) -> HDBSCAN:
        ids, x, row = self._distances(df)
        n, least = len(ids), self.min_cluster_size or self.min_samples
        place, given = min(self.min_samples + 1, n - 1), self.metric == "precomputed"
        if given or n <= self.limit:
            core = np.array([np.partition(row(i), place)[place] for i in range(n)])
        else:
            blocks = Blocks(df.sparkSession, x)
            (core,) = blocks.each(lambda x, lo, hi: (np.sqrt(np.partition(squared(x[lo:hi], x), place, axis=1)[:, place]),))
            blocks.close()
        merges = dendrogram(spanning_tree(n, lambda i: np.maximum(row(i), np.maximum(core[i], core))), n)
        kids = {n + k: (x, y, w) for k, (x, y, w, _) in enumerate(merges)}
        size = lambda v: 1 if v < n else merges[v - n][3]

        def leaves(v: int) -> list[int]:
            out, todo = [], [v]
            while todo:
                at = todo.pop()
                if at < n:
                    out.append(at)
                else:
                    todo += kids[at][:2]
            return out

        # The condensed tree: clusters with the density at which each is born, and what falls out of them.
        born, falls, below, node = {0: 0.0}, {0: []}, {0: []}, [(2 * n - 2, 0)]
        while node:
            v, c = node.pop()
            if v < n:
                continue
            x, y, w = kids[v]
            density = 1 / w if w > 0 else 1e12
            big = [u for u in (x, y) if size(u) >= least]
            for u in (x, y):
                if len(big) == 2:
                    new = len(born)
                    born[new], falls[new], below[new] = density, [], []
                    below[c].append(new)
                    falls[c].append((density, size(u), []))
                    node.append((u, new))
                elif u in big:
                    node.append((u, c))
                else:
                    falls[c].append((density, size(u), leaves(u)))
        worth = {c: sum((lam - born[c]) * m for lam, m, _ in falls[c]) for c in born}
        chosen: set[int] = set()
        for c in sorted(born, reverse=True):
            inner = sum(worth[k] for k in below[c])
            if c and worth[c] >= inner:
                chosen.add(c)
                todo = list(below[c])
                while todo:
                    k = todo.pop()
                    chosen.discard(k)
                    todo += below[k]
            elif c:
                worth[c] = inner
        found = np.full(n, -1)
        for c in chosen:
            todo = [c]
            while todo:
                k = todo.pop()
                todo += below[k]
                for _, _, rows in falls[k]:
                    found[rows] = c
        self._keep(ids, found)
        return self


class MeanShift(_Centres):
    """Rows move to the mean of what lies within bandwidth; modes within bandwidth of one another merge, in order."""

    def __init__(self, bandwidth: float = 1.0, max_iter: int = 500, tol: float = 1e-4, limit: int = LIMIT):
        self.bandwidth, self.max_iter, self.tol, self.limit = bandwidth, max_iter, tol, limit

    def fit(self, df: DataFrame) -> MeanShift:
        (x,) = collected(samples(df), ["features"], self.limit)
        z = x.copy()
        for _ in range(self.max_iter):
            new = np.empty_like(z)
            for at in range(0, len(z), 512):
                near = (np.sqrt(squared(z[at : at + 512], x)) <= self.bandwidth).astype(float)
                new[at : at + 512] = near @ x / np.maximum(near.sum(1, keepdims=True), 1)
            moved = np.abs(new - z).sum(1).max()
            z = new
            if moved <= self.tol:
                break
        modes: list[np.ndarray] = []
        for row in z:
            if not modes or np.sqrt(((np.array(modes) - row) ** 2).sum(1)).min() > self.bandwidth:
                modes.append(row)
        self.cluster_centers = np.array(modes)
        return self


class _Affinity(_Tree):
    def _matrix(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, x = collected(samples(df), ["id", "features"], self.limit)
        a = x.copy() if self.affinity == "precomputed" else np.exp(-(self.gamma or 1 / x.shape[1]) * squared(x, x))
        np.fill_diagonal(a, 0)
        return ids, a

    def _kmeans(self, ids: np.ndarray, z: np.ndarray, df: DataFrame, max_iter: int) -> None:
        rows = df.sparkSession.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, z, strict=True)], "id long, features array<double>")
        model = KMeans(self.n_clusters, self.init, max_iter, 1e-4, self.random_seed).fit(rows)
        self.labels = dict(zip(ids.tolist(), squared(z, model.cluster_centers).argmin(1).tolist(), strict=True))


class PowerIteration(_Affinity):
    """A power iteration of D^-1 A, stopped by its acceleration, and k-means on its one dimension."""

    def __init__(self, n_clusters: int = 8, affinity: str = "rbf", gamma: float | None = None, init: str = "k-means++", max_iter: int = 1000, tol: float = 1e-8, eps: float = 1e-5, random_seed: int = 0, limit: int = 5000):
        self.n_clusters, self.affinity, self.gamma, self.init, self.max_iter, self.tol, self.eps, self.random_seed, self.limit = n_clusters, affinity, gamma, init, max_iter, tol, eps, random_seed, limit

    def fit(self, df: DataFrame) -> PowerIteration:
        given = self.affinity == "precomputed"
        ids, x = collected(samples(df), ["id", "features"], self.limit if given else 0)
        if given or len(x) <= self.limit:
            ids, a = self._matrix(df)
            times = a.__matmul__
        else:
            blocks, gamma = Blocks(df.sparkSession, x), self.gamma or 1 / x.shape[1]

            def rows(x: np.ndarray, lo: int, hi: int, v: np.ndarray) -> tuple:
                a = np.exp(-gamma * squared(x[lo:hi], x))
                a[np.arange(hi - lo), np.arange(lo, hi)] = 0
                return (a @ v,)

            times = lambda v: blocks.each(rows, v)[0]
        degree = np.maximum(times(np.ones(len(x))), 1e-300)
        v, error = degree / degree.sum(), np.ones(len(x))
        for self.n_iter in range(1, self.max_iter + 1):
            new = times(v) / degree
            new /= np.abs(new).sum()
            gap = np.abs(new - v)
            done = np.abs(gap - error).max() <= self.tol / len(x)
            v, error = new, gap
            if done:
                break
        self.embedded_line = (v - v.min()) / (v.max() - v.min() or 1.0)
        self._kmeans(ids, self.embedded_line[:, None], df, 50)
        return self


class SpectralClustering(_Affinity):
    """Top eigenvectors of D^-1/2 A D^-1/2 with rows of length one, and k-means; affinity 'precomputed' is honoured."""

    def __init__(self, n_clusters: int = 2, affinity: str = "rbf", gamma: float | None = None, init: str = "k-means++", max_iter: int = 10, tol: float = 1e-8, random_seed: int = 0, limit: int = 5000):
        self.n_clusters, self.affinity, self.gamma, self.init, self.max_iter, self.tol, self.random_seed, self.limit = n_clusters, affinity, gamma, init, max_iter, tol, random_seed, limit

    def fit(self, df: DataFrame) -> SpectralClustering:
        ids, a = self._matrix(df)
        scale = 1 / np.sqrt(np.maximum(a.sum(1), 1e-300))
        _, v = top_eigen(a * scale[:, None] * scale, self.n_clusters)
        size = np.sqrt((v * v).sum(1, keepdims=True))
        self.embedding = v / np.where(size == 0, 1, size)
        self._kmeans(ids, self.embedding, df, self.max_iter)
        return self
