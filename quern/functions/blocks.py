"""Work on all pairs of rows, in blocks: tasks share the rows, and each block of the n x n table is made, used and let go in one of them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.functions.numeric import CELLS, matrix, upright, with_numpy


class Blocks:
    """Rows x, sent to the tasks once. `of(x, lo, hi, *more)` gives a tuple of arrays for rows lo to hi against all rows."""

    def __init__(self, spark: SparkSession, x: np.ndarray, cells: int = CELLS):
        self.spark, self.n, self.sent = spark, len(x), spark.sparkContext.broadcast(x)
        self.step = max(1, min(cells // max(1, self.n), self.n))

    def _run(self, of: Callable[..., tuple], more: tuple, add: bool, parts: tuple[int, int] | None = None) -> list[tuple]:
        n, step = parts or (self.n, self.step)
        sent, rest = self.sent, self.spark.sparkContext.broadcast(more)
        count = -(-n // step)
        tasks = max(1, min(count, 4 * self.spark.sparkContext.defaultParallelism))
        schema = pa.schema([("at", pa.int64()), ("out", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = lambda at, out: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pickle.dumps(out)], pa.binary())], schema=schema)
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    total = None
                    for at in range(task, count, tasks):
                        out = of(sent.value, at * step, min(n, (at + 1) * step), *rest.value)
                        if add:
                            total = out if total is None else tuple(a + b for a, b in zip(total, out, strict=True))
                        else:
                            yield row(at, out)
                    if total is not None:
                        yield row(task, total)

        rows = self.spark.range(0, tasks, 1, tasks).mapInArrow(run, "at long, out binary").toArrow().sort_by("at")
        rest.destroy()
        return [pickle.loads(b.as_py()) for b in rows["out"]]

    def each(self, of: Callable[..., tuple], *more, parts: tuple[int, int] | None = None) -> tuple:
        """The arrays of all blocks, one after another in the order of rows; parts: other numbers to deal than rows, and how many at once."""
        return tuple(np.concatenate(part) for part in zip(*self._run(of, more, False, parts), strict=True))

    def total(self, of: Callable[..., tuple], *more) -> tuple:
        """The sums of the arrays over all blocks."""
        return tuple(sum(part) for part in zip(*self._run(of, more, True), strict=True))

    def paired(self, of: Callable[..., tuple[np.ndarray, float]], v: np.ndarray, *more) -> tuple[np.ndarray, float]:
        """T v and a total over all pairs, where of(x, one, two, *more) gives a symmetric T's tile for two slices of rows, and a number.

        A tile serves both of its sides, unless the tasks' results would be too wide for the driver together.
        """
        n, side = self.n, 512
        tiles, least = -(-n // side), self.spark.sparkContext.defaultParallelism
        tasks = min(4 * least, tiles, (1 << 24) // max(1, v.size))
        cut = lambda k: slice(k * side, min(n, (k + 1) * side))

        def whole(x: np.ndarray, lo: int, hi: int, v: np.ndarray, *more) -> tuple:  # lo to hi is one of the cuts
            out, total = np.zeros((hi - lo, v.shape[1])), 0.0
            for k in range(tiles):
                t, number = of(x, slice(lo, hi), cut(k), *more)
                out += t @ v[cut(k)]
                total += number
            return out, np.array([total])

        def half(x: np.ndarray, lo: int, hi: int, v: np.ndarray, *more) -> tuple:
            out, total = np.zeros(v.shape), 0.0
            for i in range(tiles):
                if min(i % (2 * tasks), 2 * tasks - 1 - i % (2 * tasks)) != lo:  # long and short strips to each task
                    continue
                for k in range(i, tiles):
                    t, number = of(x, cut(i), cut(k), *more)
                    out[cut(i)] += t @ v[cut(k)]
                    if k > i:
                        out[cut(k)] += t.T @ v[cut(i)]
                    total += number if k == i else 2 * number
            return out, np.array([total])

        if tasks < min(least, tiles):
            out, total = self.each(whole, v, *more, parts=(n, side))
            return out, float(total.sum())
        parts = self._run(half, (v, *more), False, (tasks, 1))
        return sum(p[0] for p in parts), float(sum(p[1][0] for p in parts))

    def close(self) -> None:
        self.sent.destroy()


def nearest_of(d: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k smallest, ties to the first: what a stable sort gives."""
    k = min(k, d.shape[1])
    last = np.partition(d, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(d), k), np.int64)
    for r, (row, v) in enumerate(zip(d, last, strict=True)):
        at = np.flatnonzero(row <= v)
        out[r] = at[np.argsort(row[at], kind="stable")[:k]]
    return out


def products(df: DataFrame, v: np.ndarray, order: str = "id") -> np.ndarray:
    """Every row's features times v, in the order of `order`; the features stay with the tasks."""
    rows = with_numpy(df.select(order, "features"), "features", "array<double>", ["features"], lambda x: x @ v).toArrow().sort_by(order)
    return matrix(rows["features"].combine_chunks())


def solved(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tol: float = 1e-12, max_iter: int = 1000, eased: Callable[[np.ndarray], np.ndarray] = np.copy) -> np.ndarray:
    """A^-1 b by conjugate gradients, a column each, for a positive definite A known by its products with columns; `eased` is near A^-1."""
    x, r = np.zeros_like(b), b.copy()
    p = eased(r)
    rz = (r * p).sum(0)
    goal = tol * tol * np.maximum(rz, 1e-300)
    for _ in range(max_iter):
        if (rz <= goal).all():
            return x
        ap = apply(p)
        a = np.where(rz > goal, rz / np.maximum((p * ap).sum(0), 1e-300), 0.0)
        x, r = x + a * p, r - a * ap
        z = eased(r)
        new = (r * z).sum(0)
        p, rz = z + np.where(rz > goal, new / np.maximum(rz, 1e-300), 0.0) * p, new
    raise ValueError(f"conjugate gradients have not settled after {max_iter} steps; a larger reg_param helps")


def subspace(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, k: int, tol: float = 1e-8, most: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """As top_eigen, of a symmetric matrix without large negative eigenvalues, from columns near its top ones; None if they have not settled after `most` products."""
    q = np.linalg.qr(start)[0]
    for _ in range(most):
        new = apply(q)
        values, s = np.linalg.eigh((h := q.T @ new) / 2 + h.T / 2)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        found = q @ s
        if np.sqrt(((new @ s - found * values) ** 2).sum(0)).max() <= tol * max(np.abs(values).max(), 1e-300):
            return values, upright(found)
        q = np.linalg.qr(new)[0]
    return None


def krylov(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, largest: bool = True, block: int = 0, most: int = 400, tol: float = 1e-8, max_steps: int = 20_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """As top_eigen, of a symmetric matrix known by its products with columns: block Lanczos, all columns kept orthogonal, restarted from its best vectors."""
    block = min(n, block or k + 3)
    most = min(n, max(most, 4 * (k + block)))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, block)))[0]
    store = np.empty((n, min(n, most + block)), order="F")
    basis, h, steps = store[:, :0], np.empty((0, 0)), 0
    while True:
        new = apply(q)
        steps += q.shape[1]
        m = basis.shape[1]
        store[:, m : m + q.shape[1]] = q
        basis = store[:, : m + q.shape[1]]
        side = basis.T @ new
        grown = np.zeros((m + q.shape[1],) * 2)
        grown[:m, :m], grown[:, m:], grown[m:, :] = h, side, side.T
        h = grown
        h[m:, m:] = (h[m:, m:] + h[m:, m:].T) / 2
        rest = new - basis @ side
        rest -= basis @ (basis.T @ rest)
        full = basis.shape[1] >= n
        if not full:
            room = min(q.shape[1], n - basis.shape[1])
            nxt, r = np.linalg.qr(rest)
            scale = np.abs(h).max() or 1.0
            dead = np.abs(np.diag(r)) < 1e-13 * scale
            if dead.any():  # the space is closed: go on from elsewhere
                nxt[:, dead] = np.random.default_rng(seed + steps).normal(size=(n, int(dead.sum())))
            for _ in range(2 if dead.any() else 1):
                nxt -= basis @ (basis.T @ nxt)
                nxt = np.linalg.qr(nxt)[0]
            couple, nxt = nxt.T @ rest, nxt[:, :room]
        check = full or basis.shape[1] + block > most or (basis.shape[1] // block) % 5 == 0 or basis.shape[1] < 10 * block
        if check and basis.shape[1] >= k:
            values, s = np.linalg.eigh(h)
            order = np.argsort(-values if largest else values)
            values, s = values[order], s[:, order]
            left = 0.0 if full else np.sqrt(((couple @ s[-q.shape[1] :, :k]) ** 2).sum(0)).max()
            if full or left <= tol * max(np.abs(values).max(), 1e-300):
                return values[:k], upright(basis @ s[:, :k])
            if steps > max_steps:
                raise ValueError(f"eigenvectors have not settled after {steps} products")
            if basis.shape[1] + block > most:
                hold = min(most // 2, max(k + 2 * block, most // 4))
                for low in range(0, n, 4096):  # in place
                    store[low : low + 4096, :hold] = basis[low : low + 4096] @ s[:, :hold]
                basis, h = store[:, :hold], np.diag(values[:hold])
        q = nxt


def scatter_products(df: DataFrame, means: np.ndarray, classes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """W v, where W is the scatter of the features around the means of their rows' classes; W is never made."""
    schema = pa.schema([("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column(0)) - means[np.searchsorted(classes, matrix(part.column(1)))]
                total += x.T @ (x @ v)
        for low in range(0, len(total), rows):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((low, total[low : low + rows]))], pa.binary())], schema=schema)

    step, rows = max(1, CELLS // len(v)), max(1, CELLS // v.shape[1])
    out = np.zeros(v.shape)
    for part in df.select("features", "label").mapInArrow(run, "part binary").toArrow()["part"]:
        low, some = pickle.loads(part.as_py())
        out[low : low + len(some)] += some
    return out


def preconditioned(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, shift: float, rank: int = 0, tol: float = 1e-9, max_iter: int = 2000, seed: int = 0) -> np.ndarray:
    """(A + shift)^-1 b by conjugate gradients, a column each, for a symmetric A without negative eigenvalues known by its products.

    A Nystroem preconditioner takes out A's largest `rank` eigenvalues (0: of as many columns as ten million numbers make), from products
    with random columns, 96 at a time.
    """
    n = len(b)
    rank = min(n, rank or max(256, 5 * CELLS // n))
    drawn = lambda at: np.random.default_rng((seed, at)).normal(size=(n, min(96, rank - at)))
    y = np.empty((n, rank))
    for at in range(0, rank, 96):
        y[:, at : at + 96] = apply(drawn(at))
    more, step = 0.0, 1e-15 * np.linalg.norm(y) / np.sqrt(n) + 1e-300
    while True:  # a little more on the diagonal until the factor exists
        for at in range(0, rank, 96):
            y[:, at : at + 96] += (step - more) * drawn(at)
        more, step = step, step * 100
        inner = np.empty((rank, rank))
        for at in range(0, rank, 96):
            inner[at : at + 96] = drawn(at).T @ y
        try:
            inner = np.linalg.inv(np.linalg.cholesky(inner)).T
            break
        except np.linalg.LinAlgError:
            continue
    for low in range(0, n, 1024):  # in place: y y' is the approximation
        y[low : low + 1024] = y[low : low + 1024] @ inner
    inner = y.T @ y
    inner.flat[:: rank + 1] += shift
    inner = np.linalg.inv(inner)

    def eased(r: np.ndarray) -> np.ndarray:
        return r - y @ (inner @ (y.T @ r))

    x, r = np.zeros_like(b), b.copy()
    z = eased(r)
    p, rz = z.copy(), (r * z).sum(0)
    goal = tol * tol * np.maximum(rz, 1e-300)
    for _ in range(max_iter):
        if (rz <= goal).all():
            return x
        ap = apply(p) + shift * p
        a = np.where(rz > goal, rz / np.maximum((p * ap).sum(0), 1e-300), 0.0)
        x, r = x + a * p, r - a * ap
        z = eased(r)
        new = (r * z).sum(0)
        p, rz = z + np.where(rz > goal, new / np.maximum(rz, 1e-300), 0.0) * p, new
    raise ValueError(f"conjugate gradients have not settled after {max_iter} steps; a larger reg_param helps")
