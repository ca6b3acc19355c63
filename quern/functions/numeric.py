"""Bridges between DataFrames and numpy: distributed sums of array statistics, and columns computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Numbers that a task makes at once of a table of rows against rows.
CELLS = 1 << 21


def matrix(column: pa.Array) -> np.ndarray:
    """A numeric or list column as a numpy array; lists of equal length become rows."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def sums(df: DataFrame, columns: Sequence[str], of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all batches of `of(*arrays)`, a flat array of fixed length.

    Each partition adds up its own; what is shuffled is one number for each element and partition, pre-aggregated.
    """
    names = list(columns)
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = np.asarray(of(*(matrix(batch.column(k)) for k in range(len(names)))), float).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

    rows = df.select(*names).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(rows.num_rows)
    out[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out


def with_numpy(df: DataFrame, name: str, kind: str, columns: Sequence[str], of: Callable[..., np.ndarray]) -> DataFrame:
    """df with a column of DDL type `kind` that `of(*arrays)` gives for each Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    left = [c for c in df.columns if c != name]
    field = StructType.fromDDL(f"x {kind}")[0].dataType
    target = to_arrow_type(field)
    schema = StructType([df.schema[c] for c in left]).add(name, field)
    at = [df.columns.index(c) for c in columns]
    keep = [df.columns.index(c) for c in left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, step = 0, 256  # wide results are made a few rows at a time
            while done < batch.num_rows or not done:
                part = batch.slice(done, step)
                if part.num_rows:
                    out = of(*(matrix(part.column(k)) for k in at))
                    wide = out.shape[1] if getattr(out, "ndim", 1) > 1 else 1
                    out = pa.array(list(out) if getattr(out, "ndim", 1) > 1 else out, target)
                    done, step = done + part.num_rows, max(1, CELLS // max(1, wide))
                else:
                    out, done = pa.array([], target), 1
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), out], names=[*left, name])

    return df.mapInArrow(run, schema)


def collected(df: DataFrame, columns: Sequence[str], limit: int, order: str = "id") -> list[np.ndarray]:
    """Columns as arrays on the driver, in the order of `order`; an error beyond `limit` rows (0: none), for methods that need all pairs of rows."""
    rows = df.select(*dict.fromkeys([order, *columns]))
    rows = (rows.limit(limit + 1) if limit else rows).toArrow()
    if limit and rows.num_rows > limit:
        raise ValueError(f"this method holds all pairs of rows; it takes {limit} at most, or sample first")
    rows = rows.sort_by(order)
    return [matrix(rows[c].combine_chunks()) for c in columns]


def width(df: DataFrame, column: str = "features") -> int:
    """The number of features; nulls among them are an error."""
    row = df.select(F.size(column)).first()
    if row is None:
        raise ValueError("no rows to learn from")
    return row[0]


def gram(df: DataFrame, target: str | None = None, bias: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X, X'Y and the number of rows; bias adds a constant feature."""
    d = width(df) + (bias is not None)

    def of(x: np.ndarray, *y: np.ndarray) -> np.ndarray:
        if bias is not None:
            x = np.hstack([x, np.full((len(x), 1), bias)])
        t = y[0].reshape(len(x), -1) if y else np.zeros((len(x), 0))
        return np.concatenate([(x.T @ x).ravel(), (x.T @ t).ravel(), (t.T @ t).ravel(), [len(x)]])

    flat = sums(df, ["features", *([target] if target else [])], of)
    m = int(round((-d + np.sqrt(d * d + 4 * (len(flat) - 1 - d * d))) / 2)) if target else 0
    return flat[: d * d].reshape(d, d), flat[d * d : d * d + d * m].reshape(d, m), flat[-1]


def moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance (n - 1) and number of rows; two passes, so that far means do not cancel."""
    d = width(df)
    flat = sums(df, ["features"], lambda x: np.append(x.sum(0), len(x)))
    mean, n = flat[:d] / flat[d], flat[d]
    scatter = sums(df, ["features"], lambda x: ((x - mean).T @ (x - mean)).ravel()).reshape(d, d)
    return mean, scatter / max(n - 1, 1), n


def upright(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive, as an eigenvector's sign means nothing."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def top_eigen(a: np.ndarray, k: int, largest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The k largest or smallest eigenvalues of a symmetric matrix, and their vectors as columns."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    pick = slice(None, -k - 1, -1) if largest else slice(0, k)
    return values[pick], upright(vectors[:, pick])


def general_eigen(a: np.ndarray, b: np.ndarray, k: int, largest: bool = True, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The same for a v = w b v, by b's Cholesky factor."""
    lower = np.linalg.cholesky((b + b.T) / 2 + ridge * np.eye(len(b)))
    inner = np.linalg.solve(lower, np.linalg.solve(lower, (a + a.T) / 2).T)
    values, vectors = top_eigen(inner, k, largest)
    return values, upright(np.linalg.solve(lower.T, vectors))


def lbfgs(of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int = 1000, tol: float = 1e-4, memory: int = 10, lower: float | None = None) -> np.ndarray:
    """Minimises of(w) -> (loss, gradient) by L-BFGS with backtracking; `lower` projects onto w >= lower."""
    clip = (lambda w: np.maximum(w, lower)) if lower is not None else (lambda w: w)
    w = clip(start.astype(float))
    loss, g = of(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        free = np.ones(len(w), bool) if lower is None else ~((w <= lower) & (g > 0))
        if np.abs(g[free]).max(initial=0.0) <= tol:
            break
        q, coefficients = np.where(free, g, 0.0), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            coefficients.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(coefficients), strict=True):
            q = q + s * (a - y @ q / (s @ y))
        step = -np.where(free, q, 0.0)
        if step @ g >= 0:
            pairs, step = [], -np.where(free, g, 0.0)
        rate = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(30):
            new = clip(w + rate * step)
            new_loss, new_g = of(new)
            if new_loss <= loss + 1e-4 * g @ (new - w):
                break
            rate /= 2
        else:
            break
        s, y = new - w, new_g - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(loss - new_loss) <= 1e-12 * max(1.0, abs(loss))
        w, loss, g = new, new_loss, new_g
        if done:
            break
    return w
