"""Pairwise metrics and kernels of a stated query set against all rows, as long tables (i, j, value).

Rows are packed into blocks, and every block of one side meets every block of the other in some task, which makes their
values in numpy, component by component. Both sides are DataFrames (id, features) of any size. Without y the pairs are of
x with itself. A value is null where features are null, hold null or differ in length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


class Side:
    """A block's ids and features; short rows are filled up with zeros, rows that hold null are not whole."""

    def __init__(self, packed: bytes):
        rows = pa.ipc.open_stream(packed).read_all()
        self.ids, listed = rows["id"].combine_chunks(), rows["features"].to_pylist()
        self.whole = np.array([r is not None and None not in r for r in listed])
        self.size = np.array([len(r) if r is not None else 0 for r in listed])
        self.x = np.zeros((len(listed), int(self.size.max(initial=0))))
        for k in np.flatnonzero(self.whole):
            self.x[k, : self.size[k]] = listed[k]
        self.id_values = self.ids.to_numpy(zero_copy_only=False)

    def sides(self, other: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Columns of this side and rows of the other, a component each."""
        for k in range(min(self.x.shape[1], other.x.shape[1])):
            yield self.x[:, k, None], other.x[None, :, k]

    def total(self, other: Side, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of of(u, v) over components, first to last."""
        out = np.zeros((len(self.x), len(other.x)))
        for u, v in self.sides(other):
            out += of(u, v)
        return out

    def norms(self) -> np.ndarray:
        """Euclidean norms, one where zero."""
        out = np.zeros(len(self.x))
        for k in range(self.x.shape[1]):
            out += self.x[:, k] * self.x[:, k]
        return np.where(out == 0, 1.0, np.sqrt(out))


def packed(df: DataFrame, name: str) -> DataFrame:
    """Blocks of df's id and features as binaries, dealt over all tasks."""
    kinds = df.select("id", F.col("features").cast("array<double>").alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part, sink = batch.slice(at, BLOCK), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return kinds.mapInArrow(run, f"{name} binary")


def pairs(x: DataFrame, y: DataFrame | None, value: Callable[[Side, Side], np.ndarray], name: str) -> DataFrame:
    """i, j and `value` of every row of x with every row of y."""
    y = x if y is None else y
    kinds = f"i {x.schema['id'].dataType.simpleString()}, j {y.schema['id'].dataType.simpleString()}, {name} double"
    tasks = max(2, x.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = Side(one), Side(two)
                found = value(a, b)
                off = ~(a.whole[:, None] & b.whole & (a.size[:, None] == b.size))
                at, to = np.divmod(np.arange(found.size), len(b.ids))
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(at)), b.ids.take(pa.array(to)), pa.array(found.ravel(), mask=off.ravel() if off.any() else None)], names=["i", "j", name])

    return packed(x, "a").repartition(tasks).crossJoin(packed(y, "b").repartition(2)).mapInArrow(run, kinds)


def _sqdist(a: Side, b: Side) -> np.ndarray:
    return a.total(b, lambda u, v: (u - v) * (u - v))


def _dot(a: Side, b: Side) -> np.ndarray:
    return a.total(b, lambda u, v: u * v)


def _gamma(gamma: float | None, a: Side) -> np.ndarray | float:
    return float(gamma) if gamma is not None else (1.0 / np.maximum(a.size, 1))[:, None]


def euclidean_distance(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    return pairs(x, y, lambda a, b: np.sqrt(_sqdist(a, b)), "distance")


def manhattan_distance(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    return pairs(x, y, lambda a, b: a.total(b, lambda u, v: np.abs(u - v)), "distance")


def squared_error(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    return pairs(x, y, _sqdist, "distance")


def _cosine(a: Side, b: Side) -> np.ndarray:
    return _dot(a, b) / (a.norms()[:, None] * b.norms())


def cosine_similarity(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """A zero norm counts as one."""
    return pairs(x, y, _cosine, "similarity")


def cosine_distance(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """1 - similarity within [0, 2]; zero from a row to itself when y is not given."""
    own = y is None

    def of(a: Side, b: Side) -> np.ndarray:
        held = np.minimum(2.0, np.maximum(0.0, 1 - _cosine(a, b)))
        return np.where(a.id_values[:, None] == b.id_values, 0.0, held) if own else held

    return pairs(x, y, of, "distance")


def rbf_kernel(x: DataFrame, y: DataFrame | None = None, gamma: float | None = None) -> DataFrame:
    return pairs(x, y, lambda a, b: np.exp(-_gamma(gamma, a) * _sqdist(a, b)), "kernel")


def linear_kernel(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    return pairs(x, y, _dot, "kernel")


def polynomial_kernel(x: DataFrame, y: DataFrame | None = None, degree: int = 3, gamma: float | None = None, coef: float = 1) -> DataFrame:
    return pairs(x, y, lambda a, b: np.power(_gamma(gamma, a) * _dot(a, b) + float(coef), float(degree)), "kernel")


def sigmoid_kernel(x: DataFrame, y: DataFrame | None = None, gamma: float | None = None, coef: float = 1) -> DataFrame:
    return pairs(x, y, lambda a, b: np.tanh(_gamma(gamma, a) * _dot(a, b) + float(coef)), "kernel")
