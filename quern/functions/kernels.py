"""A kernel of rows with themselves, known by the rows: tasks make it tile by tile, and no table of it exists anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.blocks import Blocks
from quern.functions.numeric import CELLS, with_numpy

#: Rows of a tile's side.
TILE = 512


class KernelTable:
    """of(a, b) between all rows x, which stand in the order of id and come from `source`."""

    def __init__(self, source: DataFrame, x: np.ndarray, of: Callable[[np.ndarray, np.ndarray], np.ndarray], taylor: float | None = None):
        self.source, self.x, self.of, self.taylor, self.blocks = source, x, of, taylor, None

    def times(self, v: np.ndarray, means: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """The kernel times v, and the sum of its squares. With means (of its rows) the kernel is centred both ways before it is multiplied."""
        of, all_mean = self.of, 0.0 if means is None else means.mean()

        def tile(x: np.ndarray, one: slice, two: slice, means: np.ndarray | None) -> tuple[np.ndarray, float]:
            k = of(x[one], x[two])
            if means is not None:
                k -= (means[one] - all_mean)[:, None]
                k -= means[two]
            return k, float(np.vdot(k, k))

        self.blocks = self.blocks or Blocks(self.source.sparkSession, self.x, TILE * len(self.x))
        return self.blocks.paired(tile, v, means)

    def close(self) -> None:
        if self.blocks:
            self.blocks.close()
        self.blocks = None

    def landmarks(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows spread over all, with eigenvalues, largest first, and eigenvectors of their own kernel."""
        x = self.x[np.linspace(0, len(self.x) - 1, min(m, len(self.x))).astype(int)]
        values, vectors = np.linalg.eigh(self.of(x, x))
        return x, values[::-1], vectors[:, ::-1]

    def features(self, most: int = 2500) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
        """A map of rows to features, and their number, whose inner products are near the kernel.

        They are the terms of exp up to the second degree where a Gaussian kernel is that flat, else Nystroem's.
        """
        gap, width = self.x - self.x.mean(0), (self.x.shape[1] + 1) * (self.x.shape[1] + 2) // 2
        if self.taylor is not None and width <= min(most, len(self.x)) and 2 * self.taylor * (gap * gap).sum(1).max() <= 0.5:
            g, mean, (one, two) = 2 * self.taylor, self.x.mean(0), np.triu_indices(self.x.shape[1])
            scale = np.where(one == two, g / np.sqrt(2), g)

            def terms(x: np.ndarray) -> np.ndarray:
                x = x - mean
                return np.hstack([np.ones((len(x), 1)), np.sqrt(g) * x, x[:, one] * x[:, two] * scale]) * np.exp(-g / 2 * (x * x).sum(1))[:, None]

            return terms, width
        near, values, vectors = self.landmarks(most)
        keep = values > values[0] * 1e-14
        turned, of = vectors[:, keep] / np.sqrt(values[keep]), self.of
        return (lambda x: of(x, near) @ turned), int(keep.sum())

    def products_of(self, features: Callable[[np.ndarray], np.ndarray], width: int, turn: np.ndarray) -> np.ndarray:
        """F'(F turn) of all rows' features F: a few columns a task, whose results are small."""
        step = -(-width // max(1, self.source.sparkSession.sparkContext.defaultParallelism))

        def columns(x: np.ndarray, lo: int, hi: int, turn: np.ndarray) -> tuple:
            out = np.zeros((width, hi - lo))
            for at in range(0, len(x), 1024):
                f = features(x[at : at + 1024])
                out += f.T @ (f @ turn[:, lo:hi])
            return (np.ascontiguousarray(out.T),)

        self.blocks = self.blocks or Blocks(self.source.sparkSession, self.x, TILE * len(self.x))
        return self.blocks.each(columns, turn, parts=(turn.shape[1], step))[0].T

    def rows_times(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The kernel of these rows with all, times w."""
        out = np.zeros((len(x), w.shape[1]))
        for at in range(0, len(x), TILE):
            for lo in range(0, len(self.x), TILE):
                out[at : at + TILE] += self.of(x[at : at + TILE], self.x[lo : lo + TILE]) @ w[lo : lo + TILE]
        return out


def table_of(df: DataFrame) -> KernelTable | None:
    """What KernelCalculator made df's features from, if it did."""
    return getattr(df, "_kernel_table", None)


def weighted(df: DataFrame, name: str, kind: str, w: np.ndarray, then: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with the column then(features times w). Kernel values of a known table are made and used in one step; where df's features are still asked for, they are made again."""
    table = table_of(df)
    if table is None:
        return with_numpy(df, name, kind, ["features"], lambda k: then(k @ w))
    source, of, x = table.source, table.of, table.x
    if len(x) > CELLS // TILE:  # even shares
        source = source.repartition(4 * max(1, source.sparkSession.sparkContext.defaultParallelism))
    far = KernelTable(None, x, of)
    if name == "features":
        return with_numpy(source, name, kind, ["features"], lambda rows: then(far.rows_times(rows, w)))
    out = with_numpy(source, name, kind, ["features"], lambda rows: then(far.rows_times(rows, w)))

    def again(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = max(1, CELLS // len(x))
        for part in parts:
            rows = part.flatten().to_numpy().reshape(len(part), -1)
            for at in range(0, len(rows), step):
                yield pa.array(list(of(rows[at : at + step], x)), pa.list_(pa.float64()))

    again.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return out.withColumn("features", F.arrow_udf(again, "array<double>")("features"))
