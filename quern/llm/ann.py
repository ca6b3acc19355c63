"""Approximate nearest neighbours by score-aware (anisotropic) quantisation and four-bit table scans.

Vectors are normalised, so that the largest inner product is the largest cosine. They are split into subspaces of two
components with 16 codewords each, so a code has four bits. The quantiser weighs the residual along the vector, which
changes inner products most, `eta` times as much as the residual across it: codes are chosen and codewords solved for under that
loss, with what other subspaces leave of the parallel residual taken into account. A query's tables of 16 products a
subspace are joined in pairs to 256 whole numbers, one look-up for each byte of code, and summed over every row of a part.

The `rerank` best of each part are scored exactly on the original vectors, and so is every other row whose code score could
still beat the kth exact one: a code score is wrong by no more than the length of the row's residual, of which `margin` is
allowed for. With margin 1 the result is exact however vectors cluster; less is faster, and then recall must be measured.

Codebooks are fitted on a bounded sample of rows by hash order (`sample`, a documented parameter); every row is indexed
and every row is scanned for every query. Rows are dealt over parts once and stay there, queries stream past them. Null, zero,
empty or non-finite vectors and null ids take no part. Repeated rows are candidates (and queries) each; only a query's own row is
no candidate; equal scores go to the smaller id. Vectors of other lengths than a query's are no candidates. A query with
fewer candidates returns all. An empty table gives no rows. Columns but vec_id and embedding are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.cover_tree import Best, met, numbered, ranked

CODES, SPLIT, SCALE = 16, 2, 1 << 16


class Quantiser:
    """Anisotropic product quantiser of vectors of one length."""

    def __init__(self, width: int, threshold: float = 0.2):
        self.width = width
        self.parts = 2 * -(-width // (2 * SPLIT))  # an even number, for pairs
        self.eta = max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))
        self.books = np.zeros((self.parts, CODES, SPLIT))

    def cut(self, units: np.ndarray) -> np.ndarray:
        """[n, parts, SPLIT], filled up with zeros."""
        out = np.zeros((len(units), self.parts * SPLIT))
        out[:, : self.width] = units
        return out.reshape(len(units), self.parts, SPLIT)

    def fit(self, units: np.ndarray, turns: int = 8) -> None:
        """Codewords by Lloyd's steps, plain ones first and then under the anisotropic loss."""
        x, rng = self.cut(units), np.random.default_rng(0)
        for m in range(self.parts):
            book = x[rng.choice(len(x), CODES, replace=len(x) < CODES), m] + rng.normal(0, 1e-6, (CODES, SPLIT))
            for _ in range(10):
                own = ((x[:, m, None] - book) ** 2).sum(2).argmin(1)
                for c in range(CODES):
                    if (own == c).any():
                        book[c] = x[own == c, m].mean(0)
            self.books[m] = book
        for _ in range(turns):
            codes = self.encode_parts(x, 1)
            parallel = self.parallel(x, codes)
            for m in range(self.parts):
                left = parallel.sum(1) - parallel[:, m]
                for c in range(CODES):
                    own = codes[:, m] == c
                    if own.any():
                        v = x[own, m]
                        a = own.sum() * np.eye(SPLIT) + (self.eta - 1) * v.T @ v
                        b = v.sum(0) + (self.eta - 1) * ((left[own] + (v * v).sum(1))[:, None] * v).sum(0)
                        self.books[m, c] = np.linalg.solve(a, b)
                parallel[:, m] = ((x[:, m] - self.books[m][codes[:, m]]) * x[:, m]).sum(1)

    def parallel(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's share of the residual along the vector."""
        return ((x - self.books[np.arange(self.parts), codes]) * x).sum(2)

    def encode_parts(self, x: np.ndarray, turns: int) -> np.ndarray:
        """Codes by turns over the subspaces, from the nearest codewords on."""
        codes = np.stack([((x[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)], axis=1)
        parallel = self.parallel(x, codes)
        total = parallel.sum(1)
        for _ in range(turns):
            for m in range(self.parts):
                gap = x[:, m, None] - self.books[m]
                along = (gap * x[:, m, None]).sum(2)
                loss = (gap**2).sum(2) + (self.eta - 1) * ((total - parallel[:, m])[:, None] + along) ** 2
                codes[:, m] = loss.argmin(1)
                new = along[np.arange(len(x)), codes[:, m]]
                total += new - parallel[:, m]
                parallel[:, m] = new
        return codes

    def encode(self, units: np.ndarray) -> np.ndarray:
        """Two codes a byte: [n, parts / 2]."""
        out = np.empty((len(units), self.parts // 2), np.uint8)
        for at in range(0, len(units), 4096):
            codes = self.encode_parts(self.cut(units[at : at + 4096]), 2)
            out[at : at + 4096] = codes[:, ::2] * CODES + codes[:, 1::2]
        return out

    def residuals(self, units: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what the codes leave of every row."""
        out = np.empty(len(units))
        for at in range(0, len(units), 4096):
            both = codes[at : at + 4096]
            each = np.stack((both // CODES, both % CODES), axis=2).reshape(len(both), self.parts)
            gap = self.cut(units[at : at + 4096]) - self.books[np.arange(self.parts), each]
            out[at : at + 4096] = np.sqrt((gap * gap).sum((1, 2)))
        return out

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Whole-number tables of 256 entries for each byte of code."""
        each = np.einsum("mcs,ms->mc", self.books, self.cut(query[None])[0])
        both = each[::2, :, None] + each[1::2, None, :]
        return np.rint(both.reshape(len(both), CODES * CODES) * SCALE).astype(np.int32)


class Block:
    """Row numbers, ids, vectors and norms of the rows of a part, by id, with their codes and the lengths of their residuals."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, points: np.ndarray, tool: Quantiser):
        norms = np.sqrt((points * points).sum(1))
        order = np.lexsort((numbers, ids))
        order = order[norms[order] > 0]
        self.numbers, self.ids, self.points, self.norms = numbers[order], ids[order], points[order], norms[order]
        units = self.points / self.norms[:, None]
        codes = tool.encode(units)
        self.rows = np.ascontiguousarray(codes.T)
        # What a code score may be wrong by, with what rounding the tables adds.
        self.wrong = tool.residuals(units, codes) * (1 + 1e-9) + len(self.rows) / SCALE


def scan(tool: Quantiser, data: Block, number: int, query: np.ndarray, best: Best, row: int, rerank: int, margin: float) -> int:
    """Scans a part's codes for one query; scores the best, and all that could beat them, exactly. Returns how many."""
    norm = np.sqrt((query * query).sum())
    sums = np.zeros(len(data.ids), np.int32)
    for byte, of in zip(data.rows, tool.tables(query / norm), strict=True):
        sums += of[byte]

    def exact(few: np.ndarray) -> None:
        few = few[data.numbers[few] != number]
        if len(few):
            scores = (data.points[few] * query).sum(1) / (data.norms[few] * norm)
            best.add(np.array([row]), scores[None], data.ids[few][None])

    few = np.argpartition(-sums, min(rerank, len(sums)) - 1)[:rerank]
    exact(few)
    could = sums / SCALE + margin * data.wrong >= best.scores[row, -1]
    could[few] = False
    rest = np.flatnonzero(could)
    exact(rest)
    return len(few) + len(rest)


def nearest(df: DataFrame, spark: SparkSession, every: int = 50, k: int = 5, sample: int = 20_000, rerank: int = 160, margin: float = 1.0, query_block: int = 1024, part_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id and score (cosine): for each row whose id is divisible by `every`, the k nearest found."""
    rows = numbered(df, spark, "ann-rows")
    tools = {}
    for width in sorted(r["width"] for r in rows.select("width").distinct().collect()):
        few = rows.filter(F.col("width") == width).select("vec_id", "vector", "number").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "number").limit(sample).toArrow()
        points = few["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        norms = np.sqrt((points * points).sum(1))
        tools[width] = Quantiser(width)
        if (norms > 0).any():
            tools[width].fit(points[norms > 0] / norms[norms > 0, None])
    shipped = spark.sparkContext.broadcast(tools)

    def load(numbers: np.ndarray, ids: np.ndarray, points: np.ndarray) -> Block:
        return Block(numbers, ids, points, shipped.value[points.shape[1]])

    def best_of(data: Block, numbers: np.ndarray, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, tool = Best(len(ids), k, np.float64), shipped.value[points.shape[1]]
        for row in np.flatnonzero((points != 0).any(axis=1)).tolist() if len(data.ids) else ():
            scan(tool, data, int(numbers[row]), points[row], best, row, rerank, margin)
        return best.found()

    return ranked(met(rows, spark, every, load, best_of, "double", query_block, part_bytes), k)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every query among all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), spark)
