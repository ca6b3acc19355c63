"""Brute-force nearest neighbours of the rows to predict among the rows seen at fit.

The fitted rows are a table, not an array: they are dealt over parts of bounded bytes, once, and query rows stream past every
part. Ties go to the smaller distance, then the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.numeric import matrix
from quern.operators.base import Classifier, Estimator, Regressor, classes_of, samples


def nearest(queries: DataFrame, rows: DataFrame, k: int, part_bytes: int = 64 << 20, block: int = 512) -> DataFrame:
    """query, id, distance and rank: the k nearest of rows for every query.

    There is a part for each `part_bytes` of features (or as many as the cluster runs at once, down to a MB each). Each keeps its
    own k best of every query, found in numpy blocks; these are merged by a window.
    """
    spark = rows.sparkSession
    rows, queries = samples(rows).select("id", "features"), samples(queries).select("id", "features")
    size = 8 * (rows.agg(F.sum(F.size("features").cast("long"))).first()[0] or 0)
    parts = max(1, -(-size // part_bytes), min(-(-size // (1 << 20)), spark.sparkContext.defaultParallelism))
    data = rows.select(F.pmod(F.xxhash64("id", "features"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "features")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "features")
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def best(x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k best of y for each of x."""
        best_d, best_i = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        for at in range(0, len(y), 1024):
            gap = _far(x, y[at : at + 1024])
            d = np.concatenate((best_d, gap), axis=1)
            i = np.concatenate((best_i, np.broadcast_to(ids[at : at + 1024], gap.shape)), axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        return best_d, best_i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                few = batch.slice(a, b - a)
                ids, x = few.column(2).to_numpy(), matrix(few.column(3))
                if kind[a] == 0:  # a part's rows come before the queries
                    held = [*(held if own == part[a] else []), (ids, x)]
                    own = part[a]
                elif own == part[a]:
                    held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                    for low in range(0, len(x), block):
                        d, i = best(x[low : low + block], *held[0])
                        r, c = np.nonzero(np.isfinite(d))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[low + r]), pa.array(i[r, c]), pa.array(d[r, c])], schema=schema)

    dealt = data.unionByName(asked).repartition(2 * parts, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(run, "query long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for r in range(len(x)):
        out[r] = np.sqrt(((y - x[r]) ** 2).sum(1))
    return out


class KNeighborsClassifier(Estimator, Classifier):
    """Votes of the k nearest; the first class of the most votes. metric 'precomputed' takes features as distances by fitted position."""

    def __init__(self, n_neighbors: int = 5, metric: str = "euclidean"):
        self.n_neighbors, self.metric = n_neighbors, metric

    def fit(self, df: DataFrame) -> KNeighborsClassifier:
        self.rows, self.classes = df, classes_of(df)
        return self

    def _near(self, df: DataFrame) -> DataFrame:
        if self.metric == "precomputed":
            at = F.posexplode("features").alias("id", "distance")
            rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
            return df.select(F.col("id").alias("query"), at).withColumn("rank", rank).filter(F.col("rank") <= self.n_neighbors)
        return nearest(df, self.rows, self.n_neighbors)

    def decision_function(self, df: DataFrame) -> DataFrame:
        votes = [F.sum((F.col("label") == c).cast("double")) for c in self.classes]
        own = self._near(df).join(self.rows.select("id", "label"), "id").groupBy("query").agg(F.array(*votes).alias("decision"))
        return df.join(own.withColumnRenamed("query", "id"), "id")


class KNeighborsRegressor(KNeighborsClassifier, Regressor):
    """Mean target of the k nearest."""

    score = Regressor.score

    def fit(self, df: DataFrame) -> KNeighborsRegressor:
        self.rows = df
        self.many = dict(df.dtypes)["target"].startswith("array")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        near = self._near(df).join(self.rows.select("id", "target"), "id")
        if self.many:
            long = near.select("query", F.posexplode("target").alias("k", "v")).groupBy("query", "k").agg(F.avg("v").alias("v"))
            own = long.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("prediction"))
        else:
            own = near.groupBy("query").agg(F.avg("target").alias("prediction"))
        return df.join(own.withColumnRenamed("query", "id"), "id")
