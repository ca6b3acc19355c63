"""Seeded toy data, generated where it is used: id, features and label."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, salt: int) -> Column:
    """A draw in (0, 1) by a hash of the id, the same wherever the row is."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def rand_uniform(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """df with uniform draws of (0, 1)."""
    return df.withColumn(name, _uniform(seed, 0))


def rand_normal(df: DataFrame, name: str, seed: int = 0, mu: float = 0.0, sigma: float = 1.0) -> DataFrame:
    """df with normal draws: sqrt(-2 ln a) sin(2 pi b) sigma + mu."""
    return df.withColumn(name, _normal(seed, 0) * sigma + mu)


def _normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, 2 * salt + 1))) * F.sin(2 * math.pi * _uniform(seed, 2 * salt + 2))


def choice_ids(df: DataFrame, size: int, weight: str = "weight", seed: int = 0) -> DataFrame:
    """`size` rows' ids drawn with replacement in proportion to weight: n (draw) and id, by the inverse of the running sum.

    The draws are the small side and go by a range join over the running sums, which are two-level.
    """
    from quern.operators.selection import positions

    placed = positions(df.select("id", F.col(weight).alias("_w")), [], [F.col("id")])
    block = placed.withColumn("_b", F.floor(F.col("position") / 4096))
    from pyspark.sql import Window as W

    sums = block.groupBy("_b").agg(F.sum("_w").alias("_s"))
    offsets = sums.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_o"))
    top = F.sum("_w").over(W.partitionBy("_b").orderBy("position")) + F.col("_o")
    ends = block.join(offsets, "_b").select("id", top.alias("high"), (top - F.col("_w")).alias("low"))
    total = df.agg(F.sum(weight)).first()[0]
    draws = df.sparkSession.range(size).select(F.col("id").alias("n")).withColumn("id", F.col("n")).select("n", (_uniform(seed, 3) * float(total)).alias("u"))
    return ends.join(F.broadcast(draws), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("n", "id")


def _shape(spark: SparkSession, n: int, points: list[tuple[int, list[Column]]], noise: float | None, seed: int, shuffle: bool) -> DataFrame:
    half = n // 2
    rows = spark.range(n)
    at = F.when(F.col("id") < half, F.col("id") / max(half - 1, 1)).otherwise((F.col("id") - half) / max(n - half - 1, 1))
    rows = rows.withColumn("t", at)
    sides = [F.array(*xs) for _, xs in points]
    rows = rows.withColumn("features", F.when(F.col("id") < half, sides[0]).otherwise(sides[1])).withColumn("label", F.when(F.col("id") < half, points[0][0]).otherwise(points[1][0]))
    if noise:
        rows = rows.withColumn("features", F.array(*[F.col("features")[j] + _normal(seed, j) * float(noise) for j in range(2)]))
    rows = rows.select("id", "features", "label")
    return _shuffled(rows, seed) if shuffle else rows


def _shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Ids in the order of a hash."""
    from quern.operators.selection import positions

    return positions(rows, [], [F.xxhash64("id", F.lit(seed), F.lit(99)), F.col("id")]).drop("id", "position_of").withColumnRenamed("position", "id").select("id", "features", "label")


def make_circles(spark: SparkSession, n_samples: int, shuffle: bool = True, noise: float | None = None, factor: float = 0.8, random_seed: int = 0) -> DataFrame:
    """Two circles, the inner one scaled by factor."""
    angle = 2 * math.pi * F.col("t")
    outer = [F.cos(angle), F.sin(angle)]
    return _shape(spark, n_samples, [(0, outer), (1, [x * factor for x in outer])], noise, random_seed, shuffle)


def make_moons(spark: SparkSession, n_samples: int, shuffle: bool = True, noise: float | None = None, random_seed: int = 0) -> DataFrame:
    """Two half circles that reach into each other."""
    angle = math.pi * F.col("t")
    return _shape(spark, n_samples, [(0, [F.cos(angle), F.sin(angle)]), (1, [1 - F.cos(angle), 0.5 - F.sin(angle)])], noise, random_seed, shuffle)


def make_blobs(spark: SparkSession, n_samples: int = 1000, n_features: int = 2, centers: int | list[list[float]] | None = None, cluster_std: float | list[float] = 1.0, center_box: tuple[float, float] = (-10, 10), shuffle: bool = True, random_seed: int = 0) -> DataFrame:
    """Gaussian blobs around given centres, or random ones scaled into center_box; the first blobs take what n leaves over."""
    if centers is None or isinstance(centers, int):
        c = np.random.default_rng(random_seed).random((centers or 3, n_features))
        low, high = c.min(0), c.max(0)
        c = (c - low) / np.where(high > low, high - low, 1) * (center_box[1] - center_box[0]) + center_box[0]
        centers = c.tolist()
    k, d = len(centers), len(centers[0])
    std = list(cluster_std) if isinstance(cluster_std, (list, tuple)) else [cluster_std] * k
    own = F.pmod("id", F.lit(k)).cast("int")
    c, s = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centers]), F.array(*[F.lit(float(v)) for v in std])
    rows = spark.range(n_samples).withColumn("label", own)
    rows = rows.withColumn("features", F.array(*[F.element_at(c, F.col("label") + 1)[j] + _normal(random_seed, j) * F.element_at(s, F.col("label") + 1) for j in range(d)])).select("id", "features", "label")
    return _shuffled(rows, random_seed) if shuffle else rows
