"""Features from maps of names to values, and TF-IDF."""

from __future__ import annotations

from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import literal, norm, or_one
from quern.functions.storage import kept
from quern.operators.base import Estimator, Transformer, samples


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 of 32 bits, x86 form, signed."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF

    def scrambled(k: int) -> int:
        k = k * c1 & mask
        return ((k << 15 | k >> 17) & mask) * c2 & mask

    h, whole = seed & mask, len(data) & ~3
    for at in range(0, whole, 4):
        h ^= scrambled(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(data) > whole:
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _flat(df: DataFrame, separator: str) -> DataFrame:
    """df with `_items`: map<string,double> of numbers under their names and 1.0 under name=text."""
    kind = dict(df.dtypes)["features"]
    if kind.endswith(",string>"):
        own = F.transform_keys("features", lambda k, v: F.concat_ws(separator, k, v))
        return df.withColumn("_items", F.transform_values(own, lambda k, v: F.lit(1.0)))
    return df.withColumn("_items", F.col("features").cast("map<string,double>"))


class FeatureHasher(Estimator, Transformer):
    """Names to places by MurmurHash3; of names that meet in a place the last one stays, they don't add up."""

    def __init__(self, n_features: int = 1024, alternate_sign: bool = True):
        self.n_features, self.alternate_sign = n_features, alternate_sign

    def fit(self, df: DataFrame) -> FeatureHasher:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        n, signed = self.n_features, self.alternate_sign

        @F.pandas_udf("array<double>")
        def hashed(keys: pd.Series, values: pd.Series) -> pd.Series:
            out = []
            for ks, vs in zip(keys, values, strict=True):
                row = [0.0] * n
                for k, v in zip(ks, vs, strict=True):
                    h = murmur3(k.encode())
                    row[abs(h) % n] = v * (-1.0 if signed and h < 0 else 1.0)
                out.append(row)
            return pd.Series(out)

        flat = _flat(df, "=")
        return flat.withColumn("features", hashed(F.map_keys("_items"), F.map_values("_items"))).drop("_items")


class HashVectorizer(Estimator, Transformer):
    """Maps to arrays over the names seen at fit; unseen names are left out."""

    def __init__(self, separator: str = "=", sort: bool = True):
        self.separator, self.sort = separator, sort

    def fit(self, df: DataFrame) -> HashVectorizer:
        names = _flat(df, self.separator).select("id", F.posexplode(F.map_keys("_items")).alias("at", "name"))
        first = names.groupBy("name").agg(F.min(F.struct("id", "at")).alias("first"))
        self.feature_names = [r["name"] for r in first.orderBy("name" if self.sort else "first").collect()]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.feature_names])
        flat = _flat(df, self.separator)
        return flat.withColumn("features", F.transform(names, lambda n: F.coalesce(F.col("_items")[n], F.lit(0.0)))).drop("_items")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Maps of the values that aren't zero."""
        names = F.array(*[F.lit(n) for n in self.feature_names])
        return df.withColumn("features", F.map_filter(F.map_from_arrays(names, "features"), lambda k, v: v != 0))


class TfidfTransformer(Estimator, Transformer):
    """Term counts by idf = ln(n / df) + 1, smooth: one more document with every term; then row norms."""

    def __init__(self, norm: str = "l2", use_idf: bool = True, smooth_idf: bool = False, sublinear_tf: bool = False):
        self.norm, self.use_idf, self.smooth_idf, self.sublinear_tf = norm, use_idf, smooth_idf, sublinear_tf

    def fit(self, df: DataFrame) -> TfidfTransformer:
        df = samples(df)
        d = df.select(F.size("features")).first()[0]
        row = df.agg(F.count("*"), *[F.sum((F.col("features")[j] != 0).cast("int")) for j in range(d)]).first()
        more = int(self.smooth_idf)
        self.idf = [log((row[0] + more) / (c + more)) + 1 if c + more else float("inf") for c in row[1:]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col("features").cast("array<double>")
        if self.sublinear_tf:
            x = F.transform(x, lambda v: F.when(v > 0, F.ln(v) + 1).otherwise(v))
        if self.use_idf:
            x = F.zip_with(x, literal(self.idf), lambda v, w: F.when(v == 0, 0.0).otherwise(v * w))
        out = df.withColumn("features", x)
        if self.norm == "none":
            return out
        size = or_one(norm(F.col("features"), self.norm))
        return out.withColumn("features", F.transform("features", lambda v: v / size))


#: Terms of more than this part of all rows are joined apart.
HOT = 2000


def term_counts(df: DataFrame, column: str = "text", pattern: str = r"[^\x20\x09-\x0D]+") -> DataFrame:
    """id, term and tf: occurrences of each lower-cased word in each text."""
    words = F.explode(F.regexp_extract_all(F.lower(column), F.lit(f"({pattern})"), F.lit(1))).alias("term")
    return df.select("id", words).groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf_long(counts: DataFrame, n: int, smooth: bool = False, sublinear: bool = False, norm: str = "l2") -> DataFrame:
    """id, term and weight from long counts: TF-IDF without a dense vocabulary; joins and sums by term and by id.

    Counts are saved, so that texts are read once. Terms in more than one row in HOT are HOT times the mean row's number of
    terms at most, and broadcast; other terms are joined, and none of those is hot.
    """
    more, counts = int(smooth), kept(counts, "counts")
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.ln((F.lit(float(n)) + more) / (F.col("df") + more)) + 1).alias("idf"))
    tf = (F.ln("tf") + 1) if sublinear else F.col("tf").cast("double")
    frequent = counts.groupBy("term").agg(F.count("*").alias("_df")).filter(F.col("_df") > max(1000, n // HOT)).select("term")
    idf = kept(idf.join(frequent.withColumn("hot", F.lit(True)), "term", "left"), "idf")
    hot = F.broadcast(idf.filter("hot").drop("hot"))
    rest = counts.join(hot.select("term"), "term", "left_anti").join(idf.filter("hot IS NULL").drop("hot").hint("merge"), "term")
    out = counts.join(hot, "term").unionByName(rest).select("id", "term", (tf * F.col("idf")).alias("weight"))
    if norm == "none":
        return out
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight"))) if norm == "l2" else F.sum(F.abs("weight"))
    return out.join(out.groupBy("id").agg(size.alias("size")), "id").select("id", "term", (F.col("weight") / F.col("size")).alias("weight"))
