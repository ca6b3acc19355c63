"""Scalers, normalisers, encoders and feature expansion. fit is one aggregation; transform is a projection."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import literal, norm, or_one
from quern.functions.numeric import with_numpy
from quern.operators.base import Estimator, Transformer, samples


def _per_feature(df: DataFrame, *of) -> list[list[float]]:
    """Aggregates of every feature, in one pass: one list for each of `of`."""
    d = df.select(F.size("features")).first()
    if d is None:
        raise ValueError("no rows to learn from")
    each = [[f(F.col("features")[j]) for j in range(d[0])] for f in of]
    row = df.agg(*[c for cs in each for c in cs]).first()
    return [list(row[k * d[0] : (k + 1) * d[0]]) for k in range(len(of))]


class _Scaler(Estimator, Transformer):
    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", self._of(F.col("features").cast("array<double>")))


class StandardScaler(_Scaler):
    """(x - mean) / sample standard deviation; a constant feature divides by zero, to NaN, as there is no guard."""

    def fit(self, df: DataFrame) -> StandardScaler:
        self.mean, self.std = _per_feature(samples(df), F.avg, F.stddev_samp)
        return self

    def _of(self, x: Column) -> Column:
        gap = F.zip_with(x, literal(self.mean), lambda v, m: v - m)
        return F.zip_with(gap, literal(self.std), lambda v, s: F.when(s == 0, F.lit(float("nan"))).otherwise(v / s))


class MinMaxScaler(_Scaler):
    """Onto feature_range; a constant feature goes to its low end."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        self.feature_range = feature_range

    def fit(self, df: DataFrame) -> MinMaxScaler:
        self.low, self.high = _per_feature(samples(df), F.min, F.max)
        return self

    def _of(self, x: Column) -> Column:
        a, b = map(float, self.feature_range)
        width = literal([h - l or 1.0 for l, h in zip(self.low, self.high, strict=True)])
        return F.zip_with(F.zip_with(x, literal(self.low), lambda v, l: v - l), width, lambda v, w: v / w * (b - a) + a)


class MaxAbsScaler(_Scaler):
    """x / max |x|; a feature of zeros gives NaN."""

    def fit(self, df: DataFrame) -> MaxAbsScaler:
        (self.max_abs,) = _per_feature(samples(df), lambda c: F.max(F.abs(c)))
        return self

    def _of(self, x: Column) -> Column:
        return F.zip_with(x, literal(self.max_abs), lambda v, m: F.when(m == 0, F.lit(float("nan"))).otherwise(v / m))


class _Normalizer(_Scaler):
    kind = "l2"

    def fit(self, df: DataFrame) -> _Normalizer:
        samples(df)
        return self

    def _of(self, x: Column) -> Column:
        size = or_one(norm(x, self.kind))
        return F.transform(x, lambda v: v / size)


class L1Normalizer(_Normalizer):
    """Rows by their sum of magnitudes; a zero row stays."""

    kind = "l1"


class L2Normalizer(_Normalizer):
    """Rows by their length; a zero row stays."""


class MaxNormalizer(_Normalizer):
    """Rows by their largest magnitude; a zero row stays."""

    kind = "max"


def normalize(df: DataFrame, norm: str) -> DataFrame:
    """Rows by l1 or l2 norm."""
    if norm not in ("l1", "l2"):
        raise ValueError("norm is l1 or l2")
    return (L1Normalizer() if norm == "l1" else L2Normalizer()).transform(df)


class Binarizer(_Scaler):
    """1.0 above the threshold, else 0.0."""

    def __init__(self, threshold: float = 0.0):
        self.threshold = threshold

    def fit(self, df: DataFrame) -> Binarizer:
        return self

    def _of(self, x: Column) -> Column:
        return F.transform(x, lambda v: F.when(v > float(self.threshold), 1.0).otherwise(0.0))


class BinDiscretizer(_Scaler):
    """Number of the last of n_bins equal edges that a value reaches; below the least, 0."""

    def __init__(self, n_bins: int = 32):
        self.n_bins = n_bins

    def fit(self, df: DataFrame) -> BinDiscretizer:
        low, high = _per_feature(samples(df), F.min, F.max)
        self.edges = [np.linspace(l, h, self.n_bins + 1)[:-1].tolist() for l, h in zip(low, high, strict=True)]
        return self

    def _of(self, x: Column) -> Column:
        edges = F.array(*[literal(e) for e in self.edges])
        return F.zip_with(x, edges, lambda v, e: F.greatest(F.lit(0), F.size(F.filter(e, lambda q: q <= v)) - 1).cast("double"))


class LabelEncoder(Estimator):
    """Sorted distinct labels to numbers from 0, and back; an unseen label becomes null."""

    def fit(self, df: DataFrame, column: str = "label") -> LabelEncoder:
        self.column = column
        self.classes = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
        self._kind = dict(df.dtypes)[column]
        return self

    def _classes(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes]).cast(f"array<{self._kind}>")

    def transform(self, df: DataFrame) -> DataFrame:
        at = F.array_position(self._classes(), F.col(self.column)) - 1
        return df.withColumn("code", F.when(at >= 0, at).cast("int"))

    def fit_transform(self, df: DataFrame, column: str = "label") -> DataFrame:
        return self.fit(df, column).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.element_at(self._classes(), F.col("code") + 1))


class LabelBinarizer(LabelEncoder):
    """One code a class: pos_label for the row's class, else neg_label; back by the first code that isn't neg_label."""

    def __init__(self, neg_label: int = 0, pos_label: int = 1):
        self.neg_label, self.pos_label = neg_label, pos_label

    def transform(self, df: DataFrame) -> DataFrame:
        own = F.col(self.column)
        return df.withColumn("codes", F.transform(self._classes(), lambda c: F.when(c == own, self.pos_label).otherwise(self.neg_label)))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        at = F.array_position(F.transform("codes", lambda c: (c != self.neg_label).cast("int")), 1)
        return df.withColumn(self.column, F.element_at(self._classes(), at.cast("int")))


def binarize_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """One-hot codes of sorted distinct labels."""
    return LabelBinarizer().fit(df, column).transform(df)


class OneHotEncoder(Estimator, Transformer):
    """Features of non-negative whole numbers to indicators of the values seen at fit; others have none."""

    def fit(self, df: DataFrame) -> OneHotEncoder:
        df = samples(df)
        seen = df.select(F.posexplode("features").alias("j", "v")).distinct().orderBy("j", "v").collect()
        if any(r.v < 0 for r in seen):
            raise ValueError("values must not be negative")
        d = max((r.j for r in seen), default=-1) + 1
        self.n_values = [int(max(r.v for r in seen if r.j == j)) + 1 for j in range(d)]
        before = np.concatenate(([0], np.cumsum(self.n_values)))
        self.active = sorted({(r.j, int(r.v)) for r in seen})
        self.active_features = [int(before[j]) + v for j, v in self.active]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        hot = [F.when(F.col("features")[j] == v, 1.0).otherwise(0.0) for j, v in self.active]
        return df.withColumn("features", F.array(*hot))


class OrdinalEncoder(Estimator):
    """Each of several columns to numbers of its sorted categories, and back."""

    def __init__(self, categories: dict[str, list] | None = None):
        self.categories = categories

    def fit(self, df: DataFrame, columns: list[str]) -> OrdinalEncoder:
        self.columns, self._kinds = columns, dict(df.dtypes)
        known = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first().asDict()
        self.categories = self.categories or known
        return self

    def _of(self, c: str) -> Column:
        return F.array(*[F.lit(v) for v in self.categories[c]]).cast(f"array<{self._kinds[c]}>")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.array_contains(self._of(c), F.col(c)), F.array_position(self._of(c), F.col(c)) - 1).cast("int") for c in self.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.element_at(self._of(c), F.col(c) + 1) for c in self.columns})


class PolynomialFeatures(_Scaler):
    """1 and all products of up to `degree` features, by degree and then in order of the first factor."""

    def __init__(self, degree: int = 2):
        self.degree = degree

    def fit(self, df: DataFrame) -> PolynomialFeatures:
        d = df.select(F.size("features")).first()[0]
        self.terms = [t for n in range(self.degree + 1) for t in combinations_with_replacement(range(d), n)]
        return self

    def _of(self, x: Column) -> Column:
        out = []
        for term in self.terms:
            product = F.lit(1.0)
            for j in term:
                product = product * x[j] if term else product
            out.append(product)
        return F.array(*out)


class KernelCalculator(Estimator, Transformer):
    """Kernel values against the rows seen at fit, in order of id; a row of n values is made at a time, never a table on one machine."""

    def __init__(self, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef: float = 1.0, limit: int = 0):
        self.kernel, self.gamma, self.degree, self.coef, self.limit = kernel, gamma, degree, coef, limit

    def fit(self, df: DataFrame) -> KernelCalculator:
        from quern.functions.numeric import collected

        (self.components,) = collected(samples(df), ["features"], self.limit)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return with_numpy(df, "features", "array<double>", ["features"], lambda x: kernel(x, self.components, self.kernel, self.gamma, self.degree, self.coef))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Kernel machines find the rows with what this gives, and make the kernel where they need it."""
        from quern.functions.kernels import KernelTable

        kind, gamma, degree, coef = self.kernel, self.gamma, self.degree, self.coef
        out = self.fit(df).transform(df)
        out._kernel_table = KernelTable(samples(df), self.components, lambda a, b: kernel(a, b, kind, gamma, degree, coef), gamma if kind == "rbf" else None)
        return out


def kernel(x: np.ndarray, y: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef: float = 1.0) -> np.ndarray:
    """Kernel matrix of rows."""
    if kind == "rbf":
        return np.exp(-gamma * squared(x, y))
    if kind == "poly":
        return (gamma * x @ y.T + coef) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * x @ y.T + coef)
    if kind == "linear":
        return x @ y.T
    raise ValueError("kernel is rbf, poly, sigmoid or linear")


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, never negative."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0.0)
