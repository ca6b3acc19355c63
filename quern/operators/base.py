"""Contracts: estimators learn from columns id, features and label or target, and add columns.

`fit` returns the estimator itself with small learnt arrays. `predict` adds `prediction`, `decision_function` adds
`decision`, `predict_proba` adds `probability`, `transform` replaces `features`. Nulls in features are refused at fit.
"""

from __future__ import annotations

import inspect
import pickle
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import first_argmax
from quern.functions.numeric import with_numpy


def samples(df: DataFrame, column: str = "features") -> DataFrame:
    """df with `column` as array<double>; an error if it is no array of numbers."""
    kind = dict(df.dtypes).get(column, "")
    if not kind.startswith("array<"):
        raise ValueError(f"{column} must be an array of numbers")
    return df if kind == "array<double>" else df.withColumn(column, F.col(column).cast("array<double>"))


def labels(df: DataFrame, column: str = "label") -> DataFrame:
    """df with `column` as int; an error if it is no plain column."""
    if column not in df.columns or dict(df.dtypes)[column].startswith("array"):
        raise ValueError(f"{column} must be one label a row")
    return df.withColumn(column, F.col(column).cast("int"))


def targets(df: DataFrame, column: str = "target") -> DataFrame:
    """df with `column` as double or array<double>."""
    if column not in df.columns:
        raise ValueError(f"{column} is missing")
    many = dict(df.dtypes)[column].startswith("array")
    return df.withColumn(column, F.col(column).cast("array<double>" if many else "double"))


def same_size(x: DataFrame, y: DataFrame) -> None:
    """An error if the two differ in their numbers of rows."""
    if x.count() != y.count():
        raise ValueError("samples and targets differ in number")


def classes_of(df: DataFrame, column: str = "label") -> list[int]:
    """Distinct labels in order."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


class Estimator:
    """Base: parameters are the constructor's arguments, under their names."""

    @property
    def params(self) -> dict[str, Any]:
        names = [p for p in inspect.signature(type(self).__init__).parameters if p not in ("self", "args", "kwargs")]
        return {n: getattr(self, n) for n in names if hasattr(self, n)}

    def set_params(self, **new: Any) -> Estimator:
        """Changes parameters by name."""
        for k, v in new.items():
            if k not in self.params:
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            setattr(self, k, v)
        return self

    def copy(self) -> Estimator:
        """An estimator of the same parameters that has learnt nothing."""
        return type(self)(**self.params)

    def save(self, path: str) -> None:
        """Writes parameters and learnt arrays."""
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Estimator:
        with open(path, "rb") as f:
            return pickle.load(f)


class Classifier:
    """Mixin: predict from `classes` and a decision array; score is accuracy."""

    classes: list[int]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.decision_function(df).withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), first_argmax(F.col("decision")) + 1)).drop("decision")

    def score(self, df: DataFrame) -> float:
        return self.predict(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


class Regressor:
    """Mixin: score is R2, averaged over outputs."""

    def score(self, df: DataFrame) -> float:
        from quern.operators.metrics import r2_score

        return r2_score(self.predict(df), "target", "prediction").first()[0]


class Clusterer:
    """Mixin: fit_predict, and score by purity against `label`."""

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def score(self, df: DataFrame) -> float:
        from quern.operators.metrics import purity

        return purity(self.fit_predict(df), "label", "prediction").first()[0]


class Evaluator:
    """A measure of rows with true and predicted columns; `needs` names the method that predicts what it looks at.

    As an evaluator of CrossValidation or GridSearchCV it takes the rows alone and gives their measure.
    """

    def __init__(self, measure, needs: str = "predict", **columns: str):
        self.measure, self.needs, self.columns = measure, needs, columns

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.measure(df, **self.columns)

    def score(self, df: DataFrame) -> float:
        return self(df).first()[0]


class Transformer:
    """Mixin: fit then transform."""

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def decided(df: DataFrame, of, columns=("features",)) -> DataFrame:
    """df with `decision`, an array a row."""
    return with_numpy(df, "decision", "array<double>", columns, of)


def predicted_classes(df: DataFrame, classes: list[int], of, columns=("features",)) -> DataFrame:
    """df with `prediction`: the class of the first largest decision."""
    known = np.array(classes)
    return with_numpy(df, "prediction", "int", columns, lambda *x: known[np.asarray(of(*x)).argmax(axis=1)].astype(np.int32))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def platt(df: DataFrame, decision: str, positive: str, max_iter: int = 100, min_step: float = 1e-10, sigma: float = 1e-12) -> tuple[float, float]:
    """Platt's calibration 1 / (1 + exp(a f + b)): Newton's method with step halving; every evaluation is one sum over df."""
    from quern.functions.numeric import sums

    n = sums(df, [positive], lambda y: np.array([(y > 0).sum(), (y <= 0).sum()], float))
    high, low = (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2)

    def at(a: float, b: float) -> np.ndarray:
        def of(f: np.ndarray, y: np.ndarray) -> np.ndarray:
            t, z = np.where(y > 0, high, low), a * f + b
            p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
            loss = (t * z + np.logaddexp(0, -z)).sum()
            w = p * (1 - p)
            return np.array([loss, (f * (t - p)).sum(), (t - p).sum(), (f * f * w).sum(), (f * w).sum(), w.sum()])

        return sums(df, [decision, positive], of)

    a, b = 0.0, float(np.log((n[1] + 1) / (n[0] + 1)))
    now = at(a, b)
    for _ in range(max_iter):
        loss, ga, gb, haa, hab, hbb = now
        if max(abs(ga), abs(gb)) < 1e-5:
            break
        haa, hbb = haa + sigma, hbb + sigma
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step = 1.0
        while step >= min_step:
            new = at(a + step * da, b + step * db)
            if new[0] < loss + 1e-4 * step * (ga * da + gb * db):
                a, b, now = a + step * da, b + step * db, new
                break
            step /= 2
        else:
            break
    return a, b
