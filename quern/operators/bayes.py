"""Naive Bayes: fit is one grouped aggregation, scores are products with small tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import sums, with_numpy, width
from quern.operators.base import Classifier, Estimator, classes_of, decided, labels, samples


class _NaiveBayes(Estimator, Classifier):
    def _stats(self, df: DataFrame, of) -> None:
        df = labels(samples(df))
        self.classes = classes_of(df)
        d, k = width(df), len(self.classes)
        known = np.array(self.classes)

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            hot = (y[:, None] == known).astype(float)
            return np.concatenate([hot.sum(0), (hot.T @ of(x)).ravel()])

        flat = sums(df, ["features", "label"], part)
        self.counts, self.sums = flat[:k], flat[k:].reshape(k, -1)
        self.priors = self.counts / self.counts.sum()
        self.width = d

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), self._scores)

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        """Log-sum-exp without a shift, as the scores are: far scores underflow."""

        def of(x: np.ndarray) -> np.ndarray:
            s = self._scores(x)
            with np.errstate(divide="ignore"):
                return s - np.log(np.exp(s).sum(1, keepdims=True))

        return with_numpy(samples(df), "log_probability", "array<double>", ["features"], of)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.predict_log_proba(df).withColumn("probability", F.transform("log_probability", F.exp)).drop("log_probability")


class GaussianNB(_NaiveBayes):
    """A normal of mean and sample variance for each class and feature."""

    def fit(self, df: DataFrame) -> GaussianNB:
        self._stats(df, lambda x: x)
        self.means = self.sums / self.counts[:, None]
        known, means = np.array(self.classes), self.means

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at = np.searchsorted(known, y)
            return ((y[:, None] == known).astype(float).T @ (x - means[at]) ** 2).ravel()

        self.variances = sums(labels(samples(df)), ["features", "label"], part).reshape(means.shape) / np.maximum(self.counts - 1, 1)[:, None]
        return self

    def _scores(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.stack([np.log(p) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(1) for p, m, v in zip(self.priors, self.means, self.variances, strict=True)], axis=1)


class MultinomialNB(_NaiveBayes):
    """Smoothed shares of features; scores add the logs of features above zero, whatever their counts."""

    def __init__(self, smoothing_param: float = 1.0):
        self.smoothing_param = smoothing_param

    def fit(self, df: DataFrame) -> MultinomialNB:
        self._stats(df, lambda x: x)
        smooth = self.sums + self.smoothing_param
        self.shares = smooth / smooth.sum(1, keepdims=True)
        return self

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return np.log(self.priors) + (x > 0) @ np.log(self.shares).T


class BernoulliNB(_NaiveBayes):
    """Features above bin_threshold; both present and absent features count. compat=True counts absent ones only."""

    def __init__(self, smoothing_param: float = 1.0, bin_threshold: float = 0.0, compat: bool = False):
        self.smoothing_param, self.bin_threshold, self.compat = smoothing_param, bin_threshold, compat

    def fit(self, df: DataFrame) -> BernoulliNB:
        self._stats(df, lambda x: (x > self.bin_threshold).astype(float))
        self.shares = (self.sums + self.smoothing_param) / (self.counts + 2 * self.smoothing_param)[:, None]
        return self

    def _scores(self, x: np.ndarray) -> np.ndarray:
        b = (x > self.bin_threshold).astype(float)
        absent = np.log(self.priors) + (1 - b) @ np.log(1 - self.shares).T
        return absent if self.compat else absent + b @ np.log(self.shares).T


class ComplementNB(_NaiveBayes):
    """Weights from the rows of all other classes."""

    def __init__(self, smoothing_param: float = 1.0, norm: bool = False):
        self.smoothing_param, self.norm = smoothing_param, norm

    def fit(self, df: DataFrame) -> ComplementNB:
        self._stats(df, lambda x: x)
        others = self.sums.sum(0) - self.sums + self.smoothing_param
        logs = np.log(others / others.sum(1, keepdims=True))
        self.weights = logs / logs.sum(1, keepdims=True) if self.norm else -logs
        return self

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return np.log(self.priors) + x @ self.weights.T


class NegationNB(ComplementNB):
    """ln(1 / (1 - prior)) - x ln p(complement)."""

    def __init__(self, smoothing_param: float = 1.0):
        self.smoothing_param, self.norm = smoothing_param, False

    def _scores(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(1 / (1 - self.priors)) + x @ self.weights.T
