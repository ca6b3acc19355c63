"""Splitters, cross-validation, grid search, pipelines and feature unions.

Splitters return df with `fold` (each row's test fold, from 0) or, for those whose splits overlap, a long table
(split, id, role). Row numbers come from range-partitioned sorts (`positions`), never from one task.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.storage import kept
from quern.operators.base import Estimator

#: The most groups that GroupKFold deals on the driver, one after another.
GROUPS = 1_000_000


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's 0-based position within `by` in `order`, by a two-level prefix sum.

    A range partition numbers its own rows; sizes of the ranges, one row each, give offsets. No group has to fit a task.
    Rows are dealt once and saved, as a second deal would sample other bounds. Nulls in `by` are a group.
    """
    keys = [*by, *[f"_o{k}" for k in range(len(order))]]
    df = df.withColumns({f"_o{k}": c for k, c in enumerate(order)})
    dealt = kept(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "positions") if keys else df.withColumn("_part", F.lit(0))
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n")
    offsets = sizes.select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], F.col("_part").alias("_in"), before.alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("_size"))
    same = F.col("_part") == F.col("_in")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    own = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*[f"_o{k}" for k in range(len(order))])) - 1
    out = dealt.withColumn(name, own.cast("long")).join(offsets, same)
    return out.withColumn(name, F.col(name) + F.col("_before")).withColumnRenamed("_size", f"{name}_of").drop(*[f"_o{k}" for k in range(len(order))], "_part", "_in", "_before", *[f"_by{k}" for k in range(len(by))])


def _in_folds(k: int) -> Column:
    """The fold of a position: contiguous, the first n mod k folds one larger."""
    n, at = F.col("position_of"), F.col("position")
    small, more = F.floor(n / k), n % k
    return F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")


class KFold:
    """Contiguous folds by id, or by a seeded shuffle."""

    def __init__(self, n_splits: int = 3, shuffle: bool = False, random_seed: int = 0):
        self.n_splits, self.shuffle, self.random_seed = n_splits, shuffle, random_seed

    def folds(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        order = [F.xxhash64("id", F.lit(self.random_seed)), F.col("id")] if self.shuffle else [F.col("id")]
        return positions(df, by or [], order).withColumn("fold", _in_folds(self.n_splits)).drop("position", "position_of")

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        dealt = self.folds(df).persist()
        for k in range(self.n_splits):
            yield dealt.filter(F.col("fold") != k).drop("fold"), dealt.filter(F.col("fold") == k).drop("fold")


class StratifiedKFold(KFold):
    """KFold within each class."""

    def folds(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return super().folds(df, by or ["label"])


class GroupKFold(KFold):
    """Whole groups, the largest first, each to the fold with the fewest rows. Rows without a group are a group."""

    def __init__(self, n_splits: int = 5, group: str = "group_id"):
        self.n_splits, self.group = n_splits, group

    def folds(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        sizes = df.groupBy(self.group).count().orderBy(F.desc("count"), self.group).limit(GROUPS + 1).collect()
        if len(sizes) < self.n_splits:
            raise ValueError("fewer groups than folds")
        if len(sizes) > GROUPS:
            raise ValueError(f"more than {GROUPS} groups; hash them into fewer first")
        filled, rows = [0] * self.n_splits, []
        for r in sizes:
            k = filled.index(min(filled))
            filled[k] += r["count"]
            rows.append((r[0], k))
        kind = dict(df.dtypes)[self.group]
        dealt = df.sparkSession.createDataFrame(rows, f"_group {kind}, fold int")
        return df.join(dealt, F.col(self.group).eqNullSafe(F.col("_group"))).drop("_group")


class ShuffleSplit:
    """Random test sets of ceil(test_size n) rows; the rest, or floor(train_size n) of it, trains."""

    by: list[str] = []

    def __init__(self, n_splits: int = 3, test_size: float = 0.1, train_size: float | None = None, random_seed: int = 0):
        self.n_splits, self.test_size, self.train_size, self.random_seed = n_splits, test_size, train_size, random_seed

    def roles(self, df: DataFrame) -> DataFrame:
        """split, id and role."""
        each = df.select("id", *self.by).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(self.n_splits - 1))))
        dealt = positions(each, ["split", *self.by], [F.xxhash64("id", "split", F.lit(self.random_seed)), F.col("id")])
        n, at = F.col("position_of"), F.col("position")
        test = F.ceil(n * self.test_size)
        train = n - test if self.train_size is None else F.least(n - test, F.floor(n * self.train_size))
        return dealt.select("split", "id", F.when(at < test, "test").when(at < test + train, "train").alias("role")).filter("role IS NOT NULL")

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        roles = self.roles(df).persist()
        for k in range(self.n_splits):
            yield tuple(df.join(roles.filter((F.col("split") == k) & (F.col("role") == role)).select("id"), "id", "left_semi") for role in ("train", "test"))


class StratifiedShuffleSplit(ShuffleSplit):
    """ShuffleSplit within each class."""

    by = ["label"]


class GroupShuffleSplit:
    """ShuffleSplit of groups. Rows without a group are a group."""

    def __init__(self, n_splits: int = 5, test_size: float = 0.2, train_size: float | None = None, random_seed: int = 0, group: str = "group_id"):
        self.inner, self.group, self.n_splits = ShuffleSplit(n_splits, test_size, train_size, random_seed), group, n_splits

    def roles(self, df: DataFrame) -> DataFrame:
        groups = self.inner.roles(df.select(F.col(self.group).alias("id")).distinct()).withColumnRenamed("id", "_group")
        return df.select("id", self.group).join(groups, F.col(self.group).eqNullSafe(F.col("_group"))).select("split", "id", "role")

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        roles = self.roles(df).persist()
        for k in range(self.n_splits):
            yield tuple(df.join(roles.filter((F.col("split") == k) & (F.col("role") == role)).select("id"), "id", "left_semi") for role in ("train", "test"))


class TimeSeriesSplit:
    """Expanding prefixes train, the next block of n div (k + 1) rows tests; max_train_size keeps the latest of a prefix."""

    def __init__(self, n_splits: int = 5, max_train_size: int | None = None, order: str = "id"):
        self.n_splits, self.max_train_size, self.order = n_splits, max_train_size, order

    def roles(self, df: DataFrame) -> DataFrame:
        each = positions(df.select("id", F.col(self.order).alias("_t")), [], [F.col("_t"), F.col("id")])
        n, at, k = F.col("position_of"), F.col("position"), F.col("split")
        size = F.floor(n / (self.n_splits + 1))
        start = size + n % (self.n_splits + 1) + size * k
        low = F.greatest(F.lit(0), start - self.max_train_size) if self.max_train_size else F.lit(0)
        role = F.when((at >= start) & (at < start + size), "test").when((at < start) & (at >= low), "train")
        return each.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(self.n_splits - 1)))).select("split", "id", role.alias("role")).filter("role IS NOT NULL")

    split = GroupShuffleSplit.split


def train_test_split(df: DataFrame, test_size: float = 0.1, train_size: float | None = None, stratify: bool = False, random_seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """One split of exact sizes."""
    return next((StratifiedShuffleSplit if stratify else ShuffleSplit)(1, test_size, train_size, random_seed).split(df))


class CrossValidation:
    """Fits a copy of the estimator for every split; perform returns test_score, train_score and fit_time (seconds)."""

    def __init__(self, estimator: Estimator, splitter, evaluator: Callable[[DataFrame], DataFrame] | None = None, return_train_score: bool = False, needs: str = "predict"):
        self.estimator, self.splitter, self.evaluator, self.return_train_score, self.needs = estimator, splitter, evaluator, return_train_score, needs

    def _score(self, fitted: Estimator, df: DataFrame) -> float:
        if self.evaluator is None:
            return fitted.score(df)
        return self.evaluator(getattr(fitted, self.needs)(df)).first()[0]

    def perform(self, df: DataFrame) -> dict[str, list[float] | None]:
        out: dict[str, Any] = {"test_score": [], "train_score": [] if self.return_train_score else None, "fit_time": []}
        for train, test in self.splitter.split(df):
            began = time.time()
            fitted = self.estimator.copy().fit(train)
            out["fit_time"].append(time.time() - began)
            out["test_score"].append(self._score(fitted, test))
            if self.return_train_score:
                out["train_score"].append(self._score(fitted, train))
        return out


class GridSearchCV(Estimator):
    """Every combination of param_grid by cross-validation; the first best is fitted on all rows."""

    def __init__(self, estimator: Estimator, param_grid: dict[str, list] | list[dict[str, list]], splitter, evaluator: Callable | None = None, greater_is_better: bool = True):
        self.estimator, self.param_grid, self.splitter, self.evaluator, self.greater_is_better = estimator, param_grid, splitter, evaluator, greater_is_better

    def fit(self, df: DataFrame) -> GridSearchCV:
        grids = self.param_grid if isinstance(self.param_grid, list) else [self.param_grid]
        sets = [dict(zip(g, values, strict=True)) for g in grids for values in product(*g.values())]
        splits = [(a.persist(), b.persist()) for a, b in self.splitter.split(df)]
        fixed = type("Fixed", (), {"split": lambda self, _: iter(splits)})()
        self.cv_results = []
        for params in sets:
            scores = CrossValidation(self.estimator.copy().set_params(**params), fixed, self.evaluator).perform(df)["test_score"]
            self.cv_results.append({"params": params, "mean_test_score": sum(scores) / len(scores), "std_test_score": math.sqrt(sum((s - sum(scores) / len(scores)) ** 2 for s in scores) / len(scores)), "test_scores": scores})
        pick = max if self.greater_is_better else min
        self.best_index = pick(range(len(sets)), key=lambda k: self.cv_results[k]["mean_test_score"])
        self.best_params, self.best_score = sets[self.best_index], self.cv_results[self.best_index]["mean_test_score"]
        self.best_estimator = self.estimator.copy().set_params(**self.best_params).fit(df)
        return self

    def __getattr__(self, name: str):
        if name in ("predict", "predict_proba", "predict_log_proba", "decision_function", "transform", "score"):
            return getattr(self.__dict__["best_estimator"], name)
        raise AttributeError(name)


class Pipeline(Estimator):
    """Named steps in order; all but the last transform. A step of None is skipped; step__param reaches into steps."""

    def __init__(self, steps: dict[str, Estimator | None]):
        self.steps = steps

    def copy(self) -> Pipeline:
        return Pipeline({k: s.copy() if s else None for k, s in self.steps.items()})

    def set_params(self, **new: Any) -> Pipeline:
        for k, v in new.items():
            step, _, name = k.partition("__")
            self.steps[step].set_params(**{name: v})
        return self

    def _before(self, df: DataFrame, fit: bool) -> DataFrame:
        for step in list(self.steps.values())[:-1]:
            if step:
                df = (step.fit(df) if fit else step).transform(df)
        return df

    @property
    def last(self) -> Estimator | None:
        return list(self.steps.values())[-1]

    def fit(self, df: DataFrame) -> Pipeline:
        df = self._before(df, True)
        if self.last:
            self.last.fit(df)
        return self

    def _through(name: str):  # noqa: N805
        def call(self, df: DataFrame):
            return getattr(self.last, name)(self._before(df, False))

        call.__name__ = name
        return call

    predict, predict_proba, predict_log_proba, decision_function, score = map(_through, ("predict", "predict_proba", "predict_log_proba", "decision_function", "score"))

    def transform(self, df: DataFrame) -> DataFrame:
        df = self._before(df, False)
        return self.last.transform(df) if self.last else df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.last.fit_predict(self._before(df, True))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for step in reversed([s for s in self.steps.values() if s]):
            df = step.inverse_transform(df)
        return df


class FeatureUnion(Estimator):
    """Outputs of several transformers side by side."""

    def __init__(self, transformers: dict[str, Estimator]):
        self.transformers = transformers

    def fit(self, df: DataFrame) -> FeatureUnion:
        for t in self.transformers.values():
            t.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        names = []
        own = df.withColumn("_x", F.col("features"))
        for k, t in enumerate(self.transformers.values()):
            own = t.transform(own.withColumn("features", F.col("_x"))).withColumnRenamed("features", f"_x{k}").withColumn("features", F.col("_x"))
            names.append(f"_x{k}")
        return own.withColumn("features", F.concat(*names)).drop("_x", *names)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
