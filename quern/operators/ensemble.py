"""Ensembles: forests grow all trees in the same jobs; boosting rounds follow one another over the distributed rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import sums, width, with_numpy
from quern.operators.base import Classifier, Estimator, Regressor, classes_of, decided, labels, samples, sigmoid, targets
from quern.operators.selection import KFold, StratifiedKFold
from quern.operators.tree import Grower, Tables, _Tree, _TreeClassifier, _TreeRegressor, importances


class _Forest:
    _bootstrap = False

    def __init__(self, n_estimators: int = 10, criterion: str | None = None, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 128):
        super().__init__(criterion, max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins)
        self.n_estimators = n_estimators

    @property
    def _count(self) -> int:
        return self.n_estimators

    def _grower(self, **more) -> Grower:
        return super()._grower(max_features=self.max_features or max(1, math.isqrt(self.width)), **more)


class RandomForestClassifier(_Forest, _TreeClassifier):
    """Bootstrap trees over sqrt(d) features a node; majority vote."""

    _bootstrap = True


class RandomForestRegressor(_Forest, _TreeRegressor):
    """Mean of bootstrap trees."""

    _bootstrap = True


class ExtraTreesClassifier(_Forest, _TreeClassifier):
    """All rows, random thresholds."""

    kind = "random"


class ExtraTreesRegressor(_Forest, _TreeRegressor):
    """All rows, random thresholds."""

    kind = "random"


class VRTreesClassifier(_Forest, _TreeClassifier):
    """Trees of rising chances of the best split: i * 0.5 / n."""

    kind = "variable"

    def _alphas(self):
        return [i * 0.5 / self.n_estimators for i in range(self.n_estimators)]


class VRTreesRegressor(_Forest, _TreeRegressor):
    """Trees of rising chances of the best split: i * 0.5 / n."""

    kind = "variable"
    _alphas = VRTreesClassifier._alphas


def _hot(known: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (y[:, None] == known).astype(float)


class AdaBoostClassifier(_TreeClassifier):
    """SAMME.R on weighted trees: weights w exp(-((K - 1) / K) sum code ln p). Weights stand in for weighted resampling."""

    def __init__(self, n_estimators: int = 50, criterion: str | None = None, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 128):
        super().__init__(criterion, max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins)
        self.n_estimators = n_estimators

    def fit(self, df: DataFrame) -> AdaBoostClassifier:
        df, _, _, k = self._columns(df)
        self.width, known = width(df), np.array(self.classes)
        rows, self.trees = df.withColumn("_w", F.lit(1.0)).persist(), []
        for turn in range(self.n_estimators):
            grower = self._grower()
            grower.random_seed += turn
            self.trees += grower.grow(rows, ["label", "_w"], lambda y, w: _hot(known, y) * w[:, None], k)
            tables, values = Tables(self.trees[-1:]), np.array([n.value for n in self.trees[-1]])

            def weighed(x, y, w, tables=tables, values=values):
                p = np.clip(values[tables.route(x, 0)], 1e-15, 1)
                code = np.where(_hot(known, y) > 0, 1.0, -1.0 / (k - 1))
                return w * np.exp(-(k - 1) / k * (code * np.log(p)).sum(1))

            def missed(x, y, w, tables=tables, values=values):
                return np.array([(w * (known[values[tables.route(x, 0)].argmax(1)] != y)).sum(), weighed(x, y, w).sum(), len(x)])

            error, total, n = sums(rows, ["features", "label", "_w"], missed)
            if error <= 0 or turn == self.n_estimators - 1:
                break
            new = with_numpy(rows, "_w", "double", ["features", "label", "_w"], lambda x, y, w: weighed(x, y, w) * n / total).persist()
            new.count()
            rows.unpersist()
            rows = new
        rows.unpersist()
        self._done()
        return self

    def _decide(self, x: np.ndarray) -> np.ndarray:
        k, out = len(self.classes), 0.0
        for t, v in enumerate(self.values):
            logs = np.log(np.clip(v[self.tables.route(x, t)], 1e-15, 1))
            out = out + (k - 1) * (logs - logs.mean(1, keepdims=True))
        return out

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), self._decide)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        def of(x: np.ndarray) -> np.ndarray:
            z = self._decide(x) / (len(self.classes) - 1)
            z = np.exp(z - z.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)

        return with_numpy(samples(df), "probability", "array<double>", ["features"], of)


class AdaBoostRegressor(_TreeRegressor):
    """AdaBoost.RT: rows whose relative error exceeds threshold keep their weight, others lose by error^exponent."""

    def __init__(self, n_estimators: int = 10, threshold: float = 0.2, exponent: float = 1.0, criterion: str | None = None, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 128):
        super().__init__(criterion, max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins)
        self.n_estimators, self.threshold, self.exponent = n_estimators, threshold, exponent

    def fit(self, df: DataFrame) -> AdaBoostRegressor:
        df, _, _, _ = self._columns(df)
        if self.many:
            raise ValueError("one output only")
        self.width = width(df)
        rows, self.trees, self.estimator_weights = df.withColumn("_w", F.lit(1.0)).persist(), [], []
        for turn in range(self.n_estimators):
            grower = self._grower()
            grower.random_seed += turn
            self.trees += grower.grow(rows, ["target", "_w"], lambda y, w: np.stack([w, w * y, w * y * y], axis=1), 3)
            tables, values = Tables(self.trees[-1:]), np.array([n.value[0] for n in self.trees[-1]])

            def off(x, y, tables=tables, values=values):
                with np.errstate(divide="ignore", invalid="ignore"):
                    return np.abs((values[tables.route(x, 0)] - y) / y) > self.threshold

            error, total, n = sums(rows, ["features", "target", "_w"], lambda x, y, w: np.array([(w * off(x, y)).sum(), w.sum(), len(x)]))
            share = min(max(error / total, 1e-12), 1 - 1e-12)
            beta = share**self.exponent
            self.estimator_weights.append(math.log(1 / beta))
            if error <= 0 or turn == self.n_estimators - 1:
                break
            new = with_numpy(rows, "_w", "double", ["features", "target", "_w"], lambda x, y, w: np.where(off(x, y), w, w * beta) * n / (error + (total - error) * beta)).persist()
            new.count()
            rows.unpersist()
            rows = new
        rows.unpersist()
        self._done()
        return self

    def _means(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.estimator_weights)
        return sum(a * v[self.tables.route(x, t)] for t, (a, v) in enumerate(zip(w, self.values, strict=True))) / w.sum()


class _Boosting(_Tree):
    default = "gradient"

    def __init__(self, n_estimators: int = 100, learning_rate: float = 0.1, reg_lambda: float = 0.0, subsample: float = 1.0, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 128):
        super().__init__("gradient", max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins)
        self.n_estimators, self.learning_rate, self.reg_lambda, self.subsample = n_estimators, learning_rate, reg_lambda, subsample

    def _boost(self, rows: DataFrame, base: float, goal, slopes) -> tuple[list, Tables, list]:
        """Trees on margins that a column carries; slopes(goal, margin) gives g and h. Each round is a grown tree and a projection."""
        rows, trees = rows.withColumn("_f", F.lit(float(base))).persist(), []
        for turn in range(self.n_estimators):
            grower = self._grower(reg_lambda=self.reg_lambda, shrinkage=self.learning_rate)
            grower.random_seed += turn
            own = rows if self.subsample >= 1 else rows.filter(F.pmod(F.xxhash64("id", F.lit(turn + self.random_seed)), F.lit(1 << 20)) < int(self.subsample * (1 << 20)))
            trees += grower.grow(own, [self.column, "_f"], lambda y, f: np.stack([np.ones(len(f)), *slopes(goal(y), f)], axis=1), 3)
            tables, values = Tables(trees[-1:]), np.array([n.value[0] for n in trees[-1]])
            new = with_numpy(rows, "_f", "double", ["features", "_f"], lambda x, f, tables=tables, values=values: f + values[tables.route(x, 0)])
            new = new.persist()
            if turn % 10 == 9:  # cut the lineage where the cluster keeps checkpoints
                folder = rows.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
                new = new.checkpoint() if folder else new
            new.count()
            rows.unpersist()
            rows = new
        rows.unpersist()
        return trees, Tables(trees), [np.array([n.value[0] for n in nodes]) for nodes in trees]

    def _margin(self, x: np.ndarray, k: int) -> np.ndarray:
        base, (_, tables, values) = self.bases[k], self.boosted[k]
        return base + sum(v[tables.route(x, t)] for t, v in enumerate(values))

    def _finish(self) -> None:
        self.feature_importances = sum(importances(b[0], self.width, splits=True) for b in self.boosted)

    def apply(self, df: DataFrame) -> DataFrame:
        all_ = [(tables, t, np.array([n.leaf_id for n in nodes])) for trees, tables, _ in self.boosted for t, nodes in enumerate(trees)]
        return with_numpy(samples(df), "leaves", "array<int>", ["features"], lambda x: np.stack([ids[tables.route(x, t)] for tables, t, ids in all_], axis=1).astype(np.int32))


class GradientBoostingClassifier(_Boosting, Classifier):
    """Newton boosting of the logistic loss, one class against the rest."""

    column = "label"

    def fit(self, df: DataFrame) -> GradientBoostingClassifier:
        df = labels(samples(df))
        self.classes, self.width = classes_of(df), width(df)
        sides = self.classes[-1:] if len(self.classes) <= 2 else self.classes
        self.bases, self.boosted = [], []

        def slopes(y, f):
            g = -2 * y / (1 + np.exp(np.clip(2 * y * f, -500, 500)))
            return g, np.abs(g) * (2 - np.abs(g))

        for c in sides:
            mean = df.agg(F.avg(F.when(F.col("label") == c, 1.0).otherwise(-1.0))).first()[0]
            mean = min(max(mean, -1 + 1e-12), 1 - 1e-12)
            self.bases.append(0.5 * math.log((1 + mean) / (1 - mean)))
            self.boosted.append(self._boost(df.select("id", "features", "label"), self.bases[-1], lambda y, c=c: np.where(y == c, 1.0, -1.0), slopes))
        self._finish()
        return self

    def _decide(self, x: np.ndarray) -> np.ndarray:
        z = np.stack([self._margin(x, k) for k in range(len(self.boosted))], axis=1)
        return np.hstack([-z, z]) if z.shape[1] == 1 else z

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), self._decide)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        def of(x: np.ndarray) -> np.ndarray:
            p = sigmoid(2 * self._decide(x))
            return p / p.sum(1, keepdims=True)

        return with_numpy(samples(df), "probability", "array<double>", ["features"], of)


class GradientBoostingRegressor(_Boosting, Regressor):
    """Boosting of the squared loss, output by output."""

    column = "target"

    def fit(self, df: DataFrame) -> GradientBoostingRegressor:
        df = targets(samples(df))
        self.width, self.many = width(df), dict(df.dtypes)["target"].startswith("array")
        m = df.select(F.size("target")).first()[0] if self.many else 1
        self.bases, self.boosted = [], []
        for k in range(m):
            own = df.select("id", "features", (F.col("target")[k] if self.many else F.col("target")).alias("target"))
            self.bases.append(own.agg(F.avg("target")).first()[0])
            self.boosted.append(self._boost(own, self.bases[-1], lambda y: y, lambda y, f: (f - y, np.ones(len(y)))))
        self._finish()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.many:
            return with_numpy(samples(df), "prediction", "array<double>", ["features"], lambda x: np.stack([self._margin(x, k) for k in range(len(self.boosted))], axis=1))
        return with_numpy(samples(df), "prediction", "double", ["features"], lambda x: self._margin(x, 0))


def _times(column: str, w: float) -> F.Column:
    """An array times a number; a second parameter of the function would be the element's place."""
    return F.transform(column, lambda v: v * w)


class VotingClassifier(Estimator, Classifier):
    """Weighted votes of predictions (hard) or of probabilities (soft)."""

    def __init__(self, estimators: dict[str, Estimator], weights: dict[str, float] | None = None, voting: str = "hard"):
        self.estimators, self.weights, self.voting = estimators, weights, voting

    def fit(self, df: DataFrame) -> VotingClassifier:
        self.classes = classes_of(df)
        for e in self.estimators.values():
            e.fit(df)
        return self

    def _weight(self, name: str) -> float:
        return float((self.weights or {}).get(name, 1.0))

    def _sum(self, df: DataFrame, kind: str) -> DataFrame:
        total = F.array(*[F.lit(0.0)] * len(self.classes))
        out = df
        for i, (name, e) in enumerate(self.estimators.items()):
            w = self._weight(name)
            if kind == "hard":
                out = e.predict(out).withColumnRenamed("prediction", f"_p{i}")
                own = F.array(*[F.when(F.col(f"_p{i}") == c, w).otherwise(0.0) for c in self.classes])
            else:
                out = e.predict_proba(out).withColumnRenamed("probability", f"_p{i}")
                own = _times(f"_p{i}", w)
            total = F.zip_with(total, own, lambda a, b: a + b)
        return out.withColumn("decision", total).drop(*[f"_p{i}" for i in range(len(self.estimators))])

    def decision_function(self, df: DataFrame) -> DataFrame:
        return self._sum(df, self.voting)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        whole = sum(self._weight(n) for n in self.estimators)
        return self._sum(df, "soft").withColumn("probability", F.transform("decision", lambda v: v / whole)).drop("decision")


class VotingRegressor(Estimator, Regressor):
    """Weighted mean of predictions."""

    def __init__(self, estimators: dict[str, Estimator], weights: dict[str, float] | None = None):
        self.estimators, self.weights = estimators, weights

    fit = lambda self, df: (self.__setattr__("fitted", [e.fit(df) for e in self.estimators.values()]), self)[1]

    def predict(self, df: DataFrame) -> DataFrame:
        out, whole, parts = df, 0.0, []
        for i, (name, e) in enumerate(self.estimators.items()):
            w = float((self.weights or {}).get(name, 1.0))
            out = e.predict(out).withColumnRenamed("prediction", f"_p{i}")
            whole += w
            parts.append((f"_p{i}", w))
        if dict(out.dtypes)["_p0"].startswith("array"):
            total = F.transform("_p0", lambda v: v * 0.0)
            for c, w in parts:
                total = F.zip_with(total, _times(c, w / whole), lambda a, b: a + b)
        else:
            total = sum((F.col(c) * w for c, w in parts), F.lit(0.0)) / whole
        return out.withColumn("prediction", total).drop(*[c for c, _ in parts])


class _Stacking(Estimator):
    def _meta(self, df: DataFrame, models: list[Estimator]) -> DataFrame:
        """df with the base models' outputs (and its own features, with passthrough) as features."""
        out, names = df.withColumn("_x", F.col("features")), []
        for i, e in enumerate(models):
            how = self._method(e)
            column = {"predict_proba": "probability", "decision_function": "decision", "predict": "prediction"}[how]
            out = getattr(e, how)(out).withColumnRenamed(column, f"_m{i}")
            if not dict(out.dtypes)[f"_m{i}"].startswith("array"):
                out = out.withColumn(f"_m{i}", F.array(F.col(f"_m{i}").cast("double")))
            names.append(f"_m{i}")
        parts = [F.col(n) for n in names] + [F.col("_x")] * self.passthrough
        return out.withColumn("features", F.concat(*parts)).drop("_x", *names)

    def _learn(self, df: DataFrame, splitter) -> None:
        """Base models on all rows, and the meta model on what copies say of the folds that they have not seen."""
        held = None
        for train, test in splitter.split(df):
            part = self._meta(test, [e.copy().fit(train) for e in self.estimators.values()])
            held = part if held is None else held.unionByName(part)
        for e in self.estimators.values():
            e.fit(df)
        self.meta_estimator.fit(held)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._meta(df, list(self.estimators.values()))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.meta_estimator.predict(self.transform(df))


class StackingClassifier(_Stacking, Classifier):
    """A classifier on base classifiers' out-of-fold outputs: probabilities, else decisions, else predictions."""

    predict = _Stacking.predict

    def __init__(self, estimators: dict[str, Estimator], meta_estimator: Estimator | None = None, n_splits: int = 5, shuffle: bool = True, stack_method: str = "auto", passthrough: bool = False, random_seed: int = 0):
        from quern.operators.linear import LogisticRegression

        self.estimators, self.meta_estimator, self.n_splits, self.shuffle, self.stack_method, self.passthrough, self.random_seed = estimators, meta_estimator or LogisticRegression(), n_splits, shuffle, stack_method, passthrough, random_seed

    def _method(self, e: Estimator) -> str:
        return self.stack_method if self.stack_method != "auto" else next(m for m in ("predict_proba", "decision_function", "predict") if hasattr(e, m))

    def fit(self, df: DataFrame) -> StackingClassifier:
        self.classes = classes_of(df)
        self._learn(df, StratifiedKFold(self.n_splits, self.shuffle, self.random_seed))
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return self.meta_estimator.decision_function(self.transform(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.meta_estimator.predict_proba(self.transform(df))


class StackingRegressor(_Stacking, Regressor):
    """A regressor (Ridge unless given) on base regressors' out-of-fold predictions."""

    predict = _Stacking.predict

    def __init__(self, estimators: dict[str, Estimator], meta_estimator: Estimator | None = None, n_splits: int = 5, shuffle: bool = True, passthrough: bool = False, random_seed: int = 0):
        from quern.operators.linear import Ridge

        self.estimators, self.meta_estimator, self.n_splits, self.shuffle, self.passthrough, self.random_seed = estimators, meta_estimator or Ridge(), n_splits, shuffle, passthrough, random_seed

    def _method(self, e: Estimator) -> str:
        return "predict"

    def fit(self, df: DataFrame) -> StackingRegressor:
        self._learn(df, KFold(self.n_splits, self.shuffle, self.random_seed))
        return self
