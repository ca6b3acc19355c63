"""Linear models. Least squares work on X'X and X'y, one distributed sum; the others descend along distributed gradients.

The bias is a feature of constant value bias_scale, and so it is regularised like the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import gram, lbfgs, sums, width, with_numpy
from quern.operators.base import Classifier, Estimator, Regressor, classes_of, decided, labels, platt, samples, sigmoid, targets


class BaseEstimator(Estimator):
    """Weights with the bias apart."""

    fit_bias, bias_scale = True, 1.0

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.full((len(x), 1), self.bias_scale)]) if self.fit_bias else x

    def _split(self, w: np.ndarray) -> None:
        """w [outputs, features (+ bias)]."""
        self.weight_vec = w[:, :-1] if self.fit_bias else w
        self.bias_term = w[:, -1] * self.bias_scale if self.fit_bias else np.zeros(len(w))

    def _z(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight_vec.T + self.bias_term

    def _gram(self, df: DataFrame):
        df = targets(samples(df))
        self.many = dict(df.dtypes)["target"].startswith("array")
        return gram(df, "target", self.bias_scale if self.fit_bias else None)


class _Regression(BaseEstimator, Regressor):
    def predict(self, df: DataFrame) -> DataFrame:
        if self.many:
            return with_numpy(samples(df), "prediction", "array<double>", ["features"], self._z)
        return with_numpy(samples(df), "prediction", "double", ["features"], lambda x: self._z(x)[:, 0])


class LinearRegression(_Regression):
    """Ordinary least squares by the pseudo-inverse of X'X."""

    def __init__(self, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4, solver: str = "auto"):
        self.fit_bias, self.bias_scale, self.max_iter, self.tol, self.solver = fit_bias, bias_scale, max_iter, tol, solver

    def fit(self, df: DataFrame) -> LinearRegression:
        a, b, n = self._gram(df)
        if self.solver == "lbfgs":
            self._split(np.stack([lbfgs(lambda w, k=k: ((w @ a @ w - 2 * b[:, k] @ w) / n, 2 * (a @ w - b[:, k]) / n), np.zeros(len(a)), self.max_iter, self.tol) for k in range(b.shape[1])]))
        else:
            self._split((np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b).T)
        return self


class Ridge(_Regression):
    """(X'X + reg I) w = X'y; solver lbfgs takes the loss as a mean, but not the penalty."""

    def __init__(self, reg_param: float = 1.0, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4, solver: str = "auto"):
        self.reg_param, self.fit_bias, self.bias_scale, self.max_iter, self.tol, self.solver = reg_param, fit_bias, bias_scale, max_iter, tol, solver

    def fit(self, df: DataFrame) -> Ridge:
        a, b, n = self._gram(df)
        if self.solver == "lbfgs":
            r = self.reg_param
            self._split(np.stack([lbfgs(lambda w, k=k: ((w @ a @ w - 2 * b[:, k] @ w) / n + r * w @ w, 2 * (a @ w - b[:, k]) / n + 2 * r * w), np.zeros(len(a)), self.max_iter, self.tol) for k in range(b.shape[1])]))
        else:
            self._split(np.linalg.solve(a + self.reg_param * np.eye(len(a)), b).T)
        return self


class ElasticNet(_Regression):
    """Cyclic coordinate descent on X'X: w_j <- S(x_j.r, l1) / (|x_j|^2 + l2); several outputs shrink together."""

    def __init__(self, reg_param: float = 1.0, l1_ratio: float = 0.5, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4):
        self.reg_param, self.l1_ratio, self.fit_bias, self.bias_scale, self.max_iter, self.tol = reg_param, l1_ratio, fit_bias, bias_scale, max_iter, tol

    def fit(self, df: DataFrame) -> ElasticNet:
        a, b, _ = self._gram(df)
        one, two = self.reg_param * self.l1_ratio, self.reg_param * (1 - self.l1_ratio)
        w = np.zeros_like(b)
        for self.n_iter in range(1, self.max_iter + 1):
            before = w.copy()
            for j in range(len(a)):
                if a[j, j] == 0:
                    continue
                z = b[j] - a[j] @ w + a[j, j] * w[j]
                size = np.sqrt(z @ z)
                w[j] = max(1 - one / size, 0.0) * z / (a[j, j] + two) if size else 0.0
            if np.abs(w - before).max() <= self.tol:
                break
        self._split(w.T)
        return self


class Lasso(ElasticNet):
    """ElasticNet with the whole penalty on magnitudes."""

    def __init__(self, reg_param: float = 1.0, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4):
        super().__init__(reg_param, 1.0, fit_bias, bias_scale, max_iter, tol)


class NNLS(_Regression):
    """Least squares with weights of zero or more, and reg |w|^2; loss is a mean."""

    def __init__(self, reg_param: float = 1.0, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4):
        self.reg_param, self.fit_bias, self.bias_scale, self.max_iter, self.tol = reg_param, fit_bias, bias_scale, max_iter, tol

    def fit(self, df: DataFrame) -> NNLS:
        a, b, n = self._gram(df)
        a, b = a / n + self.reg_param * np.eye(len(a)), b / n
        w = np.zeros_like(b)
        for _ in range(self.max_iter * 10):  # projected coordinate descent
            before = w.copy()
            for j in range(len(a)):
                if a[j, j] > 0:
                    w[j] = np.maximum(0.0, w[j] + (b[j] - a[j] @ w) / a[j, j])
            if np.abs(w - before).max(initial=0.0) <= self.tol * 1e-6:
                break
        self._split(w.T)
        return self


class _Descent(BaseEstimator):
    """Losses whose sum and gradient over rows are one distributed sum a step."""

    def _minimise(self, df: DataFrame, columns: list[str], size: int, of: Callable[..., tuple[float, np.ndarray]], reg: float, mean: bool) -> np.ndarray:
        rows = df.select("features", *columns).persist()
        n = rows.count() if mean else 1

        def at(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(x: np.ndarray, *y: np.ndarray) -> np.ndarray:
                loss, g = of(self._wide(x), w, *y)
                return np.concatenate([[loss], g.ravel()])

            flat = sums(rows, ["features", *columns], part)
            return flat[0] / n + 0.5 * reg * w @ w, flat[1:] / n + reg * w

        found = lbfgs(at, np.zeros(size), self.max_iter, self.tol)
        rows.unpersist()
        return found


class LogisticRegression(_Descent, Classifier):
    """Binary logistic loss, or softmax of several classes; probabilities of several are normalised sigmoids."""

    def __init__(self, reg_param: float = 1.0, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4):
        self.reg_param, self.fit_bias, self.bias_scale, self.max_iter, self.tol = reg_param, fit_bias, bias_scale, max_iter, tol

    def fit(self, df: DataFrame) -> LogisticRegression:
        df = labels(samples(df))
        self.classes = classes_of(df)
        d = width(df) + self.fit_bias
        if len(self.classes) <= 2:

            def of(x, w, y):
                t = np.where(y == self.classes[-1], 1.0, -1.0)
                z = t * (x @ w)
                return np.logaddexp(0, -z).sum(), x.T @ (-t * sigmoid(-z))

            self._split(self._minimise(df, ["label"], d, of, self.reg_param, False)[None])
            return self
        known, k = np.array(self.classes), len(self.classes)

        def of(x, w, y):
            z = x @ w.reshape(k, d).T
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            hot = y[:, None] == known
            return -z[hot].sum(), (np.exp(z) - hot).T @ x

        self._split(self._minimise(df, ["label"], d * k, of, self.reg_param, False).reshape(k, d))
        return self

    def _proba(self, x: np.ndarray) -> np.ndarray:
        p = sigmoid(self._z(x))
        return np.hstack([1 - p, p]) if len(self.classes) <= 2 else p / p.sum(1, keepdims=True)

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), lambda x: np.hstack([-self._z(x), self._z(x)]) if len(self.classes) == 2 else self._z(x))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "probability", "array<double>", ["features"], self._proba)


class SVC(_Descent, Classifier):
    """Squared hinge loss, one class against the rest; probability=True calibrates by Platt's sigmoid."""

    def __init__(self, reg_param: float = 1.0, fit_bias: bool = True, bias_scale: float = 1.0, max_iter: int = 1000, tol: float = 1e-4, probability: bool = False):
        self.reg_param, self.fit_bias, self.bias_scale, self.max_iter, self.tol, self.probability = reg_param, fit_bias, bias_scale, max_iter, tol, probability

    def fit(self, df: DataFrame) -> SVC:
        df = labels(samples(df))
        self.classes = classes_of(df)
        sides = self.classes[-1:] if len(self.classes) <= 2 else self.classes
        k, d = len(sides), width(df) + self.fit_bias
        known = np.array(sides)

        def of(x, w, y):  # all sides in one pass: their losses do not touch
            t = np.where(y[:, None] == known, 1.0, -1.0)
            gap = np.maximum(0.0, 1 - t * (x @ w.reshape(k, d).T))
            return (gap**2).sum(), (-2 * t * gap).T @ x

        self._split(self._minimise(df, ["label"], k * d, of, self.reg_param, True).reshape(k, d))
        self.prob_param = []
        if self.probability:
            for i, c in enumerate(sides):
                rows = with_numpy(df, "_f", "double", ["features"], lambda x, i=i: self._z(x)[:, i]).withColumn("_y", F.when(F.col("label") == c, 1).otherwise(-1))
                self.prob_param.append(platt(rows, "_f", "_y"))
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), lambda x: np.hstack([-self._z(x), self._z(x)]) if len(self.classes) == 2 else self._z(x))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if not self.prob_param:
            raise ValueError("fit with probability=True")

        def of(x: np.ndarray) -> np.ndarray:
            p = np.stack([sigmoid(-(a * z + b)) for z, (a, b) in zip(self._z(x).T, self.prob_param, strict=True)], axis=1)
            return np.hstack([1 - p, p]) if p.shape[1] == 1 else p / p.sum(1, keepdims=True)

        return with_numpy(samples(df), "probability", "array<double>", ["features"], of)


class SVR(_Descent, Regressor):
    """Squared epsilon-insensitive loss. compat=True gives samples within the tube below the target a gradient too."""

    predict = _Regression.predict

    def __init__(self, reg_param: float = 1.0, fit_bias: bool = True, bias_scale: float = 1.0, epsilon: float = 0.1, max_iter: int = 1000, tol: float = 1e-4, compat: bool = False):
        self.reg_param, self.fit_bias, self.bias_scale, self.epsilon, self.max_iter, self.tol, self.compat = reg_param, fit_bias, bias_scale, epsilon, max_iter, tol, compat

    def fit(self, df: DataFrame) -> SVR:
        df = targets(samples(df))
        self.many = dict(df.dtypes)["target"].startswith("array")
        e, d = self.epsilon, width(df) + self.fit_bias

        def of(x, w, y):
            y = y.reshape(len(x), -1)
            gap = x @ w.reshape(y.shape[1], d).T - y
            low = gap < (e if self.compat else -e)
            g = np.where(gap > e, 2 * (gap - e), np.where(low, 2 * (gap + e), 0.0))
            return (np.maximum(0.0, np.abs(gap) - e) ** 2).sum(), g.T @ x

        m = df.select(F.size("target")).first()[0] if self.many else 1
        self._split(self._minimise(df, ["target"], m * d, of, self.reg_param, True).reshape(m, d))
        return self


# The parts of stochastic descent: losses give (loss, derivative by z) of scores z and targets y.
def squared_loss(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    return float(((z - y) ** 2).mean()), 2 * (z - y)


def log_loss(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    return float(np.logaddexp(0, -y * z).mean()), y / (1 + np.exp(np.clip(-y * z, -500, 500))) - y


def hinge_loss(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    return float(np.maximum(0, 1 - y * z).mean()), np.where(y * z < 1, -y, 0.0)


def epsilon_insensitive(epsilon: float = 0.1) -> Callable:
    return lambda z, y: (float(np.maximum(0, np.abs(z - y) - epsilon).mean()), np.where(np.abs(z - y) > epsilon, np.sign(z - y), 0.0))


class L2Penalty:
    """w - reg * rate * w."""

    def __init__(self, reg_param: float):
        self.reg_param = reg_param

    def __call__(self, w: np.ndarray, rate: float) -> np.ndarray:
        return w - self.reg_param * rate * w


class L1Penalty:
    """Truncated cumulative penalty: a weight never crosses zero, and owes what it has not paid yet."""

    def __init__(self, reg_param: float):
        self.reg_param, self.due, self.paid = reg_param, 0.0, 0.0

    def __call__(self, w: np.ndarray, rate: float) -> np.ndarray:
        self.due += self.reg_param * rate
        new = np.where(w > 0, np.maximum(0, w - (self.due + self.paid)), np.where(w < 0, np.minimum(0, w + (self.due - self.paid)), w))
        self.paid = self.paid + new - w
        return new


class SGD:
    """Momentum with a rate of learning_rate / (1 + decay t)."""

    def __init__(self, learning_rate: float = 0.01, momentum: float = 0.0, decay: float = 0.0):
        self.learning_rate, self.momentum, self.decay, self.t, self.update = learning_rate, momentum, decay, 0, 0.0

    @property
    def rate(self) -> float:
        return self.learning_rate / (1 + self.decay * self.t)

    def __call__(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.update = self.momentum * self.update - self.rate * g
        self.t += 1
        return w + self.update


class SGDEstimator(BaseEstimator):
    """Mini-batch descent over batches that stream to the driver in the order of a hash; weights and momentum stay between
    calls of partial_fit, one epoch each. At scale a batch is a distributed gradient over a hash class (distributed=True)."""

    losses: dict[str, Callable] = {}

    def __init__(self, loss: str = "", learning_rate: float = 0.01, decay: float | None = None, momentum: float = 0.9, penalty: str = "l2", reg_param: float = 1.0, l1_ratio: float = 0.5, fit_bias: bool = True, bias_scale: float = 1.0, epsilon: float = 0.1, max_iter: int = 1000, batch_size: int = 50, tol: float = 1e-4, random_seed: int = 0, distributed: bool = False):
        self.loss, self.learning_rate, self.decay, self.momentum, self.penalty, self.reg_param, self.l1_ratio = loss or self.default_loss, learning_rate, decay, momentum, penalty, reg_param, l1_ratio
        self.fit_bias, self.bias_scale, self.epsilon, self.max_iter, self.batch_size, self.tol, self.random_seed, self.distributed = fit_bias, bias_scale, epsilon, max_iter, batch_size, tol, random_seed, distributed

    def _start(self, d: int) -> dict:
        one = {"l1": 1.0, "l2": 0.0, "elasticnet": self.l1_ratio}[self.penalty]
        decay = self.decay if self.decay is not None else self.reg_param * self.learning_rate
        return {"w": np.zeros(d), "sgd": SGD(self.learning_rate, self.momentum, decay), "l2": L2Penalty(self.reg_param * (1 - one)) if one < 1 else None, "l1": L1Penalty(self.reg_param * one) if one > 0 else None}

    def _step(self, state: dict, loss: float, g: np.ndarray) -> None:
        rate = state["sgd"].rate
        state["w"] = state["sgd"](state["w"], g)
        if state["l2"]:
            state["w"] = state["l2"](state["w"], rate)
        if state["l1"]:
            state["w"] = state["l1"](state["w"], rate)

    def _of(self) -> Callable:
        return epsilon_insensitive(self.epsilon) if self.loss == "epsilon_insensitive" else {"hinge": hinge_loss, "log_loss": log_loss, "squared_error": squared_loss}[self.loss]

    def _gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        loss, dz = self._of()(x @ w, y)
        return loss, np.clip(dz, -1e12, 1e12) @ x / len(x)

    def _descend(self, df: DataFrame, goal: Callable[[np.ndarray], np.ndarray], column: str, epochs: int, state: dict | None) -> dict:
        if state is None:
            state = self._start(width(df) + self.fit_bias)
        if self.distributed:
            return self._far(df, goal, column, epochs, state)
        from quern.functions.numeric import collected

        x, y = collected(df, ["features", column], 1_000_000)
        x, y, rng = self._wide(x), goal(y), np.random.default_rng(self.random_seed)
        for _ in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(x), self.batch_size):
                pick = order[at : at + self.batch_size]
                loss, g = self._gradient(state["w"], x[pick], y[pick])
                self._step(state, loss, g)
                losses.append(loss)
            if np.mean(losses) < self.tol:
                break
        return state

    def _far(self, df: DataFrame, goal: Callable, column: str, epochs: int, state: dict) -> dict:
        """An epoch is 16 steps over hash classes of rows, each one distributed sum."""
        rows = df.withColumn("_class", F.pmod(F.xxhash64("id", F.lit(self.random_seed)), F.lit(16))).persist()
        for _ in range(epochs):
            losses = []
            for k in range(16):

                def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                    loss, g = self._gradient(state["w"], self._wide(x), goal(y))
                    return np.concatenate([[loss * len(x), len(x)], g * len(x)])

                flat = sums(rows.filter(F.col("_class") == k), ["features", column], part)
                if len(flat) and flat[1]:
                    self._step(state, flat[0] / flat[1], flat[2:] / flat[1])
                    losses.append(flat[0] / flat[1])
            if losses and np.mean(losses) < self.tol:
                break
        rows.unpersist()
        return state


class SGDClassifier(SGDEstimator, Classifier):
    """hinge or log_loss, one class against the rest; partial_fit takes two classes."""

    default_loss = "hinge"

    def fit(self, df: DataFrame) -> SGDClassifier:
        df = labels(samples(df))
        self.classes = classes_of(df)
        sides = self.classes[-1:] if len(self.classes) <= 2 else self.classes
        found = [self._descend(df, lambda y, c=c: np.where(y == c, 1.0, -1.0), "label", self.max_iter, None)["w"] for c in sides]
        self._split(np.stack(found))
        return self

    def partial_fit(self, df: DataFrame) -> SGDClassifier:
        """One epoch from where the last call ended."""
        df = labels(samples(df))
        if not hasattr(self, "_state"):
            self.classes, self._state = classes_of(df), None
        if len(self.classes) != 2:
            raise ValueError("partial_fit takes two classes")
        self._state = self._descend(df, lambda y: np.where(y == self.classes[1], 1.0, -1.0), "label", 1, self._state)
        self._split(self._state["w"][None])
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return decided(samples(df), lambda x: np.hstack([-self._z(x), self._z(x)]) if len(self.classes) == 2 else self._z(x))

    predict_proba = LogisticRegression.predict_proba
    _proba = LogisticRegression._proba


class SGDRegressor(SGDEstimator, Regressor):
    """squared_error or epsilon_insensitive; several outputs one by one."""

    default_loss = "squared_error"
    predict = _Regression.predict

    def _outputs(self, df: DataFrame) -> int:
        self.many = dict(df.dtypes)["target"].startswith("array")
        return df.select(F.size("target")).first()[0] if self.many else 1

    def fit(self, df: DataFrame) -> SGDRegressor:
        df = targets(samples(df))
        m = self._outputs(df)
        self._split(np.stack([self._descend(df, lambda y, k=k: y.reshape(len(y), -1)[:, k], "target", self.max_iter, None)["w"] for k in range(m)]))
        return self

    def partial_fit(self, df: DataFrame) -> SGDRegressor:
        """One epoch from where the last call ended."""
        df = targets(samples(df))
        if self._outputs(df) != 1:
            raise ValueError("partial_fit takes one output")
        self._state = self._descend(df, lambda y: y, "target", 1, getattr(self, "_state", None))
        self._split(self._state["w"][None])
        return self
