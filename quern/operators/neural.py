"""Small networks. MLPs train in numpy on the driver over `limit` rows at most; RBF and RVFL readouts are solved from one distributed sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quern.functions.numeric import collected, sums, width, with_numpy
from quern.operators.base import Classifier, Estimator, Regressor, classes_of, labels, samples, sigmoid, targets
from quern.operators.preprocessing import squared


class Adam:
    """Adam's step of one array."""

    def __init__(self, learning_rate: float = 0.001, decay1: float = 0.9, decay2: float = 0.999):
        self.learning_rate, self.decay1, self.decay2, self.t, self.m, self.v = learning_rate, decay1, decay2, 0, 0.0, 0.0

    def __call__(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.decay1 * self.m + (1 - self.decay1) * g
        self.v = self.decay2 * self.v + (1 - self.decay2) * g * g
        return w - self.learning_rate * (self.m / (1 - self.decay1**self.t)) / (np.sqrt(self.v / (1 - self.decay2**self.t)) + 1e-8)


class Affine:
    """A dense layer; backward steps its weights and hands the gradient on."""

    def __init__(self, n_inputs: int, n_outputs: int, adam: dict, rng: np.random.Generator):
        self.w, self.b = rng.normal(0, np.sqrt(2 / n_inputs), (n_inputs, n_outputs)), np.zeros(n_outputs)
        self.step_w, self.step_b = Adam(**adam), Adam(**adam)

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        return x @ self.w + self.b

    def backward(self, g: np.ndarray) -> np.ndarray:
        back = g @ self.w.T
        self.w, self.b = self.step_w(self.w, self.x.T @ g), self.step_b(self.b, g.sum(0))
        return back


class Dropout:
    """Inverted dropout; backward scales as forward does."""

    def __init__(self, rate: float, rng: np.random.Generator):
        self.rate, self.rng = rate, rng

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.mask = (self.rng.random(x.shape) >= self.rate) / (1 - self.rate)
        return x * self.mask

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g * self.mask


class Relu:
    """max(0, x)."""

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.on = x > 0
        return x * self.on

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g * self.on


def mean_squared_error(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a batch and its gradient."""
    return float(((out - y) ** 2).mean()), 2 * (out - y) / len(y)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def softmax_cross_entropy(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a batch and its gradient."""
    p = softmax(out)
    return float(-(y * np.log(p + 1e-8)).sum() / len(y)), (p - y) / len(y)


class Sequential:
    """A stack of layers."""

    def __init__(self):
        self.layers = []

    def push(self, layer) -> Sequential:
        self.layers.append(layer)
        return self

    def delete_dropout(self) -> Sequential:
        self.layers = [x for x in self.layers if not isinstance(x, Dropout)]
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def backward(self, g: np.ndarray) -> None:
        for layer in reversed(self.layers):
            g = layer.backward(g)


class BaseMLP(Estimator):
    """Mini-batches, ReLU layers, dropout, Adam; stops at a loss below tol."""

    def __init__(self, hidden_units: tuple[int, ...] = (128, 128), dropout_rate: float = 0.4, learning_rate: float = 0.001, decay1: float = 0.9, decay2: float = 0.999, max_iter: int = 200, batch_size: int = 50, tol: float = 1e-4, random_seed: int = 0, limit: int = 200_000):
        self.hidden_units, self.dropout_rate, self.learning_rate, self.decay1, self.decay2 = hidden_units, dropout_rate, learning_rate, decay1, decay2
        self.max_iter, self.batch_size, self.tol, self.random_seed, self.limit = max_iter, batch_size, tol, random_seed, limit

    def _train(self, x: np.ndarray, y: np.ndarray, loss) -> None:
        rng = np.random.default_rng(self.random_seed)
        adam = {"learning_rate": self.learning_rate, "decay1": self.decay1, "decay2": self.decay2}
        self.network, n = Sequential(), x.shape[1]
        for units in self.hidden_units:
            self.network.push(Affine(n, units, adam, rng)).push(Relu())
            if self.dropout_rate > 0:
                self.network.push(Dropout(self.dropout_rate, rng))
            n = units
        self.network.push(Affine(n, y.shape[1], adam, rng))
        for self.n_iter in range(1, self.max_iter + 1):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(x), self.batch_size):
                pick = order[at : at + self.batch_size]
                value, g = loss(self.network.forward(x[pick]), y[pick])
                self.network.backward(g)
                losses.append(value)
            if np.mean(losses) < self.tol:
                break
        self.network.delete_dropout()


class MLPClassifier(BaseMLP, Classifier):
    """Softmax over classes."""

    def fit(self, df: DataFrame) -> MLPClassifier:
        x, y = collected(labels(samples(df)), ["features", "label"], self.limit)
        self.classes = np.unique(y).tolist()
        self._train(x, (y[:, None] == np.array(self.classes)).astype(float), softmax_cross_entropy)
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "decision", "array<double>", ["features"], self.network.forward)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "probability", "array<double>", ["features"], lambda x: softmax(self.network.forward(x)))


class MLPRegressor(BaseMLP, Regressor):
    """Squared error."""

    def fit(self, df: DataFrame) -> MLPRegressor:
        df = targets(samples(df))
        self.many = dict(df.dtypes)["target"].startswith("array")
        x, y = collected(df, ["features", "target"], self.limit)
        self._train(x, y.reshape(len(x), -1), mean_squared_error)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.many:
            return with_numpy(samples(df), "prediction", "array<double>", ["features"], self.network.forward)
        return with_numpy(samples(df), "prediction", "double", ["features"], lambda x: self.network.forward(x)[:, 0])


class _Readout(Estimator):
    """(H'H + I / reg)^-1 H'Y of hidden outputs H, from one distributed sum."""

    def _solve(self, df: DataFrame, column: str, of) -> None:
        k = self._hidden_size

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            h = self._hidden(x)
            return np.hstack([h.T @ h, h.T @ of(y)])

        flat = sums(df, ["features", column], part).reshape(k, -1)
        self.weight_vec = np.linalg.solve(flat[:, :k] + np.eye(k) / self.reg_param, flat[:, k:])

    def _out(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.weight_vec


class _ReadoutClassifier(Classifier):
    def fit(self, df: DataFrame):
        df = labels(samples(df))
        self.classes = classes_of(df)
        known = np.array(self.classes)
        self._prepare(df)
        self._solve(df, "label", lambda y: np.where(y[:, None] == known, 1.0, -1.0))
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "decision", "array<double>", ["features"], self._out)


class _ReadoutRegressor(Regressor):
    def fit(self, df: DataFrame):
        df = targets(samples(df))
        self.many = dict(df.dtypes)["target"].startswith("array")
        self._prepare(df)
        self._solve(df, "target", lambda y: y.reshape(len(y), -1))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.many:
            return with_numpy(samples(df), "prediction", "array<double>", ["features"], self._out)
        return with_numpy(samples(df), "prediction", "double", ["features"], lambda x: self._out(x)[:, 0])


class BaseRBF(_Readout):
    """Gaussians around k-means centres."""

    def __init__(self, hidden_units: int = 128, gamma: float | None = None, reg_param: float = 100.0, normalize: bool = False, max_iter: int = 50, tol: float = 1e-4, random_seed: int = 0):
        self.hidden_units, self.gamma, self.reg_param, self.normalize, self.max_iter, self.tol, self.random_seed = hidden_units, gamma, reg_param, normalize, max_iter, tol, random_seed

    def _prepare(self, df: DataFrame) -> None:
        from quern.operators.clustering import KMeans

        self.centers = KMeans(self.hidden_units, max_iter=self.max_iter, tol=self.tol, random_seed=self.random_seed).fit(df).cluster_centers
        self._hidden_size = len(self.centers)

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        h = np.exp(-(self.gamma or 1 / x.shape[1]) * squared(x, self.centers))
        return h / np.maximum(h.sum(1, keepdims=True), 1e-300) if self.normalize else h


class RBFClassifier(_ReadoutClassifier, BaseRBF):
    """The class of the largest readout."""


class RBFRegressor(_ReadoutRegressor, BaseRBF):
    """Readouts as predictions."""


class BaseRVFL(_Readout):
    """The features themselves and sigmoids of random projections."""

    def __init__(self, hidden_units: int = 128, reg_param: float = 100.0, scale: float = 1.0, random_seed: int = 0):
        self.hidden_units, self.reg_param, self.scale, self.random_seed = hidden_units, reg_param, scale, random_seed

    def _prepare(self, df: DataFrame) -> None:
        d, rng = width(df), np.random.default_rng(self.random_seed)
        self.random_weight = self.scale * (2 * rng.random((d, self.hidden_units)) - 1)
        self.random_bias = self.scale * rng.random(self.hidden_units)
        self._hidden_size = d + self.hidden_units

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, sigmoid(x @ self.random_weight + self.random_bias)])


class RVFLClassifier(_ReadoutClassifier, BaseRVFL):
    """The class of the largest readout."""


class RVFLRegressor(_ReadoutRegressor, BaseRVFL):
    """Readouts as predictions."""
