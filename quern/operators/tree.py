"""Decision trees, grown level by level over the distributed rows.

Split candidates are midpoints of a feature's distinct values, or of `max_bins` of its quantiles where it has more. Rows
hold the numbers of their bins. Large nodes are split level by level: a job routes every row through all trees grown so far
and adds up, for each tree, open node, feature and bin, the statistics of the target, and the driver picks splits from these
sums; a job takes as many nodes as have `CELLS` sums, so that neither a task nor the driver holds more. Nodes of
`CELLS / features` rows or fewer wait until no larger one is open; then their rows are dealt out by tree and node, and
each is grown to its leaves in a task of its own. So no task holds more than that, however many rows a node has and however
deep trees grow, and a forest grows all of its trees in the same jobs. With max_leaf_nodes, which counts
over the whole tree, all nodes go level by level.

A node of min_samples_leaf rows or fewer is a leaf; a split goes left if x <= threshold. "entropy" is -sum p ln(p + 1).
"""

from __future__ import annotations

import pickle
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import matrix, width, with_numpy
from quern.operators.base import Classifier, Estimator, Regressor, classes_of, labels, samples, targets


#: Most sums that a job adds up, and most bins that a task holds to grow a node on its own (64 MB each).
CELLS = 1 << 23
#: Nodes of up to so many rows are split by sorting their rows instead of by sums over bins.
FEW = 2048


@dataclass
class Node:
    """A node: leaves have value and leaf_id, others feature, threshold and children's numbers."""

    depth: int = 0
    impurity: float = 0.0
    n_samples: float = 0.0
    value: np.ndarray | None = None
    leaf: bool = False
    leaf_id: int = -1
    left: int = -1
    right: int = -1
    feature_id: int = 0
    threshold: float = 0.0
    bin: int = 0
    stats: np.ndarray | None = field(default=None, repr=False)


class Tables:
    """Trees as flat arrays, for routing."""

    def __init__(self, trees: list[list[Node]]):
        self.trees = [tuple(np.array([getattr(n, a) for n in nodes]) for a in ("left", "right", "feature_id", "threshold", "bin")) for nodes in trees]

    def route(self, x: np.ndarray, tree: int, binned: bool = False) -> np.ndarray:
        """The node where every row ends."""
        left, right, feature, threshold, at_bin = self.trees[tree]
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows):
            own = at[rows]
            rows = rows[left[own] >= 0]
            own = at[rows]
            goes = x[rows, feature[own]] <= (at_bin if binned else threshold)[own]
            at[rows] = np.where(goes, left[own], right[own])
        return at


def bins_of(df: DataFrame, d: int, max_bins: int) -> list[np.ndarray]:
    """Thresholds of every feature, rising."""
    few = df.agg(*[F.approx_count_distinct(F.col("features")[j]).alias(f"c{j}") for j in range(d)]).first()
    out = []
    exact = [j for j in range(d) if few[j] <= 2 * max_bins]
    known = df.agg(*[F.array_sort(F.collect_set(F.col("features")[j])).alias(f"v{j}") for j in exact]).first() if exact else []
    values = {j: np.array(v, float) for j, v in zip(exact, known, strict=True)}
    far = [j for j in range(d) if j not in values or len(values[j]) > max_bins]
    if far:
        shares = [k / max_bins for k in range(1, max_bins)]
        row = df.agg(*[F.percentile_approx(F.col("features")[j], shares, 20 * max_bins).alias(f"q{j}") for j in far]).first()
        values |= {j: np.unique(np.array(v, float)) for j, v in zip(far, row, strict=True)}
    for j in range(d):
        v = values[j]
        out.append((v[1:] + v[:-1]) / 2 if j not in far else v)
    return out


class Grower:
    """Grows trees on rows with columns features and what `stats` takes; it gives [rows, k] numbers that add up."""

    def __init__(self, criterion: str, max_depth=None, max_leaf_nodes=None, min_samples_leaf: int = 1, max_features=None, random_seed: int = 0, kind: str = "best", alphas=None, max_bins: int = 512, reg_lambda: float = 0.0, shrinkage: float = 1.0):
        self.criterion, self.max_depth, self.max_leaf_nodes, self.min_samples_leaf, self.max_features = criterion, max_depth, max_leaf_nodes, min_samples_leaf, max_features
        self.random_seed, self.kind, self.alphas, self.max_bins, self.reg_lambda, self.shrinkage = random_seed, kind, alphas, max_bins, reg_lambda, shrinkage

    def impurity(self, s: np.ndarray) -> np.ndarray:
        """Of statistics in the last axis."""
        if self.criterion in ("gini", "entropy"):
            n = s.sum(-1, keepdims=True)
            p = s / np.where(n == 0, 1, n)
            return 1 - (p * p).sum(-1) if self.criterion == "gini" else -(p * np.log(p + 1)).sum(-1)
        if self.criterion == "gradient":
            return -(s[..., 1] ** 2) / np.where(s[..., 2] + self.reg_lambda == 0, 1, s[..., 2] + self.reg_lambda)
        n, m = s[..., 0], (s.shape[-1] - 1) // 2
        by = np.where(n == 0, 1, n)[..., None]
        return np.maximum(s[..., 1 + m :] / by - (s[..., 1 : 1 + m] / by) ** 2, 0).mean(-1)

    def size(self, s: np.ndarray) -> np.ndarray:
        return s.sum(-1) if self.criterion in ("gini", "entropy") else s[..., 0]

    def value(self, s: np.ndarray) -> np.ndarray:
        if self.criterion in ("gini", "entropy"):
            return s / max(s.sum(), 1e-300)
        if self.criterion == "gradient":
            return np.array([-self.shrinkage * s[1] / (s[2] + self.reg_lambda or 1.0)])
        m = (len(s) - 1) // 2
        return s[1 : 1 + m] / max(s[0], 1e-300)

    def grow(self, df: DataFrame, columns: list[str], stats, k: int, n_trees: int = 1, bootstrap: bool = False) -> list[list[Node]]:
        """Trees over df (id, features, columns); bootstrap weighs rows by Poisson draws that hashes of ids decide."""
        d = width(df)
        edges = bins_of(df, d, self.max_bins)
        most = max(len(e) for e in edges) + 1
        rows = with_numpy(df.select("id", "features", *columns), "features", "array<int>", ["features"], lambda x: np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1).astype(np.int32)).persist()
        rng = np.random.default_rng(self.random_seed)
        trees: list[list[Node]] = [[Node(n_samples=float(rows.count()))] for _ in range(n_trees)]
        seeds = rng.integers(0, 1 << 62, n_trees)
        small = max(FEW, CELLS // d) if self.max_leaf_nodes is None else 0
        waiting: list[tuple[int, int]] = []
        open_ = [(t, 0) for t in range(n_trees)]
        while open_:
            waiting += [(t, at) for t, at in open_ if trees[t][at].n_samples <= small]
            large, open_ = [(t, at) for t, at in open_ if trees[t][at].n_samples > small], []
            for low in range(0, len(large), max(1, CELLS // (d * most * k))):
                few = large[low : low + max(1, CELLS // (d * most * k))]
                now = [[at for tree, at in few if tree == t] for t in range(n_trees)]
                sums = self._sums(rows, columns, stats, k, Tables(trees), now, seeds if bootstrap else None, d, most)
                for t, nodes in enumerate(now):
                    for slot, at in enumerate(nodes):
                        todo: list[int] = []
                        self._split(trees[t], at, sums[t][slot], self._chosen(rng, d), edges, rng, todo, self.alphas[t] if self.alphas else None)
                        open_ += [(t, c) for c in todo]
        if waiting:
            self._finish(rows, columns, stats, trees, waiting, seeds if bootstrap else None, edges, seeds)
        rows.unpersist()
        for nodes in trees:
            for n, node in enumerate(x for x in nodes if x.leaf):
                node.leaf_id = n
            for node in nodes:
                node.stats = None
        return trees

    def _chosen(self, rng, d: int) -> np.ndarray:
        """The features that a node looks at."""
        take = d if self.max_features is None else max(1, min(d, int(self.max_features)))
        return np.sort(rng.permutation(d)[:take])

    def _finish(self, rows, columns, stats, trees, waiting, seeds, edges, own_seeds) -> None:
        """Grows the waiting nodes, each from its own rows in one task, into the trees."""
        tables = Tables(trees)
        own = [np.array(sorted(at for tree, at in waiting if tree == t), int) for t in range(len(trees))]
        depths = {(t, at): trees[t][at].depth for t, at in waiting}
        names = ["features", *columns]
        fields = [rows.schema[c].simpleString().split(":", 1) for c in names]

        def deal(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1)).astype(int)
                for t, nodes in enumerate(own):
                    if not len(nodes):
                        continue
                    at = tables.route(x, t, True)
                    weight = np.ones(len(x)) if seeds is None else _poisson(ids, seeds[t])
                    pick = np.flatnonzero(np.isin(at, nodes) & (weight > 0))
                    if len(pick):
                        part = batch.take(pa.array(pick))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), t, np.int32)), pa.array(at[pick].astype(np.int32)), pa.array(weight[pick]), *part.columns[1:]], names=["_at_tree", "_at_node", "_at_weight", *names])

        def finish(of: pa.Table) -> pa.Table:
            t, at = of["_at_tree"][0].as_py(), of["_at_node"][0].as_py()
            of = of.combine_chunks()
            x = matrix(of["features"].chunk(0)).astype(np.int32)
            s = stats(*(matrix(of[c].chunk(0)) for c in columns)).astype(float) * of["_at_weight"].to_numpy()[:, None]
            rng = np.random.default_rng([int(own_seeds[t]), at])
            nodes = self._alone(x, s, depths[t, at], edges, rng, self.alphas[t] if self.alphas else None)
            return pa.table({"t": pa.array([t], pa.int32()), "node": pa.array([at], pa.int32()), "nodes": pa.array([pickle.dumps(nodes)], pa.binary())})

        dealt = rows.select("id", *names).mapInArrow(deal, ", ".join(["_at_tree int", "_at_node int", "_at_weight double", *[f"{n} {kind}" for n, kind in fields]]))
        for r in dealt.groupBy("_at_tree", "_at_node").applyInArrow(finish, "t int, node int, nodes binary").toLocalIterator():
            tree, grown = trees[r["t"]], pickle.loads(r["nodes"])
            shift = len(tree) - 1  # the first takes the waiting node's place
            for node in grown:
                if node.left >= 0:
                    node.left, node.right = node.left + shift, node.right + shift
            tree[r["node"]] = grown[0]
            tree += grown[1:]

    def _alone(self, x: np.ndarray, s: np.ndarray, depth: int, edges, rng, alpha) -> list[Node]:
        """The whole subtree over these rows of bins and statistics."""
        nodes, d = [Node(depth=depth)], x.shape[1]
        todo = deque([(0, np.arange(len(x)))])
        while todo:
            at, own = todo.popleft()
            children: list[int] = []
            if len(own) > FEW or self.kind != "best":
                most = max(len(e) for e in edges) + 1
                part, sums = s[own], np.zeros((d, most, s.shape[1]))
                for j in range(d):
                    for c in range(s.shape[1]):
                        sums[j, :, c] = np.bincount(x[own, j], weights=part[:, c], minlength=most)
                self._split(nodes, at, sums, self._chosen(rng, d), edges, rng, children, alpha)
            else:
                self._sorted_split(nodes, at, x[own], s[own], self._chosen(rng, d), edges, children)
            if children:
                goes = x[own, nodes[at].feature_id] <= nodes[at].bin
                todo += [(children[0], own[goes]), (children[1], own[~goes])]
        for node in nodes:
            node.stats = None
        return nodes

    def _sorted_split(self, nodes: list[Node], at: int, x: np.ndarray, s: np.ndarray, chosen, edges, todo: list[int]) -> None:
        """`_split` from few rows: running sums over each feature's order; splits stand where its bin changes."""
        node, total = nodes[at], s.sum(0)
        if self._ends(nodes, node, total) or len(x) < 2:
            node.leaf = True
            return
        order = np.argsort(x[:, chosen], axis=0, kind="stable")
        bins = np.take_along_axis(x[:, chosen], order, 0)
        left = s[order].cumsum(0)[:-1]
        right = total - left
        nl, nr = self.size(left), self.size(right)
        changes = (bins[1:] != bins[:-1]) & (nl > 0) & (nr > 0)
        gain = np.where(changes, self._gain(node, total, left, right, nl, nr), -np.inf)
        row = gain.argmax(0)
        best = gain[row, np.arange(len(chosen))]
        c = int(best.argmax())
        found = (float(best[c]), int(chosen[c]), int(bins[row[c], c]), float(nl[row[c], c]), float(nr[row[c], c])) if np.isfinite(best[c]) else None
        self._take(nodes, node, found, edges, todo)

    def _sums(self, rows, columns, stats, k, tables, now, seeds, d, most):
        """[tree][open node] -> [features, bins, k]; one job."""
        schema = pa.schema([("key", pa.int64()), ("s", pa.list_(pa.float64()))])
        order = [{at: s for s, at in enumerate(nodes)} for nodes in now]

        def run(batches):
            totals: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1)).astype(int)
                s = stats(*(matrix(batch.column(2 + c)) for c in range(len(columns)))).astype(float)
                for t, slots in enumerate(order):
                    if not slots:
                        continue
                    at = tables.route(x, t, True)
                    weight = _poisson(ids, seeds[t]) if seeds is not None else None
                    for node, slot in slots.items():
                        own = np.flatnonzero(at == node)
                        if not len(own):
                            continue
                        part = s[own] if weight is None else s[own] * weight[own, None]
                        total = totals.setdefault((t, slot), np.zeros((d, most, k)))
                        for j in range(d):
                            np.add.at(total[j], x[own, j], part)
            keys, values = [], []
            for (t, slot), total in totals.items():
                for j in range(d):
                    keys.append((t << 40) + (slot << 16) + j)
                    values.append(total[j].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], schema=schema)

        adds = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(most * k)]
        parts = rows.select("id", "features", *columns).mapInArrow(run, "key long, s array<double>")
        if most * k <= 64:
            found = ((r[0], np.array(r[1:])) for r in parts.groupBy("key").agg(*adds).collect())
        else:
            long = parts.select("key", F.posexplode("s").alias("i", "v")).filter("v <> 0").groupBy("key", "i").agg(F.sum("v").alias("v"))
            got: dict[int, np.ndarray] = {}
            for r in long.toLocalIterator():
                got.setdefault(r["key"], np.zeros(most * k))[r["i"]] = r["v"]
            found = got.items()
        out = [[np.zeros((d, most, k)) for _ in nodes] for nodes in now]
        for key, v in found:
            out[key >> 40][key >> 16 & 0xFFFFFF][key & 0xFFFF] = v.reshape(most, k)
        return out

    def _ends(self, nodes: list[Node], node: Node, total: np.ndarray) -> bool:
        """Takes a node's statistics, and tells whether it's a leaf."""
        node.stats, node.n_samples, node.impurity, node.value = total, float(self.size(total)), float(self.impurity(total)), self.value(total)
        full = self.max_depth is not None and node.depth >= self.max_depth
        full |= self.max_leaf_nodes is not None and sum(1 for n in nodes if n.left < 0) >= self.max_leaf_nodes
        pure = (total > 1e-12).sum() <= 1 if self.criterion in ("gini", "entropy") else self.criterion != "gradient" and node.impurity <= 1e-12
        return bool(full or pure or node.n_samples <= self.min_samples_leaf)

    def _gain(self, node: Node, total, left, right, nl, nr) -> np.ndarray:
        if self.criterion == "gradient":
            return self.impurity(total) - self.impurity(left) - self.impurity(right)
        return node.impurity - (nl * self.impurity(left) + nr * self.impurity(right)) / node.n_samples

    def _take(self, nodes: list[Node], node: Node, best: tuple | None, edges, todo: list[int]) -> None:
        """Makes the best split (gain, feature, bin, sizes), if there is one."""
        # An even split of XOR-like data gains nothing at first; only gradient trees ask for a gain.
        if best is None or (self.criterion == "gradient" and best[0] <= 1e-12):
            node.leaf = True
            return
        _, node.feature_id, node.bin, nl, nr = best
        node.threshold = float(edges[node.feature_id][node.bin])
        node.left, node.right = len(nodes), len(nodes) + 1
        nodes += [Node(depth=node.depth + 1, n_samples=nl), Node(depth=node.depth + 1, n_samples=nr)]
        todo += [node.left, node.right]

    def _split(self, nodes: list[Node], at: int, sums: np.ndarray, chosen, edges, rng, todo: list[int], alpha) -> None:
        node, total = nodes[at], sums[0].sum(0)
        if self._ends(nodes, node, total):
            node.leaf = True
            return
        best = None
        for j in chosen:
            left = sums[j].cumsum(0)[: len(edges[j])]
            right = total - left
            nl, nr = self.size(left), self.size(right)
            ok = np.flatnonzero((nl > 0) & (nr > 0))
            if not len(ok):
                continue
            if self.kind == "random" or (self.kind == "variable" and rng.random() >= (alpha if alpha is not None else 0.5)):
                low, high = edges[j][ok[0]], edges[j][ok[-1]]
                ok = ok[[np.searchsorted(edges[j][ok], rng.uniform(low, high), side="left").clip(0, len(ok) - 1)]]
            gain = self._gain(node, total, left[ok], right[ok], nl[ok], nr[ok])
            i = int(gain.argmax())
            if best is None or gain[i] > best[0]:
                best = float(gain[i]), int(j), int(ok[i]), float(nl[ok[i]]), float(nr[ok[i]])
        self._take(nodes, node, best, edges, todo)


def _poisson(ids: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draws by a hash of id and seed, the same in every job."""
    z = ids.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))).astype(np.float64) / 2**64
    return np.searchsorted(np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720])), u).astype(float)


def importances(trees: list[list[Node]], d: int, splits: bool = False) -> np.ndarray:
    """Impurity that each feature takes away, to a sum of one; or its number of splits."""
    out = np.zeros(d)
    for nodes in trees:
        own = np.zeros(d)
        for n in nodes:
            if n.left >= 0:
                l, r = nodes[n.left], nodes[n.right]
                own[n.feature_id] += 1 if splits else (n.n_samples * n.impurity - l.n_samples * l.impurity - r.n_samples * r.impurity) / max(nodes[0].n_samples, 1)
        out += own if splits or own.sum() == 0 else own / own.sum()
    return out if splits else out / max(out.sum(), 1e-300)


class _Tree(Estimator):
    kind, default = "best", "gini"

    def __init__(self, criterion: str | None = None, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 512):
        self.criterion, self.max_depth, self.max_leaf_nodes, self.min_samples_leaf, self.max_features, self.random_seed, self.max_bins = criterion or self.default, max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins
        if self.criterion == "mae":
            raise ValueError("sums of distances from a node's mean do not add up over rows; use mse")

    def _grower(self, **more) -> Grower:
        more = {"max_features": self.max_features, "alphas": None} | more
        return Grower(self.criterion, self.max_depth, self.max_leaf_nodes, self.min_samples_leaf, random_seed=self.random_seed, kind=self.kind, max_bins=self.max_bins, **more)

    _count, _bootstrap = 1, False

    def _alphas(self):
        return None

    def _columns(self, df: DataFrame):
        """df, columns, stats and their number; sets what predictions need."""
        df = labels(samples(df))
        self.classes = classes_of(df)
        known = np.array(self.classes)
        return df, ["label"], lambda y: y[:, None] == known, len(known)

    def fit(self, df: DataFrame) -> _Tree:
        df, columns, stats, k = self._columns(df)
        self.width = width(df)
        self.trees = self._grower(alphas=self._alphas()).grow(df, columns, stats, k, self._count, self._bootstrap)
        self._done()
        return self

    def _done(self) -> None:
        self.tables = Tables(self.trees)
        self.values = [np.array([n.value for n in nodes]) for nodes in self.trees]
        self.leaf_ids = [np.array([n.leaf_id for n in nodes]) for nodes in self.trees]
        self.feature_importances = importances(self.trees, self.width)

    def _means(self, x: np.ndarray) -> np.ndarray:
        return sum(v[self.tables.route(x, t)] for t, v in enumerate(self.values)) / len(self.values)

    def apply(self, df: DataFrame) -> DataFrame:
        """The leaf of every row in every tree, as `leaves`."""
        return with_numpy(samples(df), "leaves", "array<int>", ["features"], lambda x: np.stack([ids[self.tables.route(x, t)] for t, ids in enumerate(self.leaf_ids)], axis=1).astype(np.int32))


class _TreeClassifier(_Tree, Classifier):
    def _votes(self, x: np.ndarray) -> np.ndarray:
        """Votes of the trees' first largest shares."""
        k = len(self.classes)
        return sum(np.eye(k)[v[self.tables.route(x, t)].argmax(1)] for t, v in enumerate(self.values))

    def decision_function(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "decision", "array<double>", ["features"], self._votes)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "probability", "array<double>", ["features"], self._means)


class _TreeRegressor(_Tree, Regressor):
    default = "mse"

    def _columns(self, df: DataFrame):
        df = targets(samples(df))
        self.many = dict(df.dtypes)["target"].startswith("array")
        m = df.select(F.size("target")).first()[0] if self.many else 1

        def stats(y: np.ndarray) -> np.ndarray:
            y = y.reshape(len(y), -1)
            return np.hstack([np.ones((len(y), 1)), y, y * y])

        return df, ["target"], stats, 1 + 2 * m

    def predict(self, df: DataFrame) -> DataFrame:
        if self.many:
            return with_numpy(samples(df), "prediction", "array<double>", ["features"], self._means)
        return with_numpy(samples(df), "prediction", "double", ["features"], lambda x: self._means(x)[:, 0])


class DecisionTreeClassifier(_TreeClassifier):
    """Best splits by gini or entropy."""


class DecisionTreeRegressor(_TreeRegressor):
    """Best splits by squared error; several outputs together."""


class ExtraTreeClassifier(_TreeClassifier):
    """One random threshold a feature."""

    kind = "random"


class ExtraTreeRegressor(_TreeRegressor):
    """One random threshold a feature."""

    kind = "random"


class _VR:
    kind = "variable"

    def __init__(self, criterion: str | None = None, alpha: float = 0.5, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 512):
        super().__init__(criterion, max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins)
        self.alpha = alpha

    def _alphas(self):
        return [self.alpha]


class VRTreeClassifier(_VR, _TreeClassifier):
    """Best split with chance alpha, else a random threshold."""


class VRTreeRegressor(_VR, _TreeRegressor):
    """Best split with chance alpha, else a random threshold."""


class GradientTreeRegressor(_Tree, Regressor):
    """Second-order trees on columns g and h: gain G_l^2/(H_l + reg) + G_r^2/(H_r + reg) - G^2/(H + reg), leaf -rate G/(H + reg)."""

    def __init__(self, reg_lambda: float = 0.0, shrinkage_rate: float = 1.0, max_depth: int | None = None, max_leaf_nodes: int | None = None, min_samples_leaf: int = 1, max_features: int | None = None, random_seed: int = 0, max_bins: int = 512):
        super().__init__("gradient", max_depth, max_leaf_nodes, min_samples_leaf, max_features, random_seed, max_bins)
        self.reg_lambda, self.shrinkage_rate = reg_lambda, shrinkage_rate

    def _grower(self, **more) -> Grower:
        return super()._grower(reg_lambda=self.reg_lambda, shrinkage=self.shrinkage_rate, **more)

    def _columns(self, df: DataFrame):
        return samples(df), ["g", "h"], lambda g, h: np.stack([np.ones(len(g)), g, h], axis=1), 3

    def _done(self) -> None:
        super()._done()
        self.feature_importances = importances(self.trees, self.width, splits=True)

    def predict(self, df: DataFrame) -> DataFrame:
        return with_numpy(samples(df), "prediction", "double", ["features"], lambda x: self._means(x)[:, 0])
