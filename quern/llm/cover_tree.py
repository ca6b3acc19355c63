"""Exact top-k search by inner product with a dual-tree cover-tree search.

Rows are dealt over parts of bounded bytes by a hash of their row number, once, and stay there. A part is indexed as a
cover tree: a node has a centre that is one of its points, and the exact covering radius of all points below it; children
are centred on points far apart. Blocks of queries stream past the parts and are indexed likewise. Two trees are descended
together: a pair of nodes can't beat q.x = cq.cx + rq |cx| + rx |cq| + rq rx, and is pruned if that is below the worst kth
score of the query node's group. Pairs of leaves are scored by one matrix product. Each part gives k rows a query.

Components are integers, scores are exact integers, and ties go to the smaller id. Null, empty or non-finite vectors and
null ids take no part. Rows are told apart by their number alone: repeated rows are candidates (and queries) each, and only
a query's own row is no candidate. Vectors of different lengths do not meet. A query with fewer candidates returns all.
Scores beyond 64 bits are held to the largest long. An empty table gives no rows. Columns but vec_id and embedding are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import saved, table

EXACT, LONG, TOP = float(1 << 53), float(1 << 62), (1 << 63) - 1


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) and its length for the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    return rows.filter(F.forall("vector", fine)).withColumn("width", F.size("vector"))


def whole(x: Column) -> Column:
    """The floor of a double as a double: beyond 2^52 a double is whole already, and a long might not hold it."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


class Tree:
    """A cover tree over the rows of one block, nodes in arrays."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int = 64, ways: int = 12):
        self.numbers, self.ids, self.points = numbers, ids, points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        self._grow(np.arange(len(ids)), 0, leaf, ways)
        self.radius = np.array(self.radius)
        self.centres = points[np.array(self.centre)]
        self.norms = np.sqrt((self.centres**2).sum(1))

    def _grow(self, rows: np.ndarray, centre: int, leaf: int, ways: int) -> int:
        node, p = len(self.centre), self.points
        gap = np.sqrt(((p[rows] - p[centre]) ** 2).sum(1))
        self.centre.append(int(centre))
        self.radius.append(float(gap.max()) * (1 + 1e-9))
        self.children.append([])
        self.rows.append(None)
        if len(rows) <= leaf or gap.max() == 0:
            self.rows[node] = rows
            return node
        # Centres far apart: each the point farthest from those before it; every point goes to its nearest.
        owner, best, centres = np.zeros(len(rows), np.int64), gap, [int(centre)]
        for way in range(1, ways):
            far = int(best.argmax())
            if best[far] == 0:
                break
            centres.append(int(rows[far]))
            to = np.sqrt(((p[rows] - p[rows[far]]) ** 2).sum(1))
            owner[to < best] = way
            best = np.minimum(best, to)
        small: list[np.ndarray] = []
        for way, c in enumerate(centres):
            own = rows[owner == way]
            if len(own) > leaf // 4:
                self.children[node].append(self._grow(own, c, leaf, ways))
            elif len(own):
                small.append(own)
        if small:  # few rows each: together they make leaves
            rest = np.concatenate(small)
            for at in range(0, len(rest), leaf):
                part = rest[at : at + leaf]
                self.children[node].append(self._grow(part, part[0], leaf, ways))
        return node


class Best:
    """The k best so far of every query of a block: score, then smaller id. Scores are whole numbers or doubles."""

    def __init__(self, n: int, k: int, kind: type = np.int64):
        self.none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        self.scores = np.full((n, k), self.none, kind)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges scores [rows, candidates]; `none` is no candidate."""
        k = self.scores.shape[1]
        hit = scores.max(axis=1) >= self.scores[rows, -1]
        rows, scores, ids = rows[hit], scores[hit], ids[hit]
        if not len(rows):
            return
        s = np.concatenate((self.scores[rows], scores), axis=1)
        i = np.concatenate((self.ids[rows], np.where(scores == self.none, np.iinfo(np.int64).max, ids)), axis=1)
        order = np.lexsort((i, ~s if s.dtype == np.int64 else -s), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(s, order, 1)
        self.ids[rows] = np.take_along_axis(i, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query's place, vec_id and score of what has been found."""
        at, col = np.nonzero(self.scores != self.none)
        return at, self.ids[at, col], self.scores[at, col]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors given as doubles: by doubles, longs or Python's integers, as they fit."""
    most = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(v) for v in row] for row in b]
    return np.array([[max(-TOP, min(TOP, sum(x * y for x, y in zip(row, other, strict=True)))) for other in whole] for row in ([int(v) for v in r] for r in a)], np.int64)


def search(queries: Tree, data: Tree, best: Best) -> int:
    """Descends both trees, pruning node pairs; returns how many leaf pairs were scored."""
    scored = 0
    groups: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries.centre)
    for node in range(len(queries.centre) - 1, -1, -1):  # children come after their parent
        groups[node] = queries.rows[node] if queries.rows[node] is not None else np.concatenate([groups[c] for c in queries.children[node]])

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        rq, rx = queries.radius[q], data.radius[nodes]
        room = rq * data.norms[nodes] + rx * queries.norms[q] + rq * rx
        return data.centres[nodes] @ queries.centres[q] + room + 1e-9 * (1 + room + queries.norms[q] * data.norms[nodes])

    stack = [(float(bounds(0, np.array([0]))[0]), 0, 0)]
    while stack:
        bound, q, x = stack.pop()
        if bound < best.scores[groups[q], -1].min():
            continue
        q_leaf, x_leaf = queries.rows[q] is not None, data.rows[x] is not None
        if q_leaf and x_leaf:
            rows, found = groups[q], data.rows[x]
            s = products(queries.points[rows], data.points[found])
            ids = data.ids[found]
            s[queries.numbers[rows][:, None] == data.numbers[found][None, :]] = best.none
            best.add(rows, s, np.broadcast_to(ids, s.shape))
            scored += 1
        elif not x_leaf and (q_leaf or data.radius[x] >= queries.radius[q]):
            nodes = np.array(data.children[x])
            b = bounds(q, nodes)
            for i in np.argsort(b):  # the best comes off the stack first
                stack.append((float(b[i]), q, int(nodes[i])))
        else:
            for c in queries.children[q]:
                stack.append((float(bounds(c, np.array([x]))[0]), c, x))
    return scored


def numbered(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The rows that take part, each with its number, saved."""
    return saved(vectors(df).withColumn("number", F.monotonically_increasing_id()), spark, name)


def met(rows: DataFrame, spark: SparkSession, every: int, load: Callable, search: Callable, kind: str, query_block: int = 1024, part_bytes: int = 64 << 20) -> DataFrame:
    """query (its number), query_id, vec_id and score of every part's best for every query: rows whose id `every` divides.

    `load`(numbers, ids, points) makes a part's index; `search`(index, numbers, ids, points) yields (place of the query, vec_id, score)
    arrays for a block of queries. Data rows are shuffled once; queries go to each part, of which there is one for
    each `part_bytes` of vectors (or as many as the cluster runs at once, down to a MB each).
    """
    size = rows.agg(F.sum("width")).first()[0] or 0
    parts = max(1, -(-size * 8 // part_bytes), min(-(-size * 8 // (1 << 20)), spark.sparkContext.defaultParallelism))
    own = F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")
    columns = ["part", "width", "block", "number", "vec_id", "vector"]
    data = rows.withColumn("part", own).withColumn("block", F.lit(-1)).select(columns)
    blocks = max(1, -(-rows.filter(F.col("vec_id") % every == 0).count() // query_block))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("number", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(columns)
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if kind == "long" else pa.float64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows that stand together in part, width and block."""
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and tuple(key[a]) != last:
                    yield last, *map(np.concatenate, zip(*held, strict=True))
                    held = []
                last = tuple(key[a])
                few = batch.slice(a, b - a)
                held.append((few.column(3).to_numpy(), few.column(4).to_numpy(), few.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(last[1]))))
        if held:
            yield last, *map(np.concatenate, zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for (part, width, block), numbers, ids, points in groups(batches):
            if block < 0:  # a part's rows come before its queries
                index, of = load(numbers, ids, points), (part, width)
            elif (part, width) == of:
                at, found, scores = search(index, numbers, ids, points)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(ids[at]), pa.array(found), pa.array(scores)], schema=schema)

    dealt = data.unionByName(asked).repartition(2 * parts, "part", "width").sortWithinPartitions("part", "width", "block")
    return dealt.mapInArrow(run, f"query long, query_id long, vec_id long, score {kind}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query's candidates, which are k from each part at most."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, spark: SparkSession, every: int = 50, scale: float = 256.0, k: int = 5, query_block: int = 1024, part_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every`, the k largest inner products."""
    rows = numbered(df, spark, "cover-rows").withColumn("vector", F.transform("vector", lambda x: whole(x * scale)))

    def best_of(tree: Tree, numbers: np.ndarray, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = Best(len(ids), k)
        search(Tree(numbers, ids, points), tree, best)
        return best.found()

    return ranked(met(rows, spark, every, Tree, best_of, "long", query_block, part_bytes), k)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every query among all embeddings."""
    return top_k(table(spark, sf_dir, "embeddings"), spark)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.number, q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.number <> d.number AND len(q.x) = len(d.x)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
