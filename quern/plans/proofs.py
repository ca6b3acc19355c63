"""Queries of parts and learners that have a closed form, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.arrays import doubles
from quern.functions.numeric import with_numpy
from quern.operators import base, bayes, clustering, decomposition, ensemble, features, linear, metrics, neural, preprocessing, selection, tree
from quern.plans.queries import CELLS, CL, E_SQL, L_SQL, NUMBERS, SQ, X, _coefficients, _line, flat, lines, one, table, vectors
from quern.plans.registry import register
from quern.sources import generators

WIDE = 12  # of the names in a report


def _report() -> str:
    row, empty = f"'%{WIDE}s  %9.2f %9.2f %9.2f %9d'", f"'%{WIDE}s  %9s %9s %9.2f %9d'"
    return f"""{CELLS}, s AS (SELECT *, row_number() OVER (ORDER BY class) AS i, sum(support) OVER () AS n, count(*) OVER () AS k FROM f)
SELECT 0 AS line, printf('%{WIDE}s  %9s %9s %9s %9s', '', 'precision', 'recall', 'f1-score', 'support') AS report
UNION ALL SELECT 1, ''
UNION ALL SELECT (i + 1)::INTEGER, printf({row}, class::VARCHAR, pre, rec, fs, support::BIGINT) FROM s
UNION ALL SELECT (max(k) + 2)::INTEGER, '' FROM s
UNION ALL SELECT (max(k) + 3)::INTEGER, printf({empty}, 'accuracy', '', '', sum(tp) / max(n), max(n)::BIGINT) FROM s
UNION ALL SELECT (max(k) + 4)::INTEGER, printf({row}, 'macro avg', sum(pre) / max(k), sum(rec) / max(k), sum(fs) / max(k), max(n)::BIGINT) FROM s
UNION ALL SELECT (max(k) + 5)::INTEGER, printf({row}, 'weighted avg', sum(pre * support) / max(n), sum(rec * support) / max(n), sum(fs * support) / max(n), max(n)::BIGINT) FROM s"""


register("classification_report", _report())(lambda spark, d: spark.createDataFrame(list(enumerate(metrics.classification_report(lines(spark, d)).splitlines())), "line int, report string"))
register("kernel_calculator", f"WITH {E_SQL} SELECT a.id, round(sum(exp(-0.01 * {SQ})), 4) AS total FROM e a, e b GROUP BY a.id")(
    lambda spark, d: preprocessing.KernelCalculator(gamma=0.01).fit_transform(vectors(spark, d)).select("id", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))
)
register(
    "silhouette_samples",
    f"WITH {E_SQL}, k AS (SELECT label, count(*) AS n FROM e GROUP BY label), s AS (SELECT a.id, a.label AS own, b.label, sum(sqrt({SQ})) AS s FROM e a, e b GROUP BY a.id, a.label, b.label), r AS (SELECT id, max(CASE WHEN own = s.label THEN s / (n - 1) END) AS a, min(CASE WHEN own <> s.label THEN s / n END) AS b FROM s JOIN k USING (label) GROUP BY id) SELECT id, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM r",
)(lambda spark, d: metrics.silhouette_samples(vectors(spark, d)).select("id", F.round("silhouette", 5).alias("silhouette")))

# ---- contracts

ROWS = f"WITH {L_SQL} SELECT id, " + ", ".join(f"round({x}, 6) AS f{j}" for j, x in enumerate(X)) + " FROM li"
register("check_sample_array", ROWS)(lambda spark, d: flat(base.samples(lines(spark, d).withColumn("features", F.col("features").cast("array<decimal(20,6)>"))), 4))
register("check_label_array", f"WITH {L_SQL} SELECT id, y AS label FROM li")(lambda spark, d: base.labels(lines(spark, d).withColumn("label", F.col("label").cast("string"))).select("id", "label"))
register("check_target_array", f"WITH {L_SQL} SELECT id, round(x0, 6) AS first, round(x2, 6) AS second FROM li")(
    lambda spark, d: base.targets(lines(spark, d).withColumn("target", F.array(F.col("features")[0], F.col("features")[2]).cast("array<string>"))).select("id", F.round(F.col("target")[0], 6).alias("first"), F.round(F.col("target")[1], 6).alias("second"))
)


def _same_size(spark: SparkSession, d: str) -> DataFrame:
    def agree(a: DataFrame, b: DataFrame) -> bool:
        try:
            base.same_size(a, b)
        except ValueError:
            return False
        return True

    li, od = table(spark, d, "lineitem"), table(spark, d, "orders")
    return spark.createDataFrame([("lineitem, lineitem", agree(li, li)), ("lineitem, orders", agree(li, od))], "tables string, agree boolean")


register("check_sample_size", "SELECT 'lineitem, lineitem' AS tables, true AS agree UNION ALL SELECT 'lineitem, orders', (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM orders)")(_same_size)
register("evaluator", f"WITH {L_SQL} SELECT 'accuracy' AS measure, round(avg((y = p)::INTEGER), 6) AS score FROM li UNION ALL SELECT 'mean_absolute_error', round(avg(abs(x1 - x0 * 1500)), 4) FROM li")(
    lambda spark, d: spark.createDataFrame(
        [("accuracy", round(base.Evaluator(metrics.accuracy).score(lines(spark, d)), 6)), ("mean_absolute_error", round(base.Evaluator(metrics.mean_absolute_error).score(lines(spark, d).withColumn("prediction", F.col("features")[0] * 1500.0)), 4))], "measure string, score double"
    )
)
register("regressor_score", f"WITH {L_SQL} SELECT round(regr_r2(x1, x0), 6) AS score FROM li")(lambda spark, d: spark.createDataFrame([(float(linear.LinearRegression().fit(df := _line(spark, d)).score(df)),)], "score double").select(F.round("score", 6).alias("score")))

# ---- splits and searches

register(
    "group_k_fold",
    "WITH RECURSIVE o AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS i FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey)), w AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS filled, NULL::BIGINT AS k, NULL::INTEGER AS fold UNION ALL SELECT o.i, list_transform(filled, lambda v, p: CASE WHEN p = list_position(filled, list_min(filled)) THEN v + o.n ELSE v END), o.k::BIGINT, (list_position(filled, list_min(filled)) - 1)::INTEGER FROM w JOIN o ON o.i = w.i + 1) SELECT c_custkey AS id, fold FROM customer JOIN w ON w.k = c_nationkey",
)(lambda spark, d: selection.GroupKFold(5, "c_nationkey").folds(table(spark, d, "customer").withColumnRenamed("c_custkey", "id")).select("id", "fold"))
MOMENTS = ", ".join(f"avg({x}) AS m{j}, var_samp({x}) AS v{j}" for j, x in enumerate(X))
NORMAL = " + ".join(f"ln(2 * pi() * v{j}) + pow({x} - m{j}, 2) / v{j}" for j, x in enumerate(X))
FIRST = "row_number() OVER (PARTITION BY fold, rid ORDER BY s DESC, c) AS r"
register(
    "cross_validation",
    f"WITH {L_SQL}, f AS (SELECT *, ntile(3) OVER (PARTITION BY y ORDER BY id) - 1 AS own FROM li), t AS (SELECT k AS fold, f.* FROM f, range(3) r(k) WHERE own <> k), n AS (SELECT fold, count(*)::DOUBLE AS n FROM t GROUP BY fold), q AS (SELECT fold, y AS c, count(*)::DOUBLE AS k, {MOMENTS} FROM t GROUP BY fold, y), s AS (SELECT fold, rid, y, c, ln(k / n) - 0.5 * ({NORMAL}) AS s FROM f JOIN q ON fold = own JOIN n USING (fold)), b AS (SELECT fold, y, c, {FIRST} FROM s) SELECT fold::INTEGER AS fold, round(avg((y = c)::INTEGER), 6) AS score FROM b WHERE r = 1 GROUP BY fold",
)(lambda spark, d: spark.createDataFrame([(k, round(float(s), 6)) for k, s in enumerate(selection.CrossValidation(bayes.GaussianNB(), selection.StratifiedKFold(3)).perform(lines(spark, d).drop("prediction"))["test_score"])], "fold int, score double"))
ON = ", ".join(f"(sum(({x} > b.t)::INTEGER) + 1) / (count(*) + 2)::DOUBLE AS p{j}" for j, x in enumerate(X))
OFF = " + ".join(f"CASE WHEN {x} > q.t THEN ln(p{j}) ELSE ln(1 - p{j}) END" for j, x in enumerate(X))
register(
    "grid_search_cv",
    f"WITH {L_SQL}, b AS (SELECT unnest([0.02::DOUBLE, 0.05::DOUBLE]) AS t), f AS (SELECT *, ntile(2) OVER (ORDER BY id) - 1 AS own FROM li), n AS (SELECT k AS fold, count(*)::DOUBLE AS n FROM f, range(2) r(k) WHERE own <> k GROUP BY k), q AS (SELECT b.t, k AS fold, y AS c, count(*)::DOUBLE AS k, {ON} FROM f, range(2) r(k), b WHERE own <> r.k GROUP BY b.t, r.k, y), s AS (SELECT q.t, fold, rid, y, c, ln(k / n) + {OFF} AS s FROM f JOIN q ON fold = own JOIN n USING (fold)), g AS (SELECT t, fold, y, c, row_number() OVER (PARTITION BY t, fold, rid ORDER BY s DESC, c) AS r FROM s), a AS (SELECT t, fold, avg((y = c)::INTEGER) AS score FROM g WHERE r = 1 GROUP BY t, fold) SELECT '{{''bin_threshold'': ' || t::VARCHAR || '}}' AS params, round(avg(score), 6) AS score FROM a GROUP BY t",
)(lambda spark, d: spark.createDataFrame([(str(r["params"]), round(float(r["mean_test_score"]), 6)) for r in selection.GridSearchCV(bayes.BernoulliNB(), {"bin_threshold": [0.02, 0.05]}, selection.KFold(2)).fit(lines(spark, d).drop("prediction")).cv_results], "params string, score double"))
register(
    "pipeline_scaler_nb",
    f"WITH {L_SQL}, z AS (SELECT id, rid, y, " + ", ".join(f"({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS {x}" for x in X) + f" FROM li), t AS (SELECT count(*)::DOUBLE AS n FROM z), q AS (SELECT y AS c, count(*)::DOUBLE AS k, {MOMENTS} FROM z GROUP BY y), s AS (SELECT id, rid, c, ln(k / n) - 0.5 * ({NORMAL}) AS s FROM z, q, t) SELECT id, c::INTEGER AS prediction FROM (SELECT id, c, row_number() OVER (PARTITION BY rid ORDER BY s DESC, c) AS r FROM s) WHERE r = 1",
)(lambda spark, d: selection.Pipeline({"scale": preprocessing.StandardScaler(), "nb": bayes.GaussianNB()}).fit(df := lines(spark, d).drop("prediction")).predict(df).select("id", "prediction"))
UNION = ", ".join(f"round({x} / sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3), 6) AS f{j}" for j, x in enumerate(X)) + ", " + ", ".join(f"round(({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()), 6) AS f{4 + j}" for j, x in enumerate(X))
register("feature_union", f"WITH {L_SQL} SELECT id, {UNION} FROM li")(lambda spark, d: flat(selection.FeatureUnion({"raw": preprocessing.L2Normalizer(), "scaled": preprocessing.MinMaxScaler()}).fit_transform(lines(spark, d)), 8))
WEIGHT = ", ".join(f"{x} * (ln((SELECT count(*) FROM li)::DOUBLE / (SELECT sum(({x} <> 0)::INTEGER) FROM li)) + 1) AS {x}" for x in X)
register("tfidf_transformer", f"WITH {L_SQL}, w AS (SELECT id, {WEIGHT} FROM li) SELECT id, " + ", ".join(f"round({x} / sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3), 6) AS f{j}" for j, x in enumerate(X)) + " FROM w")(lambda spark, d: flat(features.TfidfTransformer().fit_transform(lines(spark, d)), 4))

# ---- toy data without noise

SHAPE = "WITH s AS (SELECT range AS id, CASE WHEN range < 500 THEN range / 499.0::DOUBLE ELSE (range - 500) / 499.0::DOUBLE END AS t, (range >= 500)::INTEGER AS label FROM range(1000))"
register("make_circles", f"{SHAPE} SELECT id, round(cos(2 * pi() * t) * CASE label WHEN 0 THEN 1 ELSE 0.8::DOUBLE END, 6) + 0 AS f0, round(sin(2 * pi() * t) * CASE label WHEN 0 THEN 1 ELSE 0.8::DOUBLE END, 6) + 0 AS f1, label FROM s")(
    lambda spark, d: _points(generators.make_circles(spark, 1000, shuffle=False))
)
register("make_moons", f"{SHAPE} SELECT id, round(CASE label WHEN 0 THEN cos(pi() * t) ELSE 1 - cos(pi() * t) END, 6) + 0 AS f0, round(CASE label WHEN 0 THEN sin(pi() * t) ELSE 0.5::DOUBLE - sin(pi() * t) END, 6) + 0 AS f1, label FROM s")(lambda spark, d: _points(generators.make_moons(spark, 1000, shuffle=False)))


def _points(df: DataFrame) -> DataFrame:
    return df.select("id", *[(F.round(F.col("features")[j], 6) + F.lit(0.0)).alias(f"f{j}") for j in range(2)], "label")


# ---- learners with closed forms

ONE = f"WITH {L_SQL}, z AS (SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS p, count(*)::DOUBLE AS n FROM li)"


def _slope(spark: SparkSession, model, d: str) -> DataFrame:
    return spark.createDataFrame([(float(model.fit(_line(spark, d)).weight_vec[0, 0]),)], "slope double").select(F.round("slope", 4).alias("slope"))


register("lasso", f"{ONE} SELECT round(greatest(p - 1e8, 0) / a, 4) AS slope FROM z")(lambda spark, d: _slope(spark, linear.Lasso(1e8, fit_bias=False), d))
register("elastic_net", f"{ONE} SELECT round((p - 2.5e5) / (a + 7.5e5), 4) AS slope FROM z")(lambda spark, d: _slope(spark, linear.ElasticNet(1e6, 0.25, fit_bias=False), d))
register("nnls", f"{ONE} SELECT round(greatest(p / n / (a / n + 100), 0), 4) AS slope FROM z")(lambda spark, d: _slope(spark, linear.NNLS(100.0, fit_bias=False), d))
TWO = f"WITH {L_SQL}, c AS (SELECT var_pop(x0) AS v0, var_pop(x2) AS v2, covar_pop(x0, x2) AS k, covar_pop(x0, x1) AS p0, covar_pop(x2, x1) AS p2, avg(x0) AS m0, avg(x2) AS m2, avg(x1) AS m1 FROM li), w AS (SELECT (p0 * v2 - p2 * k) / (v0 * v2 - k * k) AS w0, (p2 * v0 - p0 * k) / (v0 * v2 - k * k) AS w2, m0, m1, m2 FROM c)"
register("linear_regression_two", f"{TWO} SELECT round(w0, 3) AS w0, round(w2, 1) AS w2, round(m1 - w0 * m0 - w2 * m2, 2) AS intercept FROM w")(
    lambda spark, d: spark.createDataFrame([(round(float((m := linear.LinearRegression().fit(lines(spark, d).withColumn("features", F.array(F.col("features")[0], F.col("features")[2])))).weight_vec[0, 0]), 3), round(float(m.weight_vec[0, 1]), 1), round(float(m.bias_term[0]), 2))], "w0 double, w2 double, intercept double")
)
SXY = f"WITH {L_SQL}, z AS (SELECT sum(x0 * x0) AS a, sum(x0) AS b, count(*)::DOUBLE AS n, sum(x0 * x1) AS p, sum(x1) AS q, regr_slope(x1, x0) AS s, regr_intercept(x1, x0) AS i FROM li)"
register("voting_regressor", f"{SXY} SELECT id, round(((((n + 10) * z.p - b * q) * x0 + (a + 10) * q - b * z.p) / ((a + 10) * (n + 10) - b * b) + s * x0 + i) / 2, 3) AS prediction FROM li, z")(
    lambda spark, d: ensemble.VotingRegressor({"ridge": linear.Ridge(10.0), "ols": linear.LinearRegression()}).fit(df := _line(spark, d).drop("prediction")).predict(df).select("id", F.round("prediction", 3).alias("prediction"))
)


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("features", F.array(F.col("features")[0], F.col("features")[2] * 100))


PLANE = f"WITH {L_SQL}, f AS (SELECT id, y, x0 AS a, x2 * 100 AS b FROM li)"
NEAR = "CASE WHEN pow(a - a0, 2) + pow(b - b0, 2) <= pow(a - a1, 2) + pow(b - b1, 2) THEN 0 ELSE 1 END"
STEP = ", ".join(f"avg({c}) FILTER (k = {k}) AS {c}{k}" for k in (0, 1) for c in "ab")
LLOYD = f"{PLANE}, c0 AS (SELECT 10.3::DOUBLE AS a0, 2.1::DOUBLE AS b0, 40.2::DOUBLE AS a1, 8.7::DOUBLE AS b1), c1 AS (SELECT {STEP} FROM (SELECT a, b, {NEAR} AS k FROM f, c0)), c2 AS (SELECT {STEP} FROM (SELECT a, b, {NEAR} AS k FROM f, c1)), g AS (SELECT id, y, {NEAR} AS k FROM f, c2)"
START = np.array([[10.3, 2.1], [40.2, 8.7]])
register("k_means", f"{LLOYD} SELECT id, k::INTEGER AS prediction FROM g")(lambda spark, d: clustering.KMeans(2, START, max_iter=2, tol=0.0).fit(df := _plane(spark, d).drop("prediction")).predict(df).select("id", "prediction"))
register("cluster_analyzer_score", f"{LLOYD}, n AS (SELECT k, y, count(*) AS n FROM g GROUP BY k, y) SELECT round(sum(m) / (SELECT count(*) FROM g), 6) AS score FROM (SELECT max(n) AS m FROM n GROUP BY k)")(
    lambda spark, d: spark.createDataFrame([(round(float(clustering.KMeans(2, START, max_iter=2, tol=0.0).score(_plane(spark, d).drop("prediction"))), 6),)], "score double")
)
register(
    "dbscan",
    f"WITH RECURSIVE {E_SQL}, p AS (SELECT a.id AS i, b.id AS j FROM e a, e b WHERE sqrt({SQ}) < 9), k AS (SELECT i FROM p GROUP BY i HAVING count(*) >= 5), r(i, j) AS (SELECT i, i FROM k UNION SELECT r.i, p.j FROM r JOIN p ON p.i = r.j JOIN k ON k.i = p.j), c AS (SELECT i, min(j) AS root FROM r GROUP BY i), n AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM c), b AS (SELECT p.i, min(cluster) AS cluster FROM p JOIN n ON n.i = p.j GROUP BY p.i) SELECT e.id, coalesce(n.cluster, b.cluster, -1)::INTEGER AS prediction FROM e LEFT JOIN n ON n.i = e.id LEFT JOIN b ON b.i = e.id",
)(lambda spark, d: clustering.DBSCAN(9.0, 5).fit(df := vectors(spark, d)).predict(df).select("id", "prediction"))
AXIS = "sqrt(q * q + (l{k} - p) * (l{k} - p)) * CASE WHEN (CASE WHEN abs(q) >= abs(l{k} - p) THEN q ELSE l{k} - p END) < 0 THEN -1 ELSE 1 END"
register(
    "pca",
    f"{PLANE}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS p, covar_samp(a, b) AS q, var_samp(b) AS r FROM f), l AS (SELECT *, (p + r) / 2 + sqrt(pow((p - r) / 2, 2) + q * q) AS l0, (p + r) / 2 - sqrt(pow((p - r) / 2, 2) + q * q) AS l1 FROM m) SELECT id, "
    + ", ".join(f"round(((a - ma) * q + (b - mb) * (l{k} - p)) / ({AXIS.format(k=k)}), 4) + 0 AS f{k}" for k in (0, 1))
    + " FROM f, l",
)(lambda spark, d: flat(decomposition.PCA(2).fit_transform(_plane(spark, d)), 2, 4).select("id", *[(F.col(f"f{k}") + F.lit(0.0)).alias(f"f{k}") for k in (0, 1)]))

# ---- trees of one split, through fit and predict


def _split_sql(stats: list[str], imp, out: str = "split") -> str:
    k = range(len(stats))
    cum = ", ".join(f"sum(s{i}) OVER (ORDER BY v) AS l{i}, sum(s{i}) OVER () AS t{i}" for i in k)
    gain = f"({imp([f't{i}' for i in k])} - ({imp([f'l{i}' for i in k])}) - ({imp([f'(t{i} - l{i})' for i in k])})) / t0"
    head = f"WITH {L_SQL}, g AS (SELECT x0 AS v, " + ", ".join(f"sum({s})::DOUBLE AS s{i}" for i, s in enumerate(stats)) + f" FROM li GROUP BY x0), c AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv, {cum} FROM g)"
    best = f"SELECT *, (v + nv) / 2 AS threshold, {gain} AS gain FROM c WHERE nv IS NOT NULL ORDER BY {gain} DESC, v LIMIT 1"
    if out == "split":
        return f"{head} SELECT round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM ({best})"
    return f"{head}, b AS ({best}) SELECT id, {out} AS prediction FROM li, b"


def _split(spark: SparkSession, model, df: DataFrame) -> DataFrame:
    """Threshold and gain a row of a fitted tree's root."""
    nodes = model.fit(df).trees[0]
    root = nodes[0]
    left, right = nodes[root.left], nodes[root.right]
    if model.criterion == "gradient":
        gain = (root.impurity - left.impurity - right.impurity) / root.n_samples
    else:
        gain = root.impurity - (left.n_samples * left.impurity + right.n_samples * right.impurity) / root.n_samples
    return spark.createDataFrame([(round(float(root.threshold), 6), round(float(gain), 6))], "threshold double, gain double")


def _first(spark: SparkSession, d: str) -> DataFrame:
    """One feature, with the discount as target and gradients of it."""
    return _line(spark, d).withColumn("target", F.col("discount")).withColumn("g", F.col("discount") - F.lit(0.05)).withColumn("h", F.lit(1.0)).drop("prediction")


COUNTS = ["1", "(y = 0)::INTEGER", "(y = 1)::INTEGER", "(y = 2)::INTEGER"]
GINI = lambda s: f"{s[0]} - ({s[1]} * {s[1]} + {s[2]} * {s[2]} + {s[3]} * {s[3]}) / {s[0]}"
ENTROPY = lambda s: "(" + " + ".join(f"-{c} * ln({c} / {s[0]} + 1)" for c in s[1:]) + ")"
SQUARES, MSE = ["1", "x2", "x2 * x2"], lambda s: f"{s[2]} - {s[1]} * {s[1]} / {s[0]}"
SLOPES, GRADIENT = ["1", "x2 - 0.05::DOUBLE", "1"], lambda s: f"(-({s[1]} * {s[1]}) / ({s[2]} + 1))"
MODE = "CASE WHEN x0 <= threshold THEN CASE WHEN l1 >= l2 AND l1 >= l3 THEN 0 WHEN l2 >= l3 THEN 1 ELSE 2 END ELSE CASE WHEN t1 - l1 >= t2 - l2 AND t1 - l1 >= t3 - l3 THEN 0 WHEN t2 - l2 >= t3 - l3 THEN 1 ELSE 2 END END"
MEAN = "round(CASE WHEN x0 <= threshold THEN l1 / l0 ELSE (t1 - l1) / (t0 - l0) END, 8)"
LEAF = "round(CASE WHEN x0 <= threshold THEN -l1 / (l2 + 1) ELSE -(t1 - l1) / (t2 - l2 + 1) END, 8)"
for _name, _make, _stats, _imp, _out in (
    ("gini", lambda: tree.DecisionTreeClassifier("gini", max_depth=1), COUNTS, GINI, MODE),
    ("entropy", lambda: tree.DecisionTreeClassifier("entropy", max_depth=1), COUNTS, ENTROPY, MODE),
    ("mse", lambda: tree.DecisionTreeRegressor("mse", max_depth=1), SQUARES, MSE, MEAN),
    ("gradient", lambda: tree.GradientTreeRegressor(1.0, 1.0, max_depth=1), SLOPES, GRADIENT, LEAF),
):
    register(f"tree_split_{_name}", _split_sql(_stats, _imp))(lambda spark, d, make=_make: _split(spark, make(), _first(spark, d)))
    register(f"tree_stump_{_name}", _split_sql(_stats, _imp, _out))(
        lambda spark, d, make=_make, digits=0 if _out is MODE else 8: make().fit(df := _first(spark, d)).predict(df).select("id", F.round("prediction", digits).alias("prediction") if digits else "prediction")
    )

# ---- parts of stochastic descent and of networks, row by row


def _by_row(spark: SparkSession, d: str, of, n: int, *more: str) -> DataFrame:
    """id and the columns f0, f1, ... that of(features, ...) gives for a batch."""
    return flat(with_numpy(lines(spark, d), "features", "array<double>", ["features", *more], of), n)


def _each(loss) -> object:
    """A loss and its gradient a row, of a score and a sign."""

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, sign = x[:, 0] / 25 - 1, np.where(y > 0, 1.0, -1.0)
        return np.array([[loss(z[k : k + 1], sign[k : k + 1])[0], loss(z[k : k + 1], sign[k : k + 1])[1][0]] for k in range(len(z))])

    return of


ZS = f"WITH {L_SQL}, s AS (SELECT id, x0 / 25 - 1 AS z, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS t FROM li)"
for _name, _loss, _value, _grad in (
    ("sgd_squared_loss", linear.squared_loss, "pow(z - t, 2)", "2 * (z - t)"),
    ("sgd_log_loss", linear.log_loss, "ln(1 + exp(-t * z))", "t / (1 + exp(-t * z)) - t"),
    ("sgd_hinge_loss", linear.hinge_loss, "greatest(0, 1 - t * z)", "CASE WHEN t * z < 1 THEN -t ELSE 0 END"),
    ("sgd_epsilon_insensitive", linear.epsilon_insensitive(0.1), "greatest(0, abs(z - t) - 0.1::DOUBLE)", "CASE WHEN abs(z - t) > 0.1::DOUBLE THEN sign(z - t)::DOUBLE ELSE 0 END"),
):
    register(_name, f"{ZS} SELECT id, round({_value}, 6) + 0 AS f0, round({_grad}, 6) + 0 AS f1 FROM s")(lambda spark, d, loss=_loss: _plus(_by_row(spark, d, _each(loss), 2, "label"), 2))


def _plus(df: DataFrame, n: int) -> DataFrame:
    """Without negative zeros."""
    return df.select("id", *[(F.col(f"f{j}") + F.lit(0.0)).alias(f"f{j}") for j in range(n)])


def _all(expr: str, n: int = 4) -> str:
    return f"WITH {L_SQL} SELECT id, " + ", ".join(f"round({expr.format(x=x, j=j)}, 6) + 0 AS f{j}" for j, x in enumerate(X[:n])) + " FROM li"


def _l1(x: np.ndarray) -> np.ndarray:
    penalty = linear.L1Penalty(0.1)
    return penalty(penalty(x, 0.5), 0.5)


def _momentum(x: np.ndarray) -> np.ndarray:
    sgd = linear.SGD(0.1, 0.9, 1.0)
    return sgd(sgd(x, x), x)


def _adam(x: np.ndarray) -> np.ndarray:
    adam = neural.Adam(0.001)
    return adam(adam(x, x), x)


register("sgd_l2_penalty", _all("{x} * 0.95::DOUBLE"))(lambda spark, d: _plus(_by_row(spark, d, lambda x: linear.L2Penalty(0.1)(x, 0.5), 4), 4))
register("sgd_l1_penalty", _all("CASE WHEN greatest(0, {x} - 0.05::DOUBLE) > 0 THEN greatest(0, greatest(0, {x} - 0.05::DOUBLE) - (0.1::DOUBLE + greatest(0, {x} - 0.05::DOUBLE) - {x})) ELSE 0 END"))(lambda spark, d: _plus(_by_row(spark, d, _l1, 4), 4))
register("sgd_momentum", _all("{x} - 0.1::DOUBLE * {x} - 0.09::DOUBLE * {x} - 0.05::DOUBLE * {x}"))(lambda spark, d: _plus(_by_row(spark, d, _momentum, 4), 4))
register("network_adam", _all("{x} - 2 * 0.001::DOUBLE * {x} / (abs({x}) + 1e-8)"))(lambda spark, d: _plus(_by_row(spark, d, _adam, 4), 4))
register("network_relu", _all("greatest({x} - 0.03::DOUBLE, 0)"))(lambda spark, d: _plus(_by_row(spark, d, lambda x: neural.Relu().forward(x - 0.03), 4), 4))


def _affine(w: list[list[float]], b: list[float]) -> neural.Affine:
    layer = neural.Affine(len(w), len(b), {}, np.random.default_rng(0))
    layer.w, layer.b = np.array(w), np.array(b)
    return layer


W1, B1 = [[1.0, -0.5], [0.001, 0.0002], [3.0, -7.0], [0.0, 2.0]], [0.5, 4.0]
OUT = [" + ".join(f"x{i} * ({W1[i][j]})::DOUBLE" for i in range(4)) + f" + ({B1[j]})::DOUBLE" for j in range(2)]
register("network_affine", f"WITH {L_SQL} SELECT id, " + ", ".join(f"round({o}, 6) + 0 AS f{j}" for j, o in enumerate(OUT)) + " FROM li")(lambda spark, d: _plus(_by_row(spark, d, lambda x: _affine(W1, B1).forward(x), 2), 2))
register("network_sequential", f"WITH {L_SQL} SELECT id, round(2 * greatest({OUT[0]}, 0) - 3 * greatest({OUT[1]}, 0) + 1, 6) + 0 AS f0 FROM li")(
    lambda spark, d: _plus(_by_row(spark, d, lambda x: neural.Sequential().push(_affine(W1, B1)).push(neural.Relu()).push(neural.Dropout(0.5, np.random.default_rng(0))).push(_affine([[2.0], [-3.0]], [1.0])).delete_dropout().forward(x), 1), 1)
)


def _cross_entropy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z, goal = x[:, [0, 2, 3]] / np.array([10.0, 0.1, 0.1]), np.eye(3)[y.astype(int)]
    each = [neural.softmax_cross_entropy(z[k : k + 1], goal[k : k + 1]) for k in range(len(z))]
    return np.array([[loss, *g[0]] for loss, g in each])


EXPS = f"WITH {L_SQL}, e AS (SELECT id, y, exp(x0 / 10) AS e0, exp(x2 * 10) AS e1, exp(x3 * 10) AS e2 FROM li), p AS (SELECT id, y, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM e)"
register("network_softmax_cross_entropy", f"{EXPS} SELECT id, round(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1e-8), 6) + 0 AS f0, " + ", ".join(f"round(p{k} - (y = {k})::INTEGER, 6) + 0 AS f{k + 1}" for k in range(3)) + " FROM p")(lambda spark, d: _plus(_by_row(spark, d, _cross_entropy, 4, "label"), 4))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    each = [neural.mean_squared_error(x[k : k + 1, [0, 2]], np.array([[y[k], 1.0]])) for k in range(len(x))]
    return np.array([[loss, *g[0]] for loss, g in each])


register("network_mean_squared_error", f"WITH {L_SQL} SELECT id, round((pow(x0 - y, 2) + pow(x2 - 1, 2)) / 2, 6) + 0 AS f0, round(2 * (x0 - y), 6) + 0 AS f1, round(2 * (x2 - 1), 6) + 0 AS f2 FROM li")(lambda spark, d: _plus(_by_row(spark, d, _squares, 3, "label"), 3))
