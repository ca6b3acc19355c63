"""The library's own queries over the driver's tables, over whole tables, with SQL where SQL can express them.

Doubles are rounded to six digits on both sides, as sums run in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.arrays import doubles
from quern.functions.storage import shared_dir
from quern.operators import bayes, clustering, decomposition, ensemble, features, kernel, linear, manifold, metric_learning, metrics, neighbors, neural, pairwise, preprocessing, selection, tree
from quern.plans.registry import register
from quern.sources import generators, libsvm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs, in Spark and in SQL

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
L_ID = "l_orderkey * 10 + l_linenumber"
L_SQL = f"li AS (SELECT {L_ID} AS id, row_number() OVER () AS rid, {', '.join(f'{c}::DOUBLE AS x{j}' for j, c in enumerate(NUMBERS))}, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS y, (l_linenumber % 4)::INTEGER AS p FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features of four numbers, label by return flag, prediction by line number."""
    df = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return df.select(F.expr(L_ID).alias("id"), doubles(*NUMBERS).alias("features"), y.alias("label"), (F.col("l_linenumber") % 4).cast("int").alias("prediction"), F.col("l_extendedprice").alias("target"), F.col("l_discount").alias("discount"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features and label of embeddings; the label is a target too."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label", F.col("label").cast("double").alias("target"))


def flat(df: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """id and features as rounded columns f0, f1, ..."""
    return df.select("id", *[F.round(F.col("features")[j], digits).alias(f"f{j}") for j in range(n)])


def one(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(F.round("score", digits).alias("score"))


# ---- scalers and normalisers

X = [f"x{j}" for j in range(4)]
STATS = "st AS (SELECT " + ", ".join(f"avg({x}) AS m{j}, stddev_samp({x}) AS s{j}, min({x}) AS lo{j}, max({x}) AS hi{j}, max(abs({x})) AS a{j}" for j, x in enumerate(X)) + " FROM li)"


def _scaled(expr: str, stats: bool = True) -> str:
    cols = ", ".join(f"round({expr.format(x=x, j=j)}, 6) AS f{j}" for j, x in enumerate(X))
    return f"WITH {L_SQL}" + (f", {STATS} SELECT id, {cols} FROM li, st" if stats else f" SELECT id, {cols} FROM li")


for _name, _make, _sql in (
    ("standard_scaler", preprocessing.StandardScaler, _scaled("({x} - m{j}) / s{j}")),
    ("min_max_scaler", preprocessing.MinMaxScaler, _scaled("({x} - lo{j}) / (hi{j} - lo{j})")),
    ("max_abs_scaler", preprocessing.MaxAbsScaler, _scaled("{x} / a{j}")),
    ("l1_normalizer", preprocessing.L1Normalizer, _scaled("{x} / (abs(x0) + abs(x1) + abs(x2) + abs(x3))", False)),
    ("l2_normalizer", preprocessing.L2Normalizer, _scaled("{x} / sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3)", False)),
    ("max_normalizer", preprocessing.MaxNormalizer, _scaled("{x} / greatest(abs(x0), abs(x1), abs(x2), abs(x3))", False)),
    ("binarizer", lambda: preprocessing.Binarizer(0.04), _scaled("CASE WHEN {x} > 0.04::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", False)),
    ("bin_discretizer", lambda: preprocessing.BinDiscretizer(7), _scaled("greatest(0, (SELECT count(*) FROM range(7) r(k) WHERE lo{j} + k * ((hi{j} - lo{j}) / 7) <= {x}) - 1)::DOUBLE")),
):
    register(_name, _sql)(lambda spark, d, make=_make: flat(make().fit_transform(lines(spark, d)), 4))

register("polynomial_features", f"WITH {L_SQL} SELECT id, 1.0::DOUBLE AS f0, round(x0, 6) AS f1, round(x2, 6) AS f2, round(x0 * x0, 6) AS f3, round(x0 * x2, 6) AS f4, round(x2 * x2, 6) AS f5 FROM li")(
    lambda spark, d: flat(preprocessing.PolynomialFeatures(2).fit_transform(lines(spark, d).withColumn("features", F.array(F.col("features")[0], F.col("features")[2]))), 6)
)
register("normalize", _scaled("{x} / sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3)", False))(lambda spark, d: flat(preprocessing.normalize(lines(spark, d), "l2"), 4))

# ---- encoders

register("label_encoder", "SELECT p_partkey AS id, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS code FROM part")(lambda spark, d: preprocessing.LabelEncoder().fit_transform(table(spark, d, "part"), "p_brand").select(F.col("p_partkey").alias("id"), "code"))
register("ordinal_encoder", "SELECT p_partkey AS id, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS brand, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS kind FROM part")(
    lambda spark, d: preprocessing.OrdinalEncoder().fit(t := table(spark, d, "part"), ["p_brand", "p_type"]).transform(t).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
)
register("one_hot_encoder", "WITH k AS (SELECT DISTINCT p_size AS v FROM part) SELECT p_partkey AS id, (SELECT count(*) FROM k WHERE v <= p_size)::INTEGER AS hot, (SELECT count(*) FROM k)::INTEGER AS width FROM part")(
    lambda spark, d: preprocessing.OneHotEncoder().fit_transform(table(spark, d, "part").select(F.col("p_partkey").alias("id"), doubles("p_size").alias("features"))).select("id", F.array_position("features", 1.0).cast("int").alias("hot"), F.size("features").alias("width"))
)


@register("label_binarizer", "SELECT o_orderkey AS id, " + ", ".join(f"(o_orderpriority = (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 1 OFFSET {k}))::INTEGER AS c{k}" for k in range(5)) + " FROM orders")
def label_binarizer(spark, d):
    df = preprocessing.LabelBinarizer().fit(t := table(spark, d, "orders"), "o_orderpriority").transform(t)
    return df.select(F.col("o_orderkey").alias("id"), *[F.col("codes")[k].alias(f"c{k}") for k in range(5)])


register("binarize_labels", "SELECT vec_id AS id, (label = 3)::INTEGER AS c3 FROM embeddings")(lambda spark, d: preprocessing.binarize_labels(vectors(spark, d)).select("id", F.col("codes")[3].alias("c3")))


def _props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "map<string,double>").alias("features"))


register("hash_vectorizer", "SELECT event_id AS id, coalesce(round((props::JSON->>'k')::DOUBLE, 6), 0) AS k FROM events")(lambda spark, d: features.HashVectorizer().fit_transform(_props(spark, d)).select("id", F.round(F.col("features")[0], 6).alias("k")))
register("feature_hasher")(lambda spark, d: features.FeatureHasher(16).fit_transform(_props(spark, d)).select("id", F.array_join("features", ",").alias("features")))

# ---- text

T_SQL = "tc AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents) GROUP BY doc_id, term), nd AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tc GROUP BY term)"


def _tfidf_sql(smooth: int, tf: str, size: str | None) -> str:
    w = f"WITH {T_SQL}, w AS (SELECT id, term, {tf} * (ln((n + {smooth}) / (df + {smooth})) + 1) AS weight FROM tc JOIN df USING (term), nd)"
    if size is None:
        return f"{w} SELECT id, term, round(weight, 6) AS weight FROM w"
    return f"{w}, z AS (SELECT id, {size} AS size FROM w GROUP BY id) SELECT id, term, round(weight / size, 6) AS weight FROM w JOIN z USING (id)"


for _name, _args, _sql in (
    ("tfidf", (False, False, "l2"), _tfidf_sql(0, "tf::DOUBLE", "sqrt(sum(weight * weight))")),
    ("tfidf_smooth", (True, False, "l1"), _tfidf_sql(1, "tf::DOUBLE", "sum(abs(weight))")),
    ("tfidf_sublinear", (False, True, "none"), _tfidf_sql(0, "(ln(tf) + 1)", None)),
):

    @register(_name, _sql)
    def tfidf(spark, d, args=_args):
        docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
        return features.tfidf_long(features.term_counts(docs), docs.count(), *args).select("id", "term", F.round("weight", 6).alias("weight"))


# ---- pairwise metrics of all embeddings with all

E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
SQ = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT, COS = "list_inner_product(a.x, b.x)", "list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)))"
for _name, _of, _out, _sql in (
    ("euclidean_distance", pairwise.euclidean_distance, "distance", f"sqrt({SQ})"),
    ("manhattan_distance", pairwise.manhattan_distance, "distance", "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))"),
    ("squared_error", pairwise.squared_error, "distance", SQ),
    ("cosine_similarity", pairwise.cosine_similarity, "similarity", COS),
    ("cosine_distance", pairwise.cosine_distance, "distance", f"CASE WHEN a.id = b.id THEN 0 ELSE least(2, greatest(0, 1 - {COS})) END"),
    ("rbf_kernel", pairwise.rbf_kernel, "kernel", f"exp(-{SQ} / len(a.x))"),
    ("linear_kernel", pairwise.linear_kernel, "kernel", DOT),
    ("polynomial_kernel", pairwise.polynomial_kernel, "kernel", f"pow({DOT} / len(a.x) + 1, 3)"),
    ("sigmoid_kernel", pairwise.sigmoid_kernel, "kernel", f"tanh({DOT} / len(a.x) + 1)"),
):
    register(_name, f"WITH {E_SQL} SELECT a.id AS i, b.id AS j, round(({_sql})::DOUBLE, 5) AS {_out} FROM e a, e b")(lambda spark, d, of=_of, out=_out: of(vectors(spark, d)).select("i", "j", F.round(out, 5).alias(out)))

# ---- evaluation measures

CELLS = f"WITH {L_SQL}, ec AS (SELECT y AS class, sum((y = p)::INTEGER)::DOUBLE AS tp, count(*)::DOUBLE AS support, (SELECT count(*) FROM li b WHERE b.p = li.y)::DOUBLE AS predicted FROM li GROUP BY y), pr AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pre, tp / support AS rec, tp, predicted, support FROM ec), f AS (SELECT *, CASE WHEN pre + rec = 0 THEN 0 ELSE 2 * pre * rec / (pre + rec) END AS fs FROM pr)"
MICRO = CELLS + ", m AS (SELECT sum(tp) / sum(predicted) AS pre, sum(tp) / sum(support) AS rec FROM f)"
register("accuracy", f"WITH {L_SQL} SELECT round(avg((y = p)::INTEGER), 6) AS score FROM li")(lambda spark, d: one(metrics.accuracy(lines(spark, d))))
for _name, _of, _col in (("precision", metrics.precision, "pre"), ("recall", metrics.recall, "rec"), ("f_score", metrics.f_score, "fs")):
    register(_name, f"{CELLS} SELECT round({_col}, 6) AS score FROM f ORDER BY class DESC LIMIT 1")(lambda spark, d, of=_of: one(of(lines(spark, d))))
    register(f"{_name}_each_class", f"{CELLS} SELECT class, round({_col}, 6) AS value FROM f")(lambda spark, d, of=getattr(metrics, f"{_name}_each_class"), c=_name: of(lines(spark, d)).select("class", F.round(c, 6).alias("value")))
    register(f"macro_average_{_name}", f"{CELLS} SELECT round(avg({_col}), 6) AS score FROM f")(lambda spark, d, of=getattr(metrics, f"macro_average_{_name}"): one(of(lines(spark, d))))
    register(f"micro_average_{_name}", f"{MICRO} SELECT round({'2 * pre * rec / (pre + rec)' if _col == 'fs' else _col}, 6) AS score FROM m")(lambda spark, d, of=getattr(metrics, f"micro_average_{_name}"): one(of(lines(spark, d))))
register("confusion_matrix", f'WITH {L_SQL}, k AS (SELECT DISTINCT y FROM li) SELECT a.y AS "true", b.y AS predicted, (SELECT count(*) FROM li WHERE li.y = a.y AND li.p = b.y) AS n FROM k a, k b')(lambda spark, d: metrics.confusion_matrix(lines(spark, d)))
register("log_loss", f"WITH {L_SQL} SELECT round(avg(-ln(CASE WHEN y = 2 THEN x2 * 8 + 0.1::DOUBLE ELSE 1 - (x2 * 8 + 0.1::DOUBLE) END)), 6) AS score FROM li")(lambda spark, d: one(metrics.log_loss(lines(spark, d).withColumn("probability", F.col("discount") * 8 + F.lit(0.1)))))
ROC = f"WITH {L_SQL}, g AS (SELECT x2 AS t, sum((y = 2)::INTEGER)::DOUBLE AS p, count(*)::DOUBLE AS n FROM li GROUP BY x2), c AS (SELECT t, sum(n - p) OVER (ORDER BY t DESC) / sum(n - p) OVER () AS fpr, sum(p) OVER (ORDER BY t DESC) / sum(p) OVER () AS tpr FROM g UNION ALL SELECT max(t) + 1, 0, 0 FROM g)"
register("roc_curve", f"{ROC} SELECT round(t, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM c")(lambda spark, d: metrics.roc_curve(lines(spark, d), score="discount").select(*[F.round(c, 6).alias(c) for c in ("threshold", "fpr", "tpr")]))
register("roc_auc", f"{ROC}, a AS (SELECT (fpr - lag(fpr) OVER (ORDER BY t DESC)) * (tpr + lag(tpr) OVER (ORDER BY t DESC)) / 2 AS a FROM c) SELECT round(sum(a), 6) AS score FROM a")(lambda spark, d: one(metrics.roc_auc(lines(spark, d), score="discount")))


def _regression(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("prediction", F.col("features")[0] * 1500.0)


P = "x0 * 1500"
for _name, _of, _sql, _digits in (
    ("mean_absolute_error", metrics.mean_absolute_error, f"avg(abs(x1 - {P}))", 4),
    ("mean_squared_error", metrics.mean_squared_error, f"avg((x1 - {P}) * (x1 - {P}))", 1),
    ("mean_squared_log_error", metrics.mean_squared_log_error, f"avg(pow(ln(1 + x1) - ln(1 + {P}), 2))", 6),
    ("median_absolute_error", metrics.median_absolute_error, f"median(abs(x1 - {P}))", 4),
    ("r2_score", metrics.r2_score, f"1 - sum(pow(x1 - {P}, 2)) / (var_pop(x1) * count(*))", 6),
    ("explained_variance_score", metrics.explained_variance_score, f"1 - var_pop(x1 - {P}) / var_pop(x1)", 6),
):
    register(_name, f"WITH {L_SQL} SELECT round({_sql}, {_digits}) AS score FROM li")(lambda spark, d, of=_of, n=_digits: one(of(_regression(spark, d)), n))

CONT = f"WITH {L_SQL}, c AS (SELECT y, p, count(*)::DOUBLE AS n FROM li GROUP BY y, p), m AS (SELECT n, sum(n) OVER (PARTITION BY y) AS a, sum(n) OVER (PARTITION BY p) AS b, sum(n) OVER () AS t FROM c)"
MI = "sum(n / t * ln(n * t / (a * b)))"
register("mutual_information", f"{CONT} SELECT round({MI}, 6) AS score FROM m")(lambda spark, d: one(metrics.mutual_information(lines(spark, d))))
register("normalized_mutual_information", f"{CONT} SELECT round({MI} / sqrt(sum(-n / t * ln(a / t)) * sum(-n / t * ln(b / t))), 6) AS score FROM m")(lambda spark, d: one(metrics.normalized_mutual_information(lines(spark, d))))
register("adjusted_rand_score", f"{CONT}, s AS (SELECT sum(n * (n - 1) / 2) AS i, sum((a - 1) / 2 * n) AS sa, sum((b - 1) / 2 * n) AS sb, max(t) * (max(t) - 1) / 2 AS w FROM m) SELECT round((i - sa * sb / w) / ((sa + sb) / 2 - sa * sb / w), 6) AS score FROM s")(lambda spark, d: one(metrics.adjusted_rand_score(lines(spark, d))))
register("purity", f"{CONT} SELECT round(sum(k) / sum(s), 6) AS score FROM (SELECT max(n) AS k, sum(n) AS s FROM c GROUP BY p)")(lambda spark, d: one(metrics.purity(lines(spark, d))))

LONG = f"WITH {E_SQL}, l AS (SELECT id, label, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM e), c AS (SELECT label, j, avg(v) AS m, count(*)::DOUBLE AS n FROM l GROUP BY label, j)"
register("calinski_harabasz_score", f"{LONG}, w AS (SELECT sum(pow(v - m, 2)) AS w, count(DISTINCT label) AS k, count(DISTINCT id) AS n FROM l JOIN c USING (label, j)), g AS (SELECT j, avg(v) AS g FROM l GROUP BY j), b AS (SELECT sum(n * pow(m - g, 2)) AS b FROM c JOIN g USING (j)) SELECT round(b / w * (n - k) / (k - 1), 4) AS score FROM w, b")(lambda spark, d: one(metrics.calinski_harabasz_score(vectors(spark, d)), 4))
register("davies_bouldin_score", f"{LONG}, s AS (SELECT label, avg(r) AS s FROM (SELECT id, label, sqrt(sum(pow(v - m, 2))) AS r FROM l JOIN c USING (label, j) GROUP BY id, label) GROUP BY label), q AS (SELECT a.label AS la, b.label AS lb, sqrt(sum(pow(a.m - b.m, 2))) AS q FROM c a JOIN c b ON a.j = b.j AND a.label <> b.label GROUP BY a.label, b.label), t AS (SELECT la, max((x.s + y.s) / q) AS w FROM q JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY la) SELECT round(avg(w), 5) AS score FROM t")(lambda spark, d: one(metrics.davies_bouldin_score(vectors(spark, d)), 5))
register("silhouette_score", f"WITH {E_SQL}, k AS (SELECT label, count(*) AS n FROM e GROUP BY label), s AS (SELECT a.id, a.label AS own, b.label, sum(sqrt({SQ})) AS s FROM e a, e b GROUP BY a.id, a.label, b.label), r AS (SELECT id, max(CASE WHEN own = s.label THEN s / (n - 1) END) AS a, min(CASE WHEN own <> s.label THEN s / n END) AS b FROM s JOIN k USING (label) GROUP BY id) SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS score FROM r")(lambda spark, d: one(metrics.silhouette_score(vectors(spark, d)), 5))

# ---- splits


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))


register("k_fold", "SELECT o_orderkey AS id, (ntile(3) OVER (ORDER BY o_orderkey) - 1)::INTEGER AS fold FROM orders")(lambda spark, d: selection.KFold(3).folds(_orders(spark, d)).select("id", "fold"))
register("stratified_k_fold", "SELECT o_orderkey AS id, (ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INTEGER AS fold FROM orders")(lambda spark, d: selection.StratifiedKFold(3).folds(_orders(spark, d)).select("id", "fold"))
register("time_series_split", "WITH n AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events), k AS (SELECT id, pos, k, n // 6 AS size, n // 6 + n % 6 + (n // 6) * k AS start FROM n, range(5) r(k)) SELECT k::INTEGER AS split, id, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM k WHERE pos < start + size")(lambda spark, d: selection.TimeSeriesSplit(5, order="ts").roles(table(spark, d, "events").withColumnRenamed("event_id", "id")))
register("shuffle_split")(lambda spark, d: selection.ShuffleSplit(3, 0.1, random_seed=1).roles(_orders(spark, d)))
register("stratified_shuffle_split")(lambda spark, d: selection.StratifiedShuffleSplit(3, 0.1, random_seed=1).roles(_orders(spark, d)))
register("group_shuffle_split")(lambda spark, d: selection.GroupShuffleSplit(2, 0.2, random_seed=1, group="c_nationkey").roles(table(spark, d, "customer").withColumnRenamed("c_custkey", "id")))
register("train_test_split")(lambda spark, d: selection.train_test_split(_orders(spark, d), 0.2, stratify=True, random_seed=1)[1].select("id"))

# ---- naive Bayes, neighbours

CL = f"WITH {L_SQL}, t AS (SELECT count(*)::DOUBLE AS n FROM li), "
ARGMAX = "SELECT id, c::INTEGER AS prediction FROM (SELECT id, c, row_number() OVER (PARTITION BY rid ORDER BY s DESC, c) AS r FROM s) WHERE r = 1"
SUMS = "q AS (SELECT y AS c, count(*)::DOUBLE AS k, " + ", ".join(f"sum({x}) + 1 AS a{j}" for j, x in enumerate(X)) + " FROM li GROUP BY y)"
REST = "q AS (SELECT o.y AS c, (SELECT count(*) FROM li z WHERE z.y = o.y)::DOUBLE AS k, " + ", ".join(f"(sum({x}) FILTER (li.y <> o.y)) + 1 AS a{j}" for j, x in enumerate(X)) + " FROM li, (SELECT DISTINCT y FROM li) o GROUP BY o.y)"
TOT = "(a0 + a1 + a2 + a3)"
for _name, _make, _sql in (
    ("gaussian_nb", bayes.GaussianNB, CL + "q AS (SELECT y AS c, count(*)::DOUBLE AS k, " + ", ".join(f"avg({x}) AS m{j}, var_samp({x}) AS v{j}" for j, x in enumerate(X)) + " FROM li GROUP BY y), s AS (SELECT id, rid, c, ln(k / n) - 0.5 * (" + " + ".join(f"ln(2 * pi() * v{j}) + pow({x} - m{j}, 2) / v{j}" for j, x in enumerate(X)) + ") AS s FROM li, q, t) " + ARGMAX),
    ("multinomial_nb", bayes.MultinomialNB, CL + SUMS + ", s AS (SELECT id, rid, c, ln(k / n) + " + " + ".join(f"CASE WHEN {x} > 0 THEN ln(a{j} / {TOT}) ELSE 0 END" for j, x in enumerate(X)) + " AS s FROM li, q, t) " + ARGMAX),
    ("bernoulli_nb", lambda: bayes.BernoulliNB(1.0, 0.04), CL + "q AS (SELECT y AS c, count(*)::DOUBLE AS k, " + ", ".join(f"(sum(({x} > 0.04::DOUBLE)::INTEGER) + 1) / (count(*) + 2)::DOUBLE AS p{j}" for j in range(4) for x in [X[j]]) + " FROM li GROUP BY y), s AS (SELECT id, rid, c, ln(k / n) + " + " + ".join(f"CASE WHEN {x} > 0.04::DOUBLE THEN ln(p{j}) ELSE ln(1 - p{j}) END" for j, x in enumerate(X)) + " AS s FROM li, q, t) " + ARGMAX),
    ("complement_nb", bayes.ComplementNB, CL + REST + ", s AS (SELECT id, rid, c, ln(k / n) - (" + " + ".join(f"{x} * ln(a{j} / {TOT})" for j, x in enumerate(X)) + ") AS s FROM li, q, t) " + ARGMAX),
    ("negation_nb", bayes.NegationNB, CL + REST + ", s AS (SELECT id, rid, c, ln(1 / (1 - k / n)) - (" + " + ".join(f"{x} * ln(a{j} / {TOT})" for j, x in enumerate(X)) + ") AS s FROM li, q, t) " + ARGMAX),
):
    register(_name, _sql)(lambda spark, d, make=_make: make().fit(df := lines(spark, d)).predict(df.drop("prediction")).select("id", "prediction"))

KNN = f"WITH {E_SQL}, d AS (SELECT a.id AS query, b.id, b.label, sqrt({SQ}) AS d FROM e a, e b), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS r FROM d QUALIFY r <= 5)"
register("k_neighbors_classifier", f"{KNN}, s AS (SELECT query AS id, query AS rid, label AS c, count(*) AS s FROM n GROUP BY query, label) {ARGMAX}")(lambda spark, d: neighbors.KNeighborsClassifier(5).fit(df := vectors(spark, d)).predict(df).select("id", "prediction"))
register("k_neighbors_regressor", f"{KNN} SELECT query AS id, round(avg(label::DOUBLE), 6) AS prediction FROM n GROUP BY query")(lambda spark, d: neighbors.KNeighborsRegressor(5).fit(df := vectors(spark, d)).predict(df).select("id", F.round("prediction", 6).alias("prediction")))
register("nearest_neighbors", f"{KNN} SELECT query, id, r::INTEGER AS rank FROM n")(lambda spark, d: neighbors.nearest(df := vectors(spark, d), df, 5).select("query", "id", F.col("rank").cast("int").alias("rank")))

# ---- linear models with closed forms


def _line(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("features", F.array(F.col("features")[0]))


def _coefficients(model) -> list[tuple[float, float]]:
    return [(float(model.weight_vec[0, 0]), float(model.bias_term[0]))]


SXY = f"WITH {L_SQL}, z AS (SELECT sum(x0 * x0) AS a, sum(x0) AS b, count(*)::DOUBLE AS n, sum(x0 * x1) AS p, sum(x1) AS q FROM li)"
register("linear_regression", f"WITH {L_SQL} SELECT round(regr_slope(x1, x0), 3) AS slope, round(regr_intercept(x1, x0), 3) AS intercept FROM li")(lambda spark, d: spark.createDataFrame(_coefficients(linear.LinearRegression().fit(_line(spark, d))), "slope double, intercept double").select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept")))
register("ridge", f"{SXY} SELECT round(((n + 10) * p - b * q) / ((a + 10) * (n + 10) - b * b), 3) AS slope, round(((a + 10) * q - b * p) / ((a + 10) * (n + 10) - b * b), 3) AS intercept FROM z")(lambda spark, d: spark.createDataFrame(_coefficients(linear.Ridge(10.0).fit(_line(spark, d))), "slope double, intercept double").select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept")))
register("dbscan_core", f"WITH {E_SQL}, n AS (SELECT a.id, count(*) AS n FROM e a, e b WHERE sqrt({SQ}) < 9 GROUP BY a.id) SELECT id FROM n WHERE n >= 5")(lambda spark, d: spark.createDataFrame([(int(i),) for i in clustering.DBSCAN(9.0, 5).fit(vectors(spark, d)).core_sample_ids], "id long"))

# ---- learners whose results SQL cannot express: rows only


def _predicts(name: str, make, source=vectors) -> None:
    def query(spark, d):
        df = source(spark, d)
        df = df.drop("prediction") if "prediction" in df.columns else df  # what made df is known by df itself
        return make().fit(df).predict(df).select("id", "prediction")

    register(name)(query)


def _transforms(name: str, make, source=vectors) -> None:
    def query(spark, d):
        df = source(spark, d)
        return make().fit_transform(df).select("id", F.transform("features", lambda v: F.round(v, 4)).alias("features"))

    register(name)(query)


def _kernels(spark: SparkSession, d: str) -> DataFrame:
    return preprocessing.KernelCalculator(gamma=0.01).fit_transform(vectors(spark, d))


def _positive(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("features", F.transform("features", lambda v: F.abs(v)))


for _name, _make in {
    "svr": lambda: linear.SVR(0.01, max_iter=20), "sgd_regressor": lambda: linear.SGDRegressor(max_iter=20, learning_rate=0.001),
    "logistic_regression": lambda: linear.LogisticRegression(max_iter=20), "svc": lambda: linear.SVC(0.01, max_iter=20), "sgd_classifier": lambda: linear.SGDClassifier(max_iter=10, reg_param=0.001),
    "mini_batch_k_means": lambda: clustering.MiniBatchKMeans(8, max_iter=10, random_seed=1), "k_medoids": lambda: clustering.KMedoids(8, random_seed=1), "gaussian_mixture": lambda: clustering.GaussianMixture(4, max_iter=8, random_seed=1),
    "snn": lambda: clustering.SNN(10, 5, 5), "hdbscan": lambda: clustering.HDBSCAN(5), "single_linkage": lambda: clustering.SingleLinkage(8), "mean_shift": lambda: clustering.MeanShift(9.0, max_iter=50), "power_iteration": lambda: clustering.PowerIteration(8, max_iter=200), "spectral_clustering": lambda: clustering.SpectralClustering(8),
    "decision_tree_classifier": lambda: tree.DecisionTreeClassifier(max_depth=3, max_bins=32), "decision_tree_regressor": lambda: tree.DecisionTreeRegressor(max_depth=3, max_bins=32), "extra_tree_classifier": lambda: tree.ExtraTreeClassifier(max_depth=3, max_bins=32), "extra_tree_regressor": lambda: tree.ExtraTreeRegressor(max_depth=3, max_bins=32), "vr_tree_classifier": lambda: tree.VRTreeClassifier(max_depth=3, max_bins=32), "vr_tree_regressor": lambda: tree.VRTreeRegressor(max_depth=3, max_bins=32),
    "random_forest_classifier": lambda: ensemble.RandomForestClassifier(5, max_depth=3, max_bins=32), "random_forest_regressor": lambda: ensemble.RandomForestRegressor(5, max_depth=3, max_bins=32), "extra_trees_classifier": lambda: ensemble.ExtraTreesClassifier(5, max_depth=3, max_bins=32), "extra_trees_regressor": lambda: ensemble.ExtraTreesRegressor(5, max_depth=3, max_bins=32), "vr_trees_classifier": lambda: ensemble.VRTreesClassifier(5, max_depth=3, max_bins=32), "vr_trees_regressor": lambda: ensemble.VRTreesRegressor(5, max_depth=3, max_bins=32),
    "ada_boost_classifier": lambda: ensemble.AdaBoostClassifier(3, max_depth=2, max_bins=16), "ada_boost_regressor": lambda: ensemble.AdaBoostRegressor(3, max_depth=2, max_bins=16), "gradient_boosting_regressor": lambda: ensemble.GradientBoostingRegressor(3, max_depth=2, max_bins=16),
    "voting_classifier": lambda: ensemble.VotingClassifier({"nb": bayes.GaussianNB(), "rvfl": neural.RVFLClassifier(16)}),
    "stacking_classifier": lambda: ensemble.StackingClassifier({"nb": bayes.GaussianNB(), "rvfl": neural.RVFLClassifier(16)}, neural.RVFLClassifier(8), n_splits=2), "stacking_regressor": lambda: ensemble.StackingRegressor({"ridge": linear.Ridge(), "rvfl": neural.RVFLRegressor(16)}, n_splits=2),
    "mlp_classifier": lambda: neural.MLPClassifier((32,), max_iter=10), "mlp_regressor": lambda: neural.MLPRegressor((32,), max_iter=10), "rbf_classifier": lambda: neural.RBFClassifier(16, max_iter=5), "rbf_regressor": lambda: neural.RBFRegressor(16, max_iter=5), "rvfl_classifier": lambda: neural.RVFLClassifier(32), "rvfl_regressor": lambda: neural.RVFLRegressor(32),
}.items():
    _predicts(_name, _make)

for _name, _make in {"kernel_ridge": lambda: kernel.KernelRidge(1.0), "kernel_ridge_classifier": lambda: kernel.KernelRidgeClassifier(1.0), "kernel_svc": lambda: kernel.KernelSVC(0.1, 200)}.items():
    _predicts(_name, _make, _kernels)

for _name, _make, _source in (
    ("sparse_pca", lambda: decomposition.SparsePCA(2), vectors), ("factor_analysis", lambda: decomposition.FactorAnalysis(2, 30), vectors), ("fast_ica", lambda: decomposition.FastICA(2, max_iter=10), vectors), ("nmf", lambda: decomposition.NMF(3, max_iter=10), _positive),
    ("fisher_discriminant_analysis", lambda: metric_learning.FisherDiscriminantAnalysis(), vectors), ("local_fisher_discriminant_analysis", lambda: metric_learning.LocalFisherDiscriminantAnalysis(2), vectors), ("neighbourhood_component_analysis", lambda: metric_learning.NeighbourhoodComponentAnalysis(2, max_iter=5), vectors), ("mlkr", lambda: metric_learning.MLKR(2, max_iter=5), vectors),
    ("rbf_features", lambda: kernel.RBF(0.01, 32), vectors), ("nystroem", lambda: kernel.Nystroem(gamma=0.01, n_components=16), vectors), ("kernel_pca", lambda: kernel.KernelPCA(2), _kernels), ("kernel_fda", lambda: kernel.KernelFDA(2), _kernels),
    ("classical_mds", lambda: manifold.ClassicalMDS(2), vectors), ("mds", lambda: manifold.MDS(2, max_iter=20), vectors), ("tsne", lambda: manifold.TSNE(2, max_iter=30), vectors), ("laplacian_eigenmaps", lambda: manifold.LaplacianEigenmaps(2), vectors), ("locally_linear_embedding", lambda: manifold.LocallyLinearEmbedding(2), vectors), ("local_tangent_space_alignment", lambda: manifold.LocalTangentSpaceAlignment(2), vectors), ("hessian_eigenmaps", lambda: manifold.HessianEigenmaps(8, 2), vectors),
):
    if not hasattr(_make(), "fit_transform"):
        raise TypeError(_name)
    _transforms(_name, _make, _source)

register("gradient_boosting_classifier")(lambda spark, d: ensemble.GradientBoostingClassifier(3, max_depth=2, max_bins=16).fit(df := vectors(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))).predict(df).select("id", "prediction"))
register("gradient_tree_regressor")(lambda spark, d: tree.GradientTreeRegressor(1.0, 1.0, max_depth=3, max_bins=32).fit(df := vectors(spark, d).withColumn("g", -F.col("target")).withColumn("h", F.lit(1.0))).predict(df).select("id", F.round("prediction", 4).alias("prediction")))
register("make_blobs")(lambda spark, d: generators.make_blobs(spark, 1000, 3, 4, random_seed=1))
register("choice_ids")(lambda spark, d: generators.choice_ids(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("weight")), 1000, seed=1))


@register("libsvm_round_trip", f"WITH {L_SQL} SELECT y AS label, count(*) AS n, round(sum(x0), 2) AS total FROM li GROUP BY y")
def libsvm_round_trip(spark, d):
    """lineitem written as LIBSVM text and read again; the folder is the shared one where the cluster names it."""
    import uuid

    path = f"{shared_dir(spark)}/libsvm-{uuid.uuid4().hex}"
    libsvm.dump_libsvm_file(lines(spark, d), path)
    return libsvm.load_libsvm_file(spark, path, integers=True).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[0]), 2).alias("total"))


# ---- calibration, draws, validation, streams


@register("fit_sigmoid")
def fit_sigmoid(spark, d):
    """Platt's calibration of one feature against half of the classes."""
    from quern.operators.base import platt

    df = vectors(spark, d).select(F.col("features")[0].alias("f"), F.when(F.col("label") >= 5, 1).otherwise(-1).alias("y"))
    return spark.createDataFrame([tuple(float(v) for v in platt(df, "f", "y"))], "alpha double, beta double")


register("rand_uniform")(lambda spark, d: generators.rand_uniform(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "u", 3))
register("rand_normal")(lambda spark, d: generators.rand_normal(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "z", 3))
register("estimator_accuracy", CL + "q AS (SELECT y AS c, count(*)::DOUBLE AS k, " + ", ".join(f"avg({x}) AS m{j}, var_samp({x}) AS v{j}" for j, x in enumerate(X)) + " FROM li GROUP BY y), s AS (SELECT rid, y, c, ln(k / n) - 0.5 * (" + " + ".join(f"ln(2 * pi() * v{j}) + pow({x} - m{j}, 2) / v{j}" for j, x in enumerate(X)) + ") AS s FROM li, q, t), b AS (SELECT y, c, row_number() OVER (PARTITION BY rid ORDER BY s DESC, c) AS r FROM s) SELECT round(avg((y = c)::INTEGER), 6) AS score FROM b WHERE r = 1")(
    lambda spark, d: one(metrics.accuracy(bayes.GaussianNB().fit(df := lines(spark, d).drop("prediction")).predict(df)))
)


@register("stream_mini_batch_k_means")
def stream_mini_batch_k_means(spark, d):
    """Centres learnt from the embeddings table read as a stream, one partial_fit a micro-batch."""
    import uuid

    from quern.streaming.partial import learn

    model = clustering.MiniBatchKMeans(4, random_seed=1)
    schema = table(spark, d, "embeddings").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "embeddings*.parquet").parquet(d)
    rows = stream.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    learn(rows, model, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(model.cluster_centers)], "cluster int, centre array<double>")
