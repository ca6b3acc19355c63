"""Known values: measures, encoders, hashes, splits and files."""

import math

import pytest
from pyspark.sql import functions as F

from quern.operators import features, metrics, preprocessing, selection
from quern.sources import generators, libsvm


def pairs(spark, true, pred, names=("label", "prediction")):
    kinds = [("array<double>" if isinstance(v[0], list) else "double" if isinstance(v[0], float) else "int") for v in (true, pred)]
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(true, pred, strict=True))], f"id long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")


def rows_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def value(df):
    return df.first()[0]


def matrix(df):
    return [r.features for r in df.orderBy("id").collect()]


def test_roc(spark):
    df = pairs(spark, [1, 1, 2, 2], [0.1, 0.4, 0.35, 0.8], ("label", "score"))
    curve = [(round(r.fpr, 6), round(r.tpr, 6), round(r.threshold, 6)) for r in metrics.roc_curve(df).orderBy(F.desc("threshold")).collect()]
    assert curve == [(0, 0, 1.8), (0, 0.5, 0.8), (0.5, 0.5, 0.4), (0.5, 1, 0.35), (1, 1, 0.1)]
    assert value(metrics.roc_auc(df)) == 0.75


def test_confusion_and_report(spark):
    df = pairs(spark, [0, 1, 2, 2, 2, 0, 1, 2, 0], [0, 0, 2, 0, 2, 0, 0, 2, 1])
    assert [r.n for r in metrics.confusion_matrix(df).orderBy("true", "predicted").collect()] == [2, 1, 0, 2, 0, 0, 1, 0, 3]
    report = metrics.classification_report(df, output_hash=True)
    assert report["0"]["support"] == 3 and abs(report["accuracy"] - 5 / 9) < 1e-12
    assert metrics.classification_report(df).count("\n") == 9


def test_averages(spark):
    df = pairs(spark, [1, 1, -1, -1], [1, -1, 1, -1])
    assert value(metrics.precision(df)) == value(metrics.recall(df)) == value(metrics.f_score(df)) == value(metrics.accuracy(df)) == 0.5
    assert metrics.f_score(df, average="other") is None
    lost = pairs(spark, [0, 0, 1], [0, 5, 5])  # a class of predictions alone is no class
    assert value(metrics.macro_average_precision(lost)) == 0.5 and value(metrics.micro_average_recall(lost)) == 1 / 3


def test_regression_measures(spark):
    df = pairs(spark, [3.0, -0.5, 2.0, 7.0], [2.5, 0.0, 2.0, 8.0], ("target", "prediction"))
    assert value(metrics.median_absolute_error(df)) == 0.5 and value(metrics.mean_absolute_error(df)) == 0.5 and value(metrics.mean_squared_error(df)) == 0.375
    assert abs(value(metrics.explained_variance_score(df)) - 0.957173) < 1e-6 and abs(value(metrics.r2_score(df)) - 0.948608) < 1e-6
    logs = pairs(spark, [3.0, 5.0, 2.5, 7.0], [2.5, 5.0, 4.0, 8.0], ("target", "prediction"))
    assert abs(value(metrics.mean_squared_log_error(logs)) - 0.03973) < 1e-5
    many = pairs(spark, [[0.5, 1.0], [-1.0, 1.0], [7.0, -6.0]], [[0.0, 2.0], [-1.0, 2.0], [8.0, -5.0]], ("target", "prediction"))
    assert abs(value(metrics.explained_variance_score(many)) - 0.983871) < 1e-6 and abs(value(metrics.r2_score(many)) - 0.936801) < 1e-6
    flat = pairs(spark, [1.0, 1.0], [1.0, 2.0], ("target", "prediction"))
    assert value(metrics.r2_score(flat)) == 0


def test_cluster_measures(spark):
    df = pairs(spark, [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2])
    assert abs(value(metrics.adjusted_rand_score(df)) - 0.242424) < 1e-6 and abs(value(metrics.mutual_information(df)) - 0.462098) < 1e-6
    same = pairs(spark, [0, 0, 1, 1], [1, 1, 0, 0])
    assert value(metrics.adjusted_rand_score(same)) == 1 and abs(value(metrics.normalized_mutual_information(same)) - 1) < 1e-12 and value(metrics.purity(same)) == 1
    one = pairs(spark, [0, 0, 0], [0, 0, 0])
    assert value(metrics.adjusted_rand_score(one)) == 1 and value(metrics.normalized_mutual_information(one)) == 0


def test_geometry_of_clusters(spark):
    x = rows_of(spark, [[0, 0], [0, 2], [10, 0], [10, 2], [50, 50]]).withColumn("label", F.least(F.floor(F.col("id") / 2), F.lit(2)).cast("int"))
    found = {r.id: r.silhouette for r in metrics.silhouette_samples(x).collect()}
    far = (10 + math.sqrt(104)) / 2
    assert found[4] == 0 and abs(found[0] - (far - 2) / far) < 1e-9
    equal = rows_of(spark, [[1, 1]] * 4).withColumn("label", (F.col("id") % 2).cast("int"))
    assert value(metrics.calinski_harabasz_score(equal)) == 1
    two = rows_of(spark, [[0, 0], [0, 2], [10, 0], [10, 2]]).withColumn("label", F.floor(F.col("id") / 2).cast("int"))
    assert abs(value(metrics.davies_bouldin_score(two)) - 0.2) < 1e-9 and abs(value(metrics.calinski_harabasz_score(two)) - 50) < 1e-9


def test_log_loss(spark):
    probs = spark.createDataFrame([(0, 0, [0.8, 0.2]), (1, 1, [0.4, 0.6])], "id long, label int, probability array<double>")
    assert abs(value(metrics.log_loss(probs)) + (math.log(0.8) + math.log(0.6)) / 2) < 1e-9


def test_encoders(spark):
    labels = rows_of(spark, [[0], [0], [2], [3], [2], [1]])
    assert matrix(preprocessing.OneHotEncoder().fit_transform(labels))[2] == [0, 0, 1, 0]
    cells = rows_of(spark, [[0, 0, 10], [1, 1, 0], [0, 2, 0], [0, 0, 5]])
    tool = preprocessing.OneHotEncoder().fit(cells)
    assert tool.n_values == [2, 3, 11] and tool.active_features == [0, 1, 2, 3, 4, 5, 10, 15]
    with pytest.raises(ValueError):
        preprocessing.OneHotEncoder().fit(rows_of(spark, [[-1]]))
    df = spark.createDataFrame([(0, "b", 3), (1, "a", 1), (2, "c", 3), (3, None, 2)], "id long, label string, n int")
    coded = preprocessing.LabelEncoder().fit(df)
    assert [r.code for r in coded.transform(df).orderBy("id").collect()] == [1, 0, 2, None]
    assert [r.label for r in coded.inverse_transform(coded.transform(df).drop("label")).orderBy("id").collect()] == ["b", "a", "c", None]
    ordinal = preprocessing.OrdinalEncoder().fit(df, ["label", "n"])
    out = ordinal.transform(df)
    assert [(r.label, r.n) for r in out.orderBy("id").collect()] == [(1, 2), (0, 0), (2, 2), (None, 1)]
    assert [(r.label, r.n) for r in ordinal.inverse_transform(out).orderBy("id").collect()][:3] == [("b", 3), ("a", 1), ("c", 3)]
    codes = preprocessing.LabelBinarizer(-1, 1).fit(df, "n")
    assert [r.codes for r in codes.transform(df).orderBy("id").collect()][0] == [-1, -1, 1]
    assert [r.n for r in codes.inverse_transform(codes.transform(df).drop("n")).orderBy("id").collect()] == [3, 1, 3, 2]


def test_feature_maps(spark):
    df = spark.createDataFrame([(0, {"foo": 1.0, "bar": 2.0}), (1, {"foo": 3.0, "baz": 1.0})], "id long, features map<string,double>")
    tool = features.HashVectorizer().fit(df)
    assert tool.feature_names == ["bar", "baz", "foo"] and matrix(tool.transform(df)) == [[2, 0, 1], [0, 1, 3]]
    assert matrix(tool.inverse_transform(tool.transform(df)))[1] == {"baz": 1.0, "foo": 3.0}
    animals = spark.createDataFrame([(0, {"dog": 1.0, "cat": 2.0, "elephant": 4.0}), (1, {"dog": 2.0, "run": 5.0})], "id long, features map<string,double>")
    assert matrix(features.FeatureHasher(10).transform(animals)) == [[0, 0, -4, -1, 0, 0, 0, 0, 0, 2], [0, 0, 0, -2, -5, 0, 0, 0, 0, 0]]


def test_tfidf(spark):
    x = rows_of(spark, [[2, 0, 1], [0, 1, 3]])
    found = matrix(features.TfidfTransformer("none").fit_transform(x))
    assert [round(v, 6) for v in found[0]] == [round(2 * (math.log(2) + 1), 6), 0, 1]
    smooth = features.TfidfTransformer("l1", smooth_idf=True).fit(x)
    assert abs(smooth.idf[0] - (math.log(3 / 2) + 1)) < 1e-12 and abs(sum(matrix(smooth.transform(x))[1]) - 1) < 1e-12


def test_scalers(spark):
    x = rows_of(spark, [[1, 5, -2], [2, 5, 0], [4, 5, 6]])
    z = matrix(preprocessing.StandardScaler().fit_transform(x))
    assert abs(sum(r[0] for r in z)) < 1e-12 and math.isnan(z[0][1])
    assert matrix(preprocessing.MinMaxScaler((0, 2)).fit_transform(x))[2] == [2, 0, 2]
    assert matrix(preprocessing.MaxAbsScaler().fit_transform(x))[0] == [0.25, 1, -1 / 3]
    assert matrix(preprocessing.BinDiscretizer(3).fit_transform(x)) == [[0, 2, 0], [1, 2, 0], [2, 2, 2]]
    assert matrix(preprocessing.L1Normalizer().fit_transform(rows_of(spark, [[0, 0], [1, -3]]))) == [[0, 0], [0.25, -0.75]]
    assert matrix(preprocessing.PolynomialFeatures(2).fit_transform(rows_of(spark, [[2, 3]]))) == [[1, 2, 3, 4, 6, 9]]


def test_splits(spark):
    df = spark.createDataFrame([(i, [0, 0, 1, 3, 1, 0, 3, 1, 0][i]) for i in range(9)], "id long, group_id int")
    folds = {r.id: r.fold for r in selection.GroupKFold(3).folds(df).collect()}
    assert [[i for i in range(9) if folds[i] == k] for k in range(3)] == [[0, 1, 5, 8], [2, 4, 7], [3, 6]]
    eight = spark.range(8)
    roles = selection.TimeSeriesSplit(3).roles(eight).collect()
    want = [([0, 1], [2, 3]), ([0, 1, 2, 3], [4, 5]), ([0, 1, 2, 3, 4, 5], [6, 7])]
    assert [tuple(sorted(r.id for r in roles if (r.split, r.role) == (k, role)) for role in ("train", "test")) for k in range(3)] == want
    assert [r["count"] for r in selection.KFold(3, shuffle=True, random_seed=4).folds(spark.range(11)).groupBy("fold").count().orderBy("fold").collect()] == [4, 4, 3]
    split = selection.ShuffleSplit(2, 0.25, 0.5).roles(spark.range(10)).groupBy("split", "role").count().orderBy("split", "role").collect()
    assert [(r.role, r["count"]) for r in split] == [("test", 3), ("train", 5)] * 2


def test_libsvm_round_trip(spark, tmp_path):
    (tmp_path / "in.t").write_text("1 1:5 3:1.5\n2\n-3 2:0.25 4:1e-7\n")
    df = libsvm.load_libsvm_file(spark, str(tmp_path / "in.t"), integers=True)
    assert sorted((r.label, r.features) for r in df.collect()) == [(-3, [0, 0.25, 0, 1e-7]), (1, [5, 0, 1.5, 0]), (2, [0, 0, 0, 0])]
    for zero in (False, True):
        libsvm.dump_libsvm_file(df, str(tmp_path / f"out{zero}"), zero_based=zero)
        again = libsvm.load_libsvm_file(spark, str(tmp_path / f"out{zero}"), zero_based=zero, integers=True)
        assert sorted((r.label, r.features) for r in again.collect()) == sorted((r.label, r.features) for r in df.collect())
    (tmp_path / "many.t").write_text("1.5,2 0:1\n-1,0 1:2\n")
    many = libsvm.load_libsvm_file(spark, str(tmp_path / "many.t"), zero_based=True)
    assert sorted((r.target, r.features) for r in many.collect()) == [([-1, 0], [0, 2]), ([1.5, 2], [1, 0])]


def test_generators(spark):
    rings = generators.make_circles(spark, 100, factor=0.5, random_seed=1).collect()
    assert {round(math.hypot(*r.features), 6) for r in rings} == {0.5, 1.0} and sorted(r.id for r in rings) == list(range(100))
    blobs = generators.make_blobs(spark, 10, centers=[[0, 0], [100, 100], [200, 200]], cluster_std=0.1).collect()
    assert sorted(r.label for r in blobs) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2] and all(abs(r.features[0] - 100 * r.label) < 2 for r in blobs)
    assert generators.make_moons(spark, 50, noise=0.1).count() == 50
    drawn = generators.choice_ids(spark.range(3).withColumn("weight", F.lit(1.0) * F.col("id")), 300)
    assert drawn.count() == 300 and {r.id for r in drawn.select("id").distinct().collect()} == {1, 2}
