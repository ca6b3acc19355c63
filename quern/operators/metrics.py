"""Evaluation measures as aggregations: each returns a small DataFrame, by default one row with `score`.

Class lists come from the true labels alone. Binary averages look at the last class in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.arrays import sqdist
from quern.functions.storage import kept


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _score(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("score"))


def accuracy(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return _score(df, F.avg((F.col(true) == F.col(pred)).cast("double")))


def _cells(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def each_class(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """class, tp, predicted, support, precision, recall and f_score, for classes of the true labels."""
    cells = _cells(df, true, pred)
    sides = F.array(F.struct(F.col("t").alias("class"), F.lit(0).alias("side")), F.struct(F.col("p").alias("class"), F.lit(1).alias("side")))
    sums = cells.select(F.explode(sides).alias("s"), "t", "p", "n").groupBy("s.class").agg(
        F.sum(F.when((F.col("s.side") == 0) & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == 1, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("s.side") == 0, F.col("n")).otherwise(0)).alias("support"),
    )
    out = sums.filter("support > 0").withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f_score", _harmonic("precision", "recall"))


def _harmonic(p: str, r: str) -> Column:
    return _ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))


def precision_each_class(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return each_class(df, true, pred).select("class", "precision")


def recall_each_class(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return each_class(df, true, pred).select("class", "recall")


def f_score_each_class(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return each_class(df, true, pred).select("class", "f_score")


def micro_average(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """precision, recall and f_score of the summed counts."""
    sums = each_class(df, true, pred).agg(_ratio(F.sum("tp"), F.sum("predicted")).alias("precision"), _ratio(F.sum("tp"), F.sum("support")).alias("recall"))
    return sums.withColumn("f_score", _harmonic("precision", "recall"))


def macro_average(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """Unweighted means over classes."""
    return each_class(df, true, pred).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f_score")])


def _averaged(df: DataFrame, what: str, average: str, true: str, pred: str) -> DataFrame | None:
    if average == "binary":
        return _score(each_class(df, true, pred), F.max_by(what, "class"))
    if average not in ("micro", "macro"):
        return None
    return (micro_average if average == "micro" else macro_average)(df, true, pred).select(F.col(what).alias("score"))


def precision(df: DataFrame, true: str = "label", pred: str = "prediction", average: str = "binary") -> DataFrame | None:
    return _averaged(df, "precision", average, true, pred)


def recall(df: DataFrame, true: str = "label", pred: str = "prediction", average: str = "binary") -> DataFrame | None:
    return _averaged(df, "recall", average, true, pred)


def f_score(df: DataFrame, true: str = "label", pred: str = "prediction", average: str = "binary") -> DataFrame | None:
    return _averaged(df, "f_score", average, true, pred)


def micro_average_precision(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return precision(df, true, pred, "micro")


def micro_average_recall(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return recall(df, true, pred, "micro")


def micro_average_f_score(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return f_score(df, true, pred, "micro")


def macro_average_precision(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return precision(df, true, pred, "macro")


def macro_average_recall(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return recall(df, true, pred, "macro")


def macro_average_f_score(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return f_score(df, true, pred, "macro")


def confusion_matrix(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """true, predicted and n for every pair of true classes."""
    cells = _cells(df, true, pred)
    known = cells.select("t").distinct()
    grid = known.select(F.col("t").alias("true")).crossJoin(F.broadcast(known.select(F.col("t").alias("predicted"))))
    return grid.join(cells, (F.col("true") == F.col("t")) & (F.col("predicted") == F.col("p")), "left").select("true", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, true: str = "label", pred: str = "prediction", target_name: list[str] | None = None, output_hash: bool = False) -> str | dict:
    """Rows by class, accuracy, macro and weighted averages, as a table of text or a dict."""
    rows = each_class(df, true, pred).orderBy("class").collect()
    n = sum(r.support for r in rows)
    names = target_name or [str(r["class"]) for r in rows]
    keys = ("precision", "recall", "f_score")
    own = {name: {k: r[k] for k in keys} | {"support": r.support} for name, r in zip(names, rows, strict=True)}
    macro = {k: sum(r[k] for r in rows) / len(rows) for k in keys} | {"support": n}
    weighted = {k: sum(r[k] * r.support for r in rows) / n for k in keys} | {"support": n}
    right = sum(r.tp for r in rows) / n
    if output_hash:
        return own | {"accuracy": right, "macro_avg": macro, "weighted_avg": weighted}
    wide = max(len("weighted avg"), *map(len, names))
    line = lambda name, r: f"{name:>{wide}}  {r['precision']:9.2f} {r['recall']:9.2f} {r['f_score']:9.2f} {r['support']:9d}\n"
    out = f"{'':>{wide}}  {'precision':>9} {'recall':>9} {'f1-score':>9} {'support':>9}\n\n" + "".join(line(k, r) for k, r in own.items())
    return out + f"\n{'accuracy':>{wide}}  {'':>9} {'':>9} {right:9.2f} {n:9d}\n" + line("macro avg", macro) + line("weighted avg", weighted)


def log_loss(df: DataFrame, true: str = "label", prob: str = "probability") -> DataFrame:
    """Of a probability of the largest label, or of an array of probabilities by class in order."""
    eps = 1e-15
    clip = lambda p: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    known = F.array(*[F.lit(r[0]) for r in df.select(true).distinct().orderBy(true).collect()])
    if dict(df.dtypes)[prob].startswith("array"):
        held = F.transform(prob, clip)
        own = F.element_at(held, F.array_position(known, F.col(true)).cast("int"))
        return _score(df, F.avg(-F.ln(own / F.aggregate(held, F.lit(0.0), lambda a, v: a + v))))
    positive = F.col(true) == F.element_at(known, -1)
    return _score(df, F.avg(-F.when(positive, F.ln(clip(F.col(prob)))).otherwise(F.ln(1 - clip(F.col(prob))))))


def _roc_cells(df: DataFrame, true: str, score: str, pos_label: int | None) -> DataFrame:
    """threshold, p, n, and tp and all: the sums of p and n over it and all higher ones.

    Scores are counted and dealt by ranges, saved; each range sums up its own, after the sums of the ranges above it.
    """
    positive = F.col(true) == (F.lit(pos_label) if pos_label is not None else F.lit(df.agg(F.max(true)).first()[0]))
    cells = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(positive.cast("long")).alias("p"), F.count("*").alias("n"))
    dealt = kept(cells.repartitionByRange(F.desc("threshold")).withColumn("_part", F.spark_partition_id()), "roc")
    parts = dealt.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # a row a range
    above = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_all"), F.sum("_p").over(W.partitionBy()).alias("positives"), F.sum("_n").over(W.partitionBy()).alias("total"))
    down = W.partitionBy("_part").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    dealt = dealt.withColumn("tp", F.sum("p").over(down)).withColumn("all", F.sum("n").over(down)).join(F.broadcast(parts), "_part")
    return dealt.select("threshold", "p", "n", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("all") + F.col("_all")).alias("all"), "positives", "total")


def roc_curve(df: DataFrame, true: str = "label", score: str = "score", pos_label: int | None = None) -> DataFrame:
    """fpr, tpr and threshold by falling threshold, from (0, 0) at one above the largest."""
    cells = _roc_cells(df, true, score, pos_label)
    curve = cells.select("threshold", _ratio(F.col("all") - F.col("tp"), F.col("total") - F.col("positives")).alias("fpr"), _ratio(F.col("tp"), F.col("positives")).alias("tpr"))
    start = cells.agg((F.max("threshold") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def auc(curve: DataFrame) -> DataFrame:
    """Area below a curve by trapezoids."""
    along = W.orderBy(F.desc("threshold"))
    area = (F.col("fpr") - F.lag("fpr").over(along)) * (F.col("tpr") + F.lag("tpr").over(along)) / 2
    return curve.select(area.alias("area")).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("score"))


def roc_auc(df: DataFrame, true: str = "label", score: str = "score", pos_label: int | None = None) -> DataFrame:
    """The area by trapezoids, which each threshold's own counts and sums give."""
    cells = _roc_cells(df, true, score, pos_label)
    area = (F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p"))
    sums = cells.agg(F.sum(area.cast("double")).alias("area"), F.max("positives").alias("positives"), F.max("total").alias("total"))
    return sums.select(F.coalesce(_ratio(F.col("area") / 2, F.col("positives").cast("double") * (F.col("total") - F.col("positives"))), F.lit(0.0)).alias("score"))


def mean_absolute_error(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    return _errors(df, true, pred, lambda t, p: F.abs(t - p))


def mean_squared_error(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    return _errors(df, true, pred, lambda t, p: (t - p) * (t - p))


def mean_squared_log_error(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    return _errors(df, true, pred, lambda t, p: (F.log1p(t) - F.log1p(p)) * (F.log1p(t) - F.log1p(p)))


def _long(df: DataFrame, true: str, pred: str) -> DataFrame:
    """output number, t and p: outputs of a row side by side become rows."""
    if dict(df.dtypes)[true].startswith("array"):
        return df.select(F.posexplode(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p"))).alias("k", "v")).select("k", F.col("v.t").alias("t"), F.col("v.p").alias("p"))
    return df.select(F.lit(0).alias("k"), F.col(true).alias("t"), F.col(pred).alias("p"))


def _errors(df: DataFrame, true: str, pred: str, of) -> DataFrame:
    return _score(_long(df, true, pred), F.avg(of(F.col("t"), F.col("p"))))


def median_absolute_error(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    """The exact median over all outputs, by the rows' places in a distributed sort."""
    from quern.operators.selection import positions

    gaps = positions(_long(df, true, pred).select(F.abs(F.col("t") - F.col("p")).alias("gap")).filter("gap IS NOT NULL"), [], [F.col("gap")])
    middle = gaps.filter((F.col("position") >= F.floor((F.col("position_of") - 1) / 2)) & (F.col("position") <= F.floor(F.col("position_of") / 2)))
    return _score(middle, F.avg("gap"))


def r2_score(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    """1 - SSE / SST, 0 where SST is; mean over outputs."""
    gap = F.col("t") - F.col("p")
    each = _long(df, true, pred).groupBy("k").agg(F.sum(gap * gap).alias("sse"), (F.var_pop("t") * F.count("t")).alias("sst"))
    return _score(each, F.avg(F.when(F.col("sst") == 0, 0.0).otherwise(1 - F.col("sse") / F.col("sst"))))


def explained_variance_score(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    """1 - Var(error) / Var(true); outputs without variance add 0 to the mean over all."""
    each = _long(df, true, pred).groupBy("k").agg(F.var_pop(F.col("t") - F.col("p")).alias("e"), F.var_pop("t").alias("v"))
    return _score(each, F.avg(F.when(F.col("v") == 0, 0.0).otherwise(1 - F.col("e") / F.col("v"))))


def _margins(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Cells with their row, column and whole sums."""
    cells = _cells(df, true, pred)
    return cells.select("t", "p", "n", F.sum("n").over(W.partitionBy("t")).alias("a"), F.sum("n").over(W.partitionBy("p")).alias("b"), F.sum("n").over(W.partitionBy()).alias("all"))


def adjusted_rand_score(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """Pair-count ARI; 1.0 if both are one class, both all singletons, or there are no rows."""
    two = lambda n: n * (n - 1) / 2
    m = _margins(df, true, pred)
    sums = m.agg(F.sum(two(F.col("n"))).alias("i"), F.sum(two(F.col("a")) * F.col("n") / F.col("a")).alias("sa"), F.sum(two(F.col("b")) * F.col("n") / F.col("b")).alias("sb"), F.max("all").alias("all"), F.countDistinct("t").alias("nt"), F.countDistinct("p").alias("np"))
    chance = F.col("sa") * F.col("sb") / two(F.col("all"))
    special = (F.col("nt") == F.col("np")) & F.col("nt").isin(0, 1) | ((F.col("nt") == F.col("np")) & (F.col("nt") == F.col("all")))
    return sums.select(F.when(special | F.col("all").isNull(), 1.0).otherwise((F.col("i") - chance) / ((F.col("sa") + F.col("sb")) / 2 - chance)).alias("score"))


def mutual_information(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    share = F.col("n") / F.col("all")
    return _score(_margins(df, true, pred), F.sum(share * F.ln(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))))


def normalized_mutual_information(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """MI / sqrt(H(true) H(predicted)); 0 if either entropy is."""
    share = F.col("n") / F.col("all")
    sums = _margins(df, true, pred).agg(
        F.sum(share * F.ln(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(-share * F.ln(F.col("a") / F.col("all"))).alias("ht"), F.sum(-share * F.ln(F.col("b") / F.col("all"))).alias("hp")
    )
    return sums.select(F.when((F.col("ht") == 0) | (F.col("hp") == 0), 0.0).otherwise(F.col("mi") / F.sqrt(F.col("ht") * F.col("hp"))).alias("score"))


def purity(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    each = _cells(df, true, pred).groupBy("p").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return _score(each, F.sum("most") / F.sum("n"))


def centroids(df: DataFrame, cluster: str = "label") -> DataFrame:
    """cluster, n and centroid, an array."""
    long = df.select(F.col(cluster).alias("cluster"), F.posexplode(F.col("features").cast("array<double>")).alias("j", "v"))
    means = long.groupBy("cluster", "j").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"])
    return means.groupBy("cluster").agg(F.max("n").alias("n"), ordered.alias("centroid"))


def _to_centroids(df: DataFrame, cluster: str, of) -> tuple[DataFrame, DataFrame]:
    c = centroids(df, cluster)
    rows = df.select(F.col(cluster).alias("cluster"), F.col("features").cast("array<double>").alias("x")).join(F.broadcast(c), "cluster")
    return c, rows.groupBy("cluster").agg(of(sqdist(F.col("x"), F.col("centroid"))).alias("v"))


def calinski_harabasz_score(df: DataFrame, cluster: str = "label") -> DataFrame:
    """Dispersion between clusters over within; 1.0 where there is none within."""
    c, within = _to_centroids(df, cluster, F.sum)
    long = c.select("n", F.posexplode("centroid").alias("j", "m"))
    spread = long.groupBy("j").agg((F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("s"))
    sums = spread.agg(F.sum("s").alias("between")).crossJoin(within.agg(F.sum("v").alias("within"))).crossJoin(c.agg(F.count("*").alias("k"), F.sum("n").alias("n")))
    return sums.select(F.when(F.col("within") == 0, 1.0).otherwise(F.col("between") / F.col("within") * (F.col("n") - F.col("k")) / (F.col("k") - 1)).alias("score"))


def davies_bouldin_score(df: DataFrame, cluster: str = "label") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij."""
    c, spread = _to_centroids(df, cluster, lambda d: F.avg(F.sqrt(d)))
    c = c.join(spread, "cluster")
    a, b = (c.select(*[F.col(x).alias(f"{x}_{s}") for x in ("cluster", "centroid", "v")]) for s in "ab")
    far = a.crossJoin(F.broadcast(b)).filter("cluster_a <> cluster_b")
    ratio = (F.col("v_a") + F.col("v_b")) / F.sqrt(sqdist(F.col("centroid_a"), F.col("centroid_b")))
    return far.groupBy("cluster_a").agg(F.max(ratio).alias("worst")).agg(F.avg("worst").alias("score"))


def silhouette_samples(df: DataFrame, cluster: str = "label", limit: int = 20_000, metric: str = "euclidean") -> DataFrame:
    """id and silhouette: exact, in numpy blocks of every row against the whole set, which is broadcast up to `limit` rows."""
    import numpy as np

    from quern.functions.numeric import collected, with_numpy
    from quern.operators.preprocessing import squared

    rows = df.select("id", F.col("features").cast("array<double>").alias("features"), F.col(cluster).cast("int").alias("_own"))
    x, own = collected(rows, ["features", "_own"], limit)
    known, at = np.unique(own, return_inverse=True)
    onehot = np.eye(len(known))[at]
    sizes = onehot.sum(0)

    def of(part: np.ndarray, label: np.ndarray) -> np.ndarray:
        d = part if metric == "precomputed" else np.sqrt(squared(part, x))
        sums, mine = d @ onehot, np.searchsorted(known, label)
        rows = np.arange(len(part))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = sums[rows, mine] / (sizes[mine] - 1)
            means = sums / sizes
            means[rows, mine] = np.inf
            b = means.min(1)
            s = (b - a) / np.maximum(a, b)
        return np.where(np.isnan(s) | (sizes[mine] == 1) | np.isinf(b), 0.0, s)

    return with_numpy(rows, "silhouette", "double", ["features", "_own"], of).select("id", "silhouette")


def silhouette_score(df: DataFrame, cluster: str = "label", limit: int = 20_000, metric: str = "euclidean") -> DataFrame:
    return _score(silhouette_samples(df, cluster, limit, metric), F.avg("silhouette"))
