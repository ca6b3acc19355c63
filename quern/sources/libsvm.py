"""LIBSVM text files: lines of label index:value, comma-separated labels for several targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_libsvm_file(spark: SparkSession, path: str, n_features: int | None = None, zero_based: bool = False, integers: bool = False) -> DataFrame:
    """id (by file and line), label or target, and dense features as wide as the largest index, n_features at least.

    Lines are parsed where they are read; the width is one aggregation. Labels are int with `integers`, else target is
    double, or an array of doubles where a line has several.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("id"), F.split(F.trim("value"), r"\s+").alias("p"))
    cells = F.transform(F.filter(F.slice("p", 2, 1 << 30), lambda x: x.contains(":")), lambda x: F.split(x, ":"))
    rows = lines.select("id", F.split(F.col("p")[0], ",").alias("y"), F.map_from_entries(F.transform(cells, lambda c: F.struct((c[0].cast("int") + int(zero_based)).alias("k"), c[1].cast("double").alias("v")))).alias("x"))
    most = rows.agg(F.max(F.array_max(F.map_keys("x"))), F.max(F.size("y"))).first()
    width = max(n_features or 0, most[0] or 0)
    dense = F.transform(F.sequence(F.lit(1), F.lit(max(width, 1))), lambda k: F.coalesce(F.col("x")[k], F.lit(0.0)))
    many = F.transform("y", lambda v: v.cast("double"))
    value = F.col("y")[0].cast("int").alias("label") if integers else (many if (most[1] or 1) > 1 else F.col("y")[0].cast("double")).alias("target")
    return rows.select("id", value, (dense if width else F.array().cast("array<double>")).alias("features"))


def _number(x) -> F.Column:
    """The shortest of ten significant digits: whole numbers without a point, others in plain or exponent form."""
    # Printf's g keeps trailing zeros here, so they are cut off.
    plain = F.regexp_replace(F.format_string("%.10g", x), r"(\.[0-9]*?)0+(?=$|e)", "$1")
    return F.regexp_replace(plain, r"\.(?=$|e)", "")


def dump_libsvm_file(df: DataFrame, path: str, label: str = "label", zero_based: bool = False) -> None:
    """Writes label or targets and the features that aren't zero, a line a row in order of id within each file."""
    kind = dict(df.dtypes)[label]
    if kind.startswith("array"):
        y = F.array_join(F.transform(label, _number), ",")
    else:
        y = F.col(label).cast("string") if kind in ("int", "bigint", "smallint", "tinyint") else _number(F.col(label))
    cells = F.transform("features", lambda v, i: F.when(v != 0, F.concat((i + (0 if zero_based else 1)).cast("string"), F.lit(":"), _number(v.cast("double")))))
    line = F.concat_ws(" ", y, F.array_join(F.filter(cells, lambda c: c.isNotNull()), " "))
    df.sortWithinPartitions("id").select(F.rtrim(line).alias("value")).write.text(path)
