"""Shared helpers of the training-data operators: tables, shared storage, Arrow mapping, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern shared by several operators; bytes.split() without arguments splits at exactly the excluded bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that outlives any executor."""
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing will read again."""
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quern/" in root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns this process's freed memory to the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def arrow_map(df: DataFrame, each: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 256, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows; `each` turns a dict of column lists into another.

    Slices keep the Python objects of one step small however long the texts are. `after` runs at a partition's end; freed memory
    is given back then, and first at its start, as workers live on from stage to stage.
    """
    kinds = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = each({k: c for k, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_pydict(out, schema=kinds)
        if after:
            after()
        give_back()

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain types."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    fields = []
    for field in schema.split(","):
        name, kind = field.split()
        kind = {"long": "bigint"}.get(kind, kind)
        fields.append(pa.field(name, pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]))
    return pa.schema(fields)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it reaches.

    Labels go along the edges and then through the labels' own labels, so that chains halve; each round is one
    pre-aggregated minimum and joins that adaptive execution can split, saved in the shared folder.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), spark, f"{name}-both")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), spark, f"{name}-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = saved(near.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), spark, f"{name}-labels")
        changed = new.filter(F.col("was") != F.col("root")).limit(1).count()
        forget(spark, labels)
        labels = new.select("node", "root")
        if not changed:
            forget(spark, both)
            return labels
