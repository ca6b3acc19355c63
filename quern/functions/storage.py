"""Tables written to the folder that driver and executors share, to cut lineage and to fix what later steps must agree on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if the master is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written and read again: every later use sees the same rows in the same partitions' columns, whatever is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # any names, also equal ones
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
