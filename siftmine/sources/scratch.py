"""Tables that cut the lineage of iterative operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation.

    The table stays until clear(), as results that are computed later may read it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/siftmine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again, and have the driver collect garbage, upon which Spark deletes the
    shuffle files of plans that nothing refers to any more."""
    for t in tables:
        _written.remove(t.scratch_path)
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all tables that settled() wrote; for when no result that was built on them is read again."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
