"""Batch and streaming sources. All take an explicit schema, so nothing is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """One JSON object a line; partitions only where their number has a meaning."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def csv_rows(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """CSV with a header; columns by position, further ones ignored."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.repartition(partitions) if partitions else df


def matrix(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Numeric CSV without a header: id, label (kept, not used) and dims features, as (id, label, features)."""
    names = [f"x{i}" for i in range(dims)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    return spark.read.schema(schema).csv(path).select("id", "label", F.array(*names).alias("features"))


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def socket_json(spark: SparkSession, host: str, port: int, schema: T.StructType) -> DataFrame:
    """Lines of a TCP socket as JSON, with the time of arrival; lines that don't parse are dropped."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return parsed(lines, schema)


def file_json(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New text files of a folder as JSON lines, with the time at which they are read."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path).withColumn("timestamp", F.current_timestamp())
    return parsed(lines, schema)


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r"), "timestamp").where("r is not null").select("r.*", "timestamp")
