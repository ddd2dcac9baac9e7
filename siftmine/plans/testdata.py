"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_type").alias("business_id"), F.col("ts").cast("string").alias("date"))


def ratings(spark, d) -> DataFrame:
    """event_id, u, i, stars (1 to 5)."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("u"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("i"), (1 + F.floor("value") % 5).cast("double").alias("stars"))


def split(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test, (u, i) once each."""
    best = lambda x: x.groupBy("u", "i").agg(F.max("stars").alias("stars"))
    return best(r.where(F.col("event_id") % 5 != 0)), best(r.where(F.col("event_id") % 5 == 0))


def brand_ratings(spark, d) -> DataFrame:
    """event_id (for the split), u (customer), i (brand), stars."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("u"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("i"))
    best = lines.join(o, "l_orderkey").join(p, "l_partkey").groupBy("u", "i").agg(F.max("l_quantity").alias("q"))
    return best.select((F.col("u") + F.col("i")).alias("event_id"), "u", "i", (1 + F.floor("q") % 5).cast("double").alias("stars"))


def order_brands(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(p, "l_partkey").select("l_orderkey", "p_brand")


def doc_words(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))


def points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))


def city_stream(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("city"), F.to_date("ts").cast("string").alias("day"))


def tweets(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.concat(F.lit("seen #"), "event_type").alias("text"))
