"""Counts, top lists, grouped means and partition layout."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_counts(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k keys with most rows; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def review_stats(reviews: DataFrame, year: str = "2018", k: int = 10) -> DataFrame:
    """One row: rows, rows whose date holds the year, distinct users and businesses, and the top lists as JSON pairs."""
    counts = reviews.agg(F.count("*").alias("n_review"), F.count(F.when(F.col("date").contains(year), 1)).alias("n_review_year"), F.countDistinct("user_id").alias("n_user"), F.countDistinct("business_id").alias("n_business"))

    def listed(key: str, name: str) -> DataFrame:
        pairs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k")))), lambda p: F.concat(F.lit('["'), p["k"].cast("string"), F.lit('", '), (-p["m"]).cast("string"), F.lit("]")))
        return top_counts(reviews, key, k).agg(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")).alias(name))

    return counts.crossJoin(listed("user_id", "top10_user")).crossJoin(listed("business_id", "top10_business"))  # one row each


def grouped_mean(left: DataFrame, right: DataFrame, on: str, group: str, value: str, name: str = "mean") -> DataFrame:
    """Mean of left.value by right.group after an inner join."""
    return left.select(on, value).join(right.select(on, group), on).groupBy(group).agg(F.avg(value).alias(name))


def top_means(means: DataFrame, group: str, value: str, k: int = 10) -> DataFrame:
    return means.orderBy(F.desc(value), group).limit(k)


def both_ways(means: DataFrame, group: str, value: str, k: int = 10) -> dict[str, float]:
    """Seconds for the head of a whole sorted result, and for a limit in the plan."""
    t0 = time.perf_counter()
    means.orderBy(F.desc(value), group).collect()[:k]
    t1 = time.perf_counter()
    top_means(means, group, value, k).collect()
    return {"m1": t1 - t0, "m2": time.perf_counter() - t1}


def partition_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of each partition, empty ones too, after coalescing to `partitions` (which never adds any)."""
    df = df.coalesce(partitions) if partitions else df
    n = df.rdd.getNumPartitions()
    seen = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return spine.join(seen, "partition", "left").select("partition", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def layout_report(df: DataFrame, partitions: int) -> DataFrame:
    """The layout as read and as customised, each with the time of counting it."""
    rows = []
    for name, n in (("default", None), ("customized", partitions)):
        t = time.perf_counter()
        items = [r["n_items"] for r in partition_layout(df, n).orderBy("partition").collect()]
        rows.append((name, len(items), items, time.perf_counter() - t))
    return df.sparkSession.createDataFrame(rows, "layout string, n_partition int, n_items array<long>, exe_time double")
