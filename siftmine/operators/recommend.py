"""Recommenders over ratings (u, i, stars); test pairs (u, i)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmine.functions.scalar import clamp
from siftmine.sources.scratch import settled

from . import similarity

COLD = 3.0  # the prediction for what nothing is known of


def one_rating(df: DataFrame) -> DataFrame:
    """Repeated (u, i) count once, with their highest stars."""
    return df.groupBy("u", "i").agg(F.max("stars").cast("double").alias("stars"))


def neighbours(train: DataFrame, one: str, by: str, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """Each id's k most similar others (ties by id): id, other, s."""
    both = similarity.most_correlated(train, one, by, "stars", k, pairs)
    # rounded for the order, so that sums in another order don't change who is a neighbour
    return both.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("s", 9)), "other"))).where(F.col("r") <= k).drop("r")


def als(train: DataFrame, test: DataFrame, rank: int = 2, iterations: int = 10, reg: float = 0.01, seed: int = 7) -> DataFrame:
    """Matrix factorisation; clamped to 1..5, unknown users or items give 3."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol="u", itemCol="i", ratingCol="stars", coldStartStrategy="nan").fit(train)
    out = model.transform(test.select("u", "i").distinct())
    return out.select("u", "i", F.when(F.isnan("prediction") | F.col("prediction").isNull(), COLD).otherwise(clamp(F.col("prediction").cast("double"), 1, 5)).alias("prediction"))


def user_cf(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Mean of the user and weighted deviations of the k nearest users, of those that rated the item; clamped to 0..5."""
    train = settled(one_rating(train))
    near = neighbours(train, "u", "i", k)
    means = train.groupBy("u").agg(F.avg("stars").alias("mean"))
    theirs = train.join(means, "u").select(F.col("u").alias("other"), "i", (F.col("stars") - F.col("mean")).alias("d"))
    pairs = test.select("u", "i").distinct()
    hits = pairs.join(near.withColumnRenamed("id", "u"), "u").join(theirs, ["other", "i"]).groupBy("u", "i").agg(F.sum(F.col("s") * F.col("d")).alias("top"), F.sum(F.abs("s")).alias("down"))
    out = pairs.join(means, "u", "left").join(hits, ["u", "i"], "left")
    guess = F.when(F.col("mean").isNull(), COLD).when(F.coalesce("down", F.lit(0.0)) == 0, F.col("mean")).otherwise(F.col("mean") + F.col("top") / F.col("down"))
    return out.select("u", "i", clamp(guess, 0, 5).alias("prediction"))


def item_cf(train: DataFrame, test: DataFrame, k: int = 2, pairs: DataFrame | None = None) -> DataFrame:
    """Weighted stars that the user gave to the item's k nearest items; the item's mean without any; clamped to 0..5.
    Only items of the given pairs (id1, id2) are neighbours, if any are given."""
    train = settled(one_rating(train))
    near = neighbours(train, "i", "u", k, pairs)
    means = train.groupBy("i").agg(F.avg("stars").alias("mean"))
    asked = test.select("u", "i").distinct()
    given = train.select("u", F.col("i").alias("other"), "stars")
    hits = asked.join(near.withColumnRenamed("id", "i"), "i").join(given, ["u", "other"]).groupBy("u", "i").agg(F.sum(F.col("s") * F.col("stars")).alias("top"), F.sum(F.abs("s")).alias("down"))
    out = asked.join(means, "i", "left").join(hits, ["u", "i"], "left")
    guess = F.when(F.col("mean").isNull(), COLD).when(F.coalesce("down", F.lit(0.0)) == 0, F.col("mean")).otherwise(F.col("top") / F.col("down"))
    return out.select("u", "i", clamp(guess, 0, 5).alias("prediction"))


def lsh_item_cf(train: DataFrame, test: DataFrame, k: int = 2, threshold: float = 0.5) -> DataFrame:
    """Item-based, with neighbours among the items whose sets of users are similar."""
    pairs = similarity.similar_pairs(train, "i", "u", threshold).select("id1", "id2")
    return item_cf(train, test, k, pairs)


def rmse(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: n, rmse over pairs (u, i) of both."""
    d: Column = F.col("stars") - F.col("prediction")
    return truth.join(predicted, ["u", "i"]).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))
