"""Clustering in rounds with bounded summaries (BFR)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmine.functions.scalar import dense_index, mahalanobis
from siftmine.sources.scratch import settled
from siftmine.sources.shipping import ship


MOST_CLUSTERS = 10_000


def summaries(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n, mean and std (population) arrays."""
    parts = points.select(cluster, F.posexplode("features").alias("d", "x")).groupBy(cluster, "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    variance = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    rows = parts.select(cluster, "n", F.struct("d", (F.col("s") / F.col("n")).alias("m"), F.sqrt(variance).alias("v")).alias("e"))
    return rows.groupBy(cluster).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("e")).alias("es")).select(cluster, "n", F.transform("es", lambda e: e["m"]).alias("mean"), F.transform("es", lambda e: e["v"]).alias("std"))


def nearest(points: DataFrame, stats: DataFrame, limit: float) -> DataFrame:
    """id, cluster, distance: the nearest cluster (ties by its number) if it is closer than the limit, else -1.
    stats, of at most MOST_CLUSTERS rows, goes to every task as one row; each point is compared with it where it lies."""
    if stats.count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    all_of = stats.agg(F.collect_list(F.struct("cluster", "mean", "std")).alias("of"))
    distances = F.transform("of", lambda s: F.struct(mahalanobis(F.col("features"), s["mean"], s["std"]).alias("distance"), s["cluster"].alias("cluster")))
    best = F.array_min(F.filter(distances, lambda d: ~F.isnan(d["distance"])))
    out = points.select("id", "features").join(F.broadcast(all_of)).select("id", best.alias("b"))
    hit = F.col("b.distance") < limit
    return out.select("id", F.when(hit, F.col("b.cluster")).otherwise(-1).cast("int").alias("cluster"), F.col("b.distance").alias("distance"))


@dataclass
class Summary:
    """Number, sum and sum of squares; `compat` adds the squares of a later point twice."""

    n: float
    s: np.ndarray
    ss: np.ndarray

    def add(self, n: float, s: np.ndarray, ss: np.ndarray, compat: bool = False) -> None:
        self.n, self.s, self.ss = self.n + n, self.s + s, self.ss + ss * (2 if compat else 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        mean = self.s / self.n
        with np.errstate(invalid="ignore"):
            std = np.sqrt(self.ss / self.n - mean**2)
        use = std != 0
        return np.sqrt((((x - mean)[:, use] / std[use]) ** 2).sum(1))


def assign(x: np.ndarray, groups: list[list[Summary]], limit: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first group with a summary within the limit, and the nearest there; (-1, -1) without one."""
    group, which = np.full(len(x), -1), np.full(len(x), -1)
    for g, members in enumerate(groups):
        if members and len(x):
            d = np.stack([m.distances(x) for m in members], axis=1)
            d = np.where(np.isnan(d), np.inf, d)
            near = (d.min(1) < limit) & (group < 0)
            group[near], which[near] = g, d.argmin(1)[near]
    return group, which


def _kmeans(points: DataFrame, k: int) -> DataFrame:
    k = max(1, k)
    n = points.count()
    if n <= k:  # each its own
        return points.withColumn("cluster", F.row_number().over(W.orderBy("id")) - 1) if n else points.withColumn("cluster", F.lit(0))
    if k == 1:  # KMeans takes two or more
        return points.withColumn("cluster", F.lit(0))
    model = KMeans(k=k, seed=0, featuresCol="vec", predictionCol="cluster").fit(points.withColumn("vec", array_to_vector("features")))
    return model.transform(points.withColumn("vec", array_to_vector("features"))).drop("vec")


def _collected(points: DataFrame) -> dict[int, Summary]:
    rows = points.select("cluster", F.posexplode("features").alias("d", "x")).groupBy("cluster", "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")).toPandas()
    return {int(c): Summary(float(g["n"].iloc[0]), g.sort_values("d")["s"].to_numpy(), g.sort_values("d")["ss"].to_numpy()) for c, g in rows.groupby("cluster")}


def bfr(points: DataFrame, k: int, share: float = 0.2, mode: str = "batched", compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rounds (round, n_ds, n_cs_clusters, n_cs, n_rs) and clusters (id, cluster; -1 for outliers) of points(id, features).

    The first share of the rows by id is clustered coarsely; clusters of one point are set aside, the rest gives the k
    discard summaries, and what was set aside is clustered into compressed ones. Each further share is a round: a
    point goes to the nearest discard summary within 2 sqrt(dims) deviations, else the nearest compressed one, else to
    the retained set. mode='batched' compares a whole round with the summaries at its start, in parallel;
    'sequential' updates after each point, in order, on the driver, which holds the numbers of a round's points with their
    clusters; otherwise the driver holds the summaries only. A vector with null or non-finite components, or of another
    length than most, is near to nothing: it is in the retained set from its round on, in cluster -1.
    """
    if mode not in ("batched", "sequential"):
        raise ValueError(mode)
    spark = points.sparkSession
    ship(spark)
    points = points.where("id is not null and features is not null").select("id", "features")
    order = dense_index(points, "id", "place")
    points = settled(points.dropDuplicates(["id"]).join(order, "id"))
    total = points.count()
    if not total:
        return spark.createDataFrame([], "round int, n_ds long, n_cs_clusters int, n_cs long, n_rs long"), spark.createDataFrame([], "id long, cluster int")
    size = max(1, int(total * share))
    lengths = points.groupBy(F.size("features").alias("dims")).agg(F.count("*").alias("n"))
    dims = lengths.orderBy(F.desc("n"), "dims").first()["dims"]
    limit = 2 * float(np.sqrt(dims))
    finite = F.forall("features", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = (F.size("features") == dims) & finite
    odd = points.where(~usable).select("id", "place")
    points = points.where(usable)
    odd_in = {r["round"]: r["n"] for r in odd.groupBy(F.floor(F.col("place") / size).alias("round")).agg(F.count("*").alias("n")).collect()}  # a row for each round
    first = points.where(F.col("place") < size).select("id", "features")
    coarse = settled(_kmeans(first, 10 * k))
    counts = coarse.groupBy("cluster").agg(F.count("*").alias("n"))
    inner = coarse.join(counts.where("n > 1"), "cluster").select("id", "features")
    if inner.isEmpty():  # too few points for any pair
        inner = first
    inner = settled(_kmeans(inner, k).select("id", "features", "cluster"))
    outer = settled(first.join(inner, "id", "left_anti"))
    ds = [s for _, s in sorted(_collected(inner).items())]
    numbers = {c: i for i, c in enumerate(sorted(_collected(inner)))}
    aside = outer.count()
    cs: list[Summary] = []
    retained = aside
    if aside:
        apart = settled(_kmeans(outer, int(0.8 * aside)).select("id", "features", "cluster"))
        found = _collected(apart)
        cs = [s for _, s in sorted(found.items()) if s.n > 1]
        retained = sum(1 for s in found.values() if s.n <= 1)
    retained += odd_in.get(0, 0)
    told = lambda r: (r, int(sum(s.n for s in ds)), len(cs), int(sum(s.n for s in cs)), int(retained))
    rounds = [told(1)]
    number = F.create_map(*[F.lit(x) for c, i in numbers.items() for x in (c, i)])[F.col("cluster")] if numbers else F.lit(-1)
    named = [inner.select("id", number.cast("int").alias("cluster")), *[x.select("id", F.lit(-1).alias("cluster")) for x in (outer, odd)]]
    for r in range(1, -(-total // size)):
        batch = points.where((F.col("place") >= r * size) & (F.col("place") < (r + 1) * size)).select("id", "features")
        if mode == "sequential":
            rows, out = batch.orderBy("id").toLocalIterator(), []
            for row in rows:
                x = np.array([row["features"]])
                g, w = (int(v[0]) for v in assign(x, [ds, cs], limit))
                if g >= 0:
                    (ds, cs)[g][w].add(1, x[0], x[0] ** 2, compat)
                else:
                    retained += 1
                out.append((row["id"], w if g == 0 else -1))
            named.append(spark.createDataFrame(out, "id long, cluster int"))
        else:
            state = spark.sparkContext.broadcast((ds, cs))

            def place(parts: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
                for p in parts:
                    x = np.stack(p["features"].to_numpy()) if len(p) else np.zeros((0, dims))
                    g, w = assign(x, list(state.value), limit)
                    yield p.assign(g=g, cluster=w)

            placed = settled(batch.mapInPandas(place, "id long, features array<double>, g int, cluster int"))
            for g, members in ((0, ds), (1, cs)):
                for c, s in _collected(placed.where(F.col("g") == g)).items():
                    members[c].add(s.n, s.s, s.ss, compat)
            retained += placed.where("g < 0").count()
            named.append(placed.select("id", F.when(F.col("g") == 0, F.col("cluster")).otherwise(-1).alias("cluster")))
        retained += odd_in.get(r, 0)
        rounds.append(told(r + 1))
    clusters = named[0]
    for n in named[1:]:
        clusters = clusters.unionByName(n)
    return spark.createDataFrame(rounds, "round int, n_ds long, n_cs_clusters int, n_cs long, n_rs long"), clusters
