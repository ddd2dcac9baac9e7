"""Stream summaries in closed form over a batch: Bloom filter, Flajolet-Martin, reservoir and trending tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmine.functions.scalar import bytes_mod, dense_index, hashtags, trailing_zeros

BITS = 200
# Fixed values: (a, b, p) of the filter's hash functions.
BLOOM = [(29, 43, 709), (1069, 457, 163), (37, 101, 97), (171, 12, 2063)]
# Fixed values: (a, b, p) of the estimator's hash functions, nine groups of five; the fourth and fifth are the same.
FM = [
    [(29, 43, 709), (1069, 457, 163), (37, 101, 97), (73, 79, 83), (557, 5, 317)],
    [(171, 12, 2063), (1303, 59, 5843), (419, 53, 9001), (293, 101, 743), (1201, 563, 331)],
    [(542, 2780, 10289), (862, 123, 9817), (212, 3, 5393), (1747, 967, 19), (12, 982, 2063)],
    [(142, 7173, 6997), (199, 6607, 491), (241, 619, 1033), (2963, 222, 5323), (192, 67, 7039)],
    [(142, 7173, 6997), (199, 6607, 491), (241, 619, 1033), (2963, 222, 5323), (192, 67, 7039)],
    [(342, 713, 9323), (1991, 607, 491), (171, 491, 163), (2963, 222, 5323), (192, 67, 7039)],
    [(1212, 773, 8753), (19, 671, 491), (241, 862, 97), (296, 212, 19), (1921, 671, 97)],
    [(1422, 17, 6069), (129, 6607, 709), (241, 222, 83), (23, 322, 331), (12, 6727, 9001)],
    [(982, 19, 10861), (333, 709, 191), (183, 523, 5503), (888, 120, 8929), (872, 111, 9973)],
]


def hash_bits(values: DataFrame, value: str, hashes) -> DataFrame:
    """value with an array of hashes modulo BITS; the bytes are folded once for each distinct modulus."""
    moduli = sorted({p for _, _, p in hashes})
    folded = values.select(value, *[bytes_mod(F.col(value), p).alias(f"_{p}") for p in moduli])
    return folded.select(value, F.array(*[((F.lit(a) * F.col(f"_{p}") + F.lit(b)) % p) % BITS for a, b, p in hashes]).alias("bits"))


def bloom_verdicts(stream: DataFrame, seq: str, value: str, hashes=BLOOM) -> DataFrame:
    """Each distinct value at its first arrival: value, first, false_positive.

    A value is a false positive if each of its bits belongs to a value that came before.
    """
    firsts = stream.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(seq).alias("first"))
    bits = hash_bits(firsts.select(value), value, hashes)
    each = firsts.join(bits, value).select(value, "first", F.explode(F.array_distinct("bits")).alias("bit"))
    owner = each.groupBy("bit").agg(F.min("first").alias("owner"))  # a row for each bit
    return each.join(F.broadcast(owner), "bit").groupBy(value, "first").agg(F.min(F.col("owner") < F.col("first")).alias("false_positive"))


def bloom_fpr(stream: DataFrame, seq: str, value: str, batch: str, hashes=BLOOM) -> DataFrame:
    """Cumulative false-positive rate after each batch, empty ones too where they have rows: batch, fp, tn, fpr."""
    verdicts = bloom_verdicts(stream, seq, value, hashes)
    spots = stream.select(seq, F.col(batch).alias("batch")).distinct()
    per = verdicts.join(spots, verdicts["first"] == spots[seq]).groupBy("batch").agg(F.count(F.when(F.col("false_positive"), 1)).alias("fp"), F.count(F.when(~F.col("false_positive"), 1)).alias("tn"))
    every = stream.select(F.col(batch).alias("batch")).distinct().join(per, "batch", "left")
    run = W.orderBy("batch").rowsBetween(W.unboundedPreceding, 0)  # a row for each batch
    cumulated = every.select("batch", F.sum(F.coalesce("fp", F.lit(0))).over(run).alias("fp"), F.sum(F.coalesce("tn", F.lit(0))).over(run).alias("tn"))
    return cumulated.select("batch", "fp", "tn", F.when(F.col("fp") + F.col("tn") == 0, 0.0).otherwise(F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))


def fm_zeros(values: DataFrame, value: str, groups=FM) -> DataFrame:
    """value with the trailing zeros of each of its hashes."""
    bits = hash_bits(values, value, [h for g in groups for h in g])
    return bits.select(value, F.transform("bits", trailing_zeros).alias("zeros"))


def fm_columns(groups=FM) -> list:
    """The maximum of each hash as aggregates over `zeros`."""
    return [F.max(F.col("zeros")[i]).alias(f"z{i}") for i in range(sum(len(g) for g in groups))]


def fm_combine(groups=FM, place: int = 5):
    """Mean of 2^max in each group, then the value at a place of the sorted means; 0.5 without a row."""
    means, i = [], 0
    for g in groups:
        means.append(sum((F.pow(F.lit(2.0), F.coalesce(F.col(f"z{i + j}"), F.lit(-1))) for j in range(1, len(g))), F.pow(F.lit(2.0), F.coalesce(F.col(f"z{i}"), F.lit(-1)))) / len(g))
        i += len(g)
    return F.sort_array(F.array(*means))[place]


def fm_estimate(stream: DataFrame, ts: str, value: str, window: str, slide: str, groups=FM, place: int = 5) -> DataFrame:
    """Exact and estimated distinct values of each sliding window: start, truth, estimate."""
    zeros = fm_zeros(stream.where(F.col(value).isNotNull()).select(value).distinct(), value, groups)
    spread = stream.select(F.window(F.col(ts), window, slide)["start"].alias("start"), value).distinct()
    out = spread.join(zeros, value).groupBy("start").agg(F.count("*").alias("truth"), *fm_columns(groups))
    return out.select("start", "truth", fm_combine(groups, place).alias("estimate"))


def draw(n, seed: int):
    """A number from 1 to n for row n, the same in any engine; n is reduced first, so that products stay below 2^63."""
    return (((n % 2147483648) * 1103515245 + seed * 12345) % 2147483648) % n + 1


def reservoir(stream: DataFrame, order: str, seed: int = 42, size: int = 100) -> DataFrame:
    """(place, n) of the sample after all rows, n the row's number in order from 1.

    Row n > size draws r from 1 to n and is taken if r < size: the sample's element r (from 0) goes and the row is
    appended, so element 0 never goes. Only rows that are taken change the sample, about size * ln(N / size).
    """
    numbered = dense_index(stream, order, "n").select((F.col("n") + 1).alias("n"))
    start = numbered.where(F.col("n") <= size).agg(F.sort_array(F.collect_list("n")).alias("s"))
    taken = numbered.where(F.col("n") > size).withColumn("r", draw(F.col("n"), seed)).where(F.col("r") < size)
    steps = taken.agg(F.sort_array(F.collect_list(F.struct("n", "r"))).alias("t"))
    fold = F.aggregate("t", F.col("s"), lambda acc, x: F.concat(F.slice(acc, F.lit(1), x["r"].cast("int")), F.slice(acc, x["r"].cast("int") + 2, F.lit(size)), F.array(x["n"])))
    return start.crossJoin(steps).select(F.posexplode(fold).alias("place", "n"))  # one row each


def entered(stream: DataFrame, order: str, seed: int = 42, size: int = 100) -> DataFrame:
    """Rows that were in the sample at some time, with their number n."""
    index = dense_index(stream, order, "n").withColumn("n", F.col("n") + 1)
    return stream.join(index, order).where((F.col("n") <= size) | (draw(F.col("n"), seed) < size))


def trending(stream: DataFrame, order: str, text: str, seed: int = 42, size: int = 100, levels: int = 3, drop_zero: bool = False) -> DataFrame:
    """(tag, n) of the tags in the sample with the three highest counts; tags that left it count 0 and may fill a level."""
    once = entered(stream, order, seed, size)
    now = reservoir(stream, order, seed, size).select("n", F.lit(1).alias("inside"))
    tags = once.join(now, "n", "left").select(F.explode(hashtags(F.col(text))).alias("tag"), F.coalesce("inside", F.lit(0)).alias("inside"))
    counts = tags.groupBy("tag").agg(F.sum("inside").alias("n"))
    if drop_zero:
        counts = counts.where("n > 0")
    # at most the tags of the rows that ever entered
    return counts.withColumn("level", F.dense_rank().over(W.orderBy(F.desc("n")))).where(F.col("level") <= levels).select("tag", "n")


def retracted_counts(added: DataFrame, removed: DataFrame, tag: str = "tag") -> DataFrame:
    """Counts of what was added less what was removed: (tag, n); 0 where both are as many."""
    plus, minus = added.select(tag, F.lit(1).alias("d")), removed.select(tag, F.lit(-1).alias("d"))
    return plus.unionByName(minus).groupBy(tag).agg(F.sum("d").alias("n"))
