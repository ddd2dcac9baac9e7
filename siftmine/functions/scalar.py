"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def affine_hash(x: Column, a: int, b: int, p: int, m) -> Column:
    """((a x + b) mod p) mod m, exact for x below 2^40."""
    return ((F.lit(a) * x + F.lit(b)) % F.lit(p)) % (F.lit(m) if isinstance(m, int) else m)


def bytes_mod(s: Column, p: int) -> Column:
    """The UTF-8 bytes of s, read as one big integer, modulo p: folded byte by byte, as the integer itself has no bound."""
    raw = F.hex(F.encode(s, "UTF-8"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: (acc * 256 + c) % p)


def big_affine_hash(s: Column, a: int, b: int, p: int, m: int) -> Column:
    """affine_hash of the integer that the bytes of s form."""
    return ((F.lit(a) * bytes_mod(s, p) + F.lit(b)) % p) % m


def trailing_zeros(h: Column) -> Column:
    """Zeros at the end of the binary numeral; 1 for 0."""
    return F.when(h == 0, 1).otherwise(F.log2(h.bitwiseAND(-h)).cast("int"))


def words(text: Column) -> Column:
    """Split at white space, without empty words."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def hashtags(text: Column) -> Column:
    return F.transform(F.filter(words(text), lambda w: (F.length(w) > 1) & w.startswith("#")), lambda w: F.substr(w, F.lit(2)))


def mahalanobis(x: Column, mean: Column, std: Column) -> Column:
    """Distance in standard deviations; dimensions without variance are skipped, NaN deviations give NaN."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), std, lambda d, s: F.when(s == 0, 0.0).otherwise(d / s))
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v * v))


def pearson(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from sums; 0 where the numerator is 0."""
    top = n * sxy - sx * sy
    return F.when(top == 0, 0.0).otherwise(top / (F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy)))


def dense_index(df, column: str, name: str = "index"):
    """Distinct non-null values of a column with their place in sorted order, from 0.

    The values are range-partitioned and numbered by part, so no task sorts all of them; the numbers within parts are
    written before they are used twice, as parts could be put together differently otherwise.
    """
    from siftmine.sources.scratch import settled

    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    ranged = values.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    within = settled(ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(column))))
    sizes = within.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return within.join(F.broadcast(base), "_part").select(column, (F.col("_base") + F.col("_rank") - 1).cast("long").alias(name))
