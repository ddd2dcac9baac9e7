"""MinHash signatures, banding and exact Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmine.functions.scalar import affine_hash, dense_index, pearson
from siftmine.sources.scratch import settled

from . import blocks, near_sets

# Fixed values: (a, b, p) of the hash functions ((a e + b) mod p) mod m.
MINHASHES = [(29, 43, 709), (1069, 457, 163), (37, 101, 97), (171, 12, 2063), (542, 2780, 10289), (862, 123, 9817), (212, 3, 5393), (142, 7173, 6997), (982, 19, 10861), (333, 709, 191), (183, 523, 5503), (972, 102, 659), (199, 6607, 491), (241, 619, 1033), (983, 991, 587), (233, 41, 991), (1303, 59, 5843), (419, 53, 9001)]
ROWS = 2
HOT = 2000  # rows of a key that meet one another in one task


def elements(df: DataFrame, set_id: str, element: str) -> tuple[DataFrame, int]:
    """Distinct (set_id, e), e the element's place among all sorted elements, and their number."""
    pairs = df.select(F.col(set_id).alias("set_id"), F.col(element).alias("element")).where("set_id is not null and element is not null").distinct()
    index = settled(dense_index(pairs, "element", "e"))
    return pairs.join(index, "element").select("set_id", "e"), index.count()


def signatures(members: DataFrame, m: int, hashes=MINHASHES) -> DataFrame:
    """set_id, h0..hn: for each hash function the least value over the set's elements, in one pass."""
    return members.groupBy("set_id").agg(*[F.min(affine_hash(F.col("e"), a, b, p, m)).alias(f"h{k}") for k, (a, b, p) in enumerate(hashes)])


def bands(sigs: DataFrame, rows: int = ROWS, n: int = len(MINHASHES)) -> DataFrame:
    parts = [F.struct(F.lit(k // rows).alias("band"), F.array(*[F.col(f"h{k + j}") for j in range(rows)]).alias("key")) for k in range(0, n, rows)]
    return sigs.select("set_id", F.explode(F.array(*parts)).alias("b")).select("set_id", "b.band", "b.key")


def candidate_pairs(sigs: DataFrame, rows: int = ROWS, n: int = len(MINHASHES)) -> DataFrame:
    """Pairs that agree in a whole band, each from the first such band, so that no pair is shuffled."""
    keys = F.array(*[F.array(*[F.col(f"h{k + j}") for j in range(rows)]) for k in range(0, n, rows)])
    b = sigs.select("set_id", keys.alias("keys")).select("set_id", "keys", F.posexplode("keys").alias("band", "key"))
    a, c = b.alias("a"), b.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.set_id") < F.col("b.set_id"))
    first = F.array_position(F.zip_with("a.keys", "b.keys", lambda x, y: x == y), True) == F.col("a.band") + 1
    return a.join(c, same).where(first).select(F.col("a.set_id").alias("id1"), F.col("b.set_id").alias("id2"))


def dealt(rows: DataFrame, key: str, who: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of rows with one another on (key, salt): rows of a hot key are dealt out on the left and
    copied on the right, so that no task has to pair them all."""
    hot = rows.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") > HOT).select(key, F.ceil(F.col("m") / HOT).cast("int").alias("of"))
    told = rows.join(hot, key, "left").withColumn("of", F.coalesce("of", F.lit(1)))
    return told.withColumn("salt", F.pmod(F.xxhash64(who), "of").cast("int")).drop("of"), told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")


def similar_pairs(df: DataFrame, set_id: str, element: str, threshold: float = 0.5) -> DataFrame:
    """Pairs that agree in a whole band and whose similarity is at least the threshold: id1, id2, similarity.

    Bands of hashes with small moduli yield far more pairs than are similar, so pairs come from their rarest elements, which
    lose none within the threshold, and are kept if they agree in a band; see near_sets.
    """
    return near_sets.similar(*near_sets.prepared(df, set_id, element, MINHASHES), threshold, ROWS)


def rating_cells(r: DataFrame) -> tuple[DataFrame, tuple[int, int] | None]:
    """Number, sum and sum of squares of the ratings (o, b, v) of each row and place, and the size if they go by blocks:
    there must be few places, and whole stars below 64, whose products add up exactly in any order."""
    cells = settled(r.where("o is not null and b is not null").groupBy(F.col("o").alias("row"), F.col("b").alias("place")).agg(F.count("*").alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max(F.coalesce((F.abs("v") < 64) & (F.col("v") == F.floor("v")), F.lit(False)).cast("int") * -1 + 1).alias("other")))
    size = blocks.dense_enough(cells)
    if size is not None and cells.where("other = 1 or c > 1000").isEmpty():
        return cells.drop("other"), size
    return cells, None


def correlations(ratings: DataFrame, one: str, by: str, value: str, pairs: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Pearson correlation of pairs of `one` over the `by` that both have: id1 < id2, similarity, rounded to `digits`, if any.
    Only the given pairs, if any.

    Where few `by` are shared by many `one` the sums are products of blocks, else of a join. Those of equal ones are
    counted and rounded once.
    """
    r = ratings.select(F.col(one).alias("o"), F.col(by).alias("b"), F.col(value).cast("double").alias("v"))
    if pairs is None:
        cells, size = rating_cells(r)
        if size is not None:
            kind = cells.schema["row"].dataType.simpleString()
            return blocks.pairs_or_classes(cells, *size, blocks.rounded(blocks.pearson, digits), blocks.pearson_of_classes(digits), f"id1 {kind}, id2 {kind}, similarity double")
        left, right = dealt(r, "b", "o")
        a, c = left.alias("a"), right.alias("c")
        both = a.join(c, (F.col("a.b") == F.col("c.b")) & (F.col("a.salt") == F.col("c.salt")) & (F.col("a.o") < F.col("c.o"))).select(F.col("a.o").alias("id1"), F.col("c.o").alias("id2"), F.col("a.v").alias("x"), F.col("c.v").alias("y"))
    else:
        first = pairs.select("id1", "id2").join(r.select(F.col("o").alias("id1"), "b", F.col("v").alias("x")), "id1")
        both = first.join(r.select(F.col("o").alias("id2"), "b", F.col("v").alias("y")), ["id2", "b"])
    s = both.groupBy("id1", "id2").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxy", F.col("x") * F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")))])
    found = pearson(*[F.col(k) for k in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    return s.select("id1", "id2", (found if digits is None else F.round(found, digits)).alias("similarity"))


def most_correlated(ratings: DataFrame, one: str, by: str, value: str, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """A table id, other, s that holds the k most similar others of each `one`, by round(s, 9) and then `other`, and maybe
    more. By blocks, each pair of blocks yields its best only."""
    r = ratings.select(F.col(one).alias("o"), F.col(by).alias("b"), F.col(value).cast("double").alias("v"))
    if pairs is None:
        cells, size = rating_cells(r)
        if size is not None:
            kind = cells.schema["row"].dataType.simpleString()
            return blocks.pairs(cells, *size, blocks.best_correlated(k), f"id {kind}, other {kind}, s double")
    sims = correlations(ratings, one, by, value, pairs)
    return sims.select(F.explode(F.array(F.struct(F.col("id1").alias("id"), F.col("id2").alias("other"), F.col("similarity").alias("s")), F.struct(F.col("id2").alias("id"), F.col("id1").alias("other"), F.col("similarity").alias("s")))).alias("p")).select("p.*")
