"""Frequent itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmine.functions.scalar import dense_index
from siftmine.sources.scratch import settled

from . import blocks

LONG = 1000  # items of a basket that isn't compared with others as a whole
CHUNK = 8  # equal items whose subsets are one array
TASK_SETS = 1_000_000  # sets that one task writes out, about


def baskets(df: DataFrame, basket: str, item: str, larger_than: int | None = None) -> DataFrame:
    """Distinct (basket, item); only baskets of strictly more items than `larger_than`. Swap the columns for the other orientation."""
    pairs = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    if larger_than is None:
        return pairs
    big = pairs.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > larger_than).select("basket")
    return pairs.join(big, "basket", "left_semi")


def sorted_baskets(pairs: DataFrame) -> DataFrame:
    """basket and its items in order, as an array."""
    return pairs.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))


def weighed(pairs: DataFrame) -> DataFrame:
    """Table (basket, item, w): of equal baskets one is there, w is how many they are. Long baskets stay by themselves."""
    sizes = pairs.groupBy("basket").agg(F.count("*").alias("n"))
    apart = sizes.where(F.col("n") > LONG).select("basket")
    equal = sorted_baskets(pairs.join(apart, "basket", "left_anti")).groupBy("items").agg(F.min("basket").alias("basket"), F.count("*").alias("w"))
    short = equal.select("basket", F.explode("items").alias("item"), "w")
    return settled(short.unionByName(pairs.join(apart, "basket", "left_semi").select("basket", "item", F.lit(1).cast("long").alias("w"))))


def frequent(pairs: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """All itemsets in at least `support` baskets, by size: (items sorted, n); those of up to `most` items if given.

    Where many items share few baskets, pairs are counted by products of blocks and larger sets by the baskets they are
    in; else by the sets of each basket, equal baskets taken together.
    """
    pairs = settled(pairs)
    cells = pairs.select(F.col("item").alias("row"), F.col("basket").alias("place"))
    size = blocks.dense_enough(cells) if support > 0 and (most is None or most > 1) else None
    return by_basket(weighed(pairs), support, most) if size is None else by_item(pairs, support, most, size)


def by_item(pairs: DataFrame, support: int, most: int | None, size: tuple[int, int]) -> DataFrame:
    """Every set carries the baskets it is in, 32 to a number; two that differ in their last items make one of the next size.

    Items of the same baskets are one item until the end: a set of such stands for all sets that take one at least of each.
    """
    index = settled(dense_index(pairs, "basket", "at"))
    kind = pairs.schema["item"].dataType.simpleString()
    words = -(-size[1] // 32)
    bits = pairs.join(F.broadcast(index), "basket").groupBy("item", F.floor(F.col("at") / 32).alias("word")).agg(F.sum(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("x"))
    held = bits.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("word", "x"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.coalesce(F.element_at("m", k.cast("long")), F.lit(0).cast("long")))
    number = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    singles = settled(held.select("item", whole.alias("bits")).withColumn("n", number(F.col("bits"))).where(F.col("n") >= support))
    equal = settled(singles.groupBy("bits").agg(F.sort_array(F.collect_list("item")).alias("items"), F.first("n").alias("n")).select(F.col("items")[0].alias("item"), "bits", "n", "items"))
    found = equal.agg(F.count("*").alias("of"), F.max(F.size("items")).alias("longest")).first()
    longest, size = found["longest"] or 1, (max(1, found["of"]), size[1])
    spread = lambda level, k: level if longest == 1 else spread_out(level, equal.select("item", "items"), k, most, longest)
    singles = equal.select("item", "bits", "n")
    out = spread(singles.select(F.array("item").alias("items"), "n"), 1)
    cells = pairs.join(singles.select("item"), "item", "left_semi").select(F.col("item").alias("row"), F.col("basket").alias("place"), F.lit(1).alias("one"))
    counted = settled(blocks.pairs(cells, *size, blocks.overlaps(support), f"a {kind}, b {kind}, n long"))
    out = out.unionByName(spread(counted.select(F.array("a", "b").alias("items"), "n"), 2))
    if most == 2:
        return out
    both = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseAND(q))
    one = lambda name: singles.select(F.col("item").alias(name), F.col("bits").alias(f"{name}_bits"))
    level = counted.join(one("a"), "a").join(one("b"), "b").select(F.array("a").alias("head"), F.col("b").alias("last"), both("a_bits", "b_bits").alias("bits"))
    done = 2
    while most is None or done < most:
        done += 1
        more = level.select("head", F.col("last").alias("next"), F.col("bits").alias("other"))
        grown = level.join(more, "head").where(F.col("next") > F.col("last")).select(F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last"), both("bits", "other").alias("bits"))
        level = settled(grown.withColumn("n", number(F.col("bits"))).where(F.col("n") >= support))
        if level.isEmpty():
            break
        out = out.unionByName(spread(level.select(F.concat("head", F.array("last")).alias("items"), "n"), done))
    return out


def spread_out(sets: DataFrame, equal: DataFrame, k: int, most: int | None, longest: int) -> DataFrame:
    """(items, n) of the sets that take one item at least of each of the k classes of `items`, named by their first; `equal`
    has (item, items) of each class, of up to `longest`. Rows come one by one, so that their number is bounded by the store only."""
    rows = sets.withColumnRenamed("items", "of")
    for c in range(k):
        rows = rows.join(equal.select(F.col("item").alias(f"c{c}"), F.col("items").alias(f"m{c}")), F.col("of")[c] == F.col(f"c{c}")).drop(f"c{c}")
    number = F.lit(1.0)
    for c in range(k):
        number = number * (F.pow(F.lit(2.0), F.size(f"m{c}")) - 1)
    total = rows.agg(F.sum(number)).first()[0] or 0
    rows = rows.drop("of").repartition(int(min(10_000, max(1, total // TASK_SETS))))
    chunks = range(-(-longest // CHUNK))
    bits = lambda part, least: F.transform(F.sequence(F.lit(least), F.expr(f"shiftleft(1, size({part})) - 1")), lambda mask: F.filter(F.col(part), lambda _, i: F.getbit(mask, i) == 1))
    parts = {f"p{c}_{j}": F.slice(f"m{c}", j * CHUNK + 1, CHUNK) for c in range(k) for j in chunks}
    rows = rows.select("n", *[e.alias(name) for name, e in parts.items()])
    rows = rows.select("n", *[bits(name, int(len(chunks) == 1)).alias(name) for name in parts])
    for c in range(k):
        for j in chunks:
            rows = rows.withColumn(f"p{c}_{j}", F.explode(f"p{c}_{j}"))
        rows = rows.withColumn(f"m{c}", F.concat(*[f"p{c}_{j}" for j in chunks])).drop(*[f"p{c}_{j}" for j in chunks])
        if len(chunks) > 1:
            rows = rows.where(F.size(f"m{c}") > 0)
    whole = rows.select(F.sort_array(F.concat(*[f"m{c}" for c in range(k)])).alias("items"), "n")
    return whole if most is None else whole.where(F.size("items") <= most)


def by_basket(pairs: DataFrame, support: int, most: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """Frequent itemsets of weighed (basket, item, w); only those `among` the given (items), which hold each one's subsets.

    Level by level: two frequent sets of a basket that differ in their last items alone make one of the next size, so
    every basket yields each of its candidate sets once and counts are partial sums. Levels from the third on start
    from a table, which cuts their lineage. Stops at the first empty level.
    """
    wanted = None if among is None else among.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("head"), F.element_at("items", -1).alias("last"))
    singles = pairs.groupBy("item").agg(F.sum("w").alias("n")).where(F.col("n") >= support)
    first = singles.select("item") if among is None else among.where(F.size("items") == 1).select(F.col("items")[0].alias("item"))
    kept = settled(pairs.join(first, "item", "left_semi"))
    out = singles.select(F.array("item").alias("items"), "n")
    level = kept.select("basket", "w", F.slice(F.array("item"), 1, 0).alias("head"), F.col("item").alias("last"))
    size = 1
    while most is None or size < most:
        size += 1
        more = level.select("basket", "head", F.col("last").alias("next"))
        grown = level.join(more, ["basket", "head"]).where(F.col("next") > F.col("last")).select("basket", "w", F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last"))
        if wanted is not None:
            grown = settled(grown.join(wanted, ["head", "last"], "left_semi"))
        counts = settled(grown.groupBy("head", "last").agg(F.sum("w").alias("n")).where((F.col("n") >= support) if among is None else F.lit(True)))
        if counts.isEmpty():
            break
        out = out.unionByName(counts.where(F.col("n") >= support).select(F.concat("head", F.array("last")).alias("items"), "n"))
        if size != most:
            level = grown if wanted is not None else settled(grown.join(counts.select("head", "last"), ["head", "last"], "left_semi"))
    return out


def candidates(pairs: DataFrame, support: int, parts: int) -> DataFrame:
    """Itemsets that reach support / parts within one of `parts` shares of the baskets: (items, parts that have it).

    Every frequent itemset is among them. Which others are depends on how baskets are dealt: numbers by their
    remainder, others by their hash.
    """
    whole = dict(pairs.dtypes)["basket"] in ("tinyint", "smallint", "int", "bigint")
    share = -(-support // parts)
    out = None
    dealt = pairs.withColumn("part", F.pmod(F.col("basket") if whole else F.xxhash64("basket"), F.lit(parts)))
    for k in range(parts):
        one = frequent(dealt.where(F.col("part") == k).drop("part"), share).select("items", F.lit(k).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("items").agg(F.count("*").cast("long").alias("parts"))


def son(pairs: DataFrame, support: int, parts: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two-phase: (candidates, frequent). The second phase counts every candidate over all baskets."""
    pairs = settled(pairs)
    found = settled(candidates(pairs, support, parts))
    return found, by_basket(weighed(pairs), support, among=found)


def fp_growth(pairs: DataFrame, support: int) -> DataFrame:
    """The same result by pyspark.ml's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    sets = pairs.groupBy("basket").agg(F.collect_list("item").alias("items"))
    n = sets.count()
    if not n:
        return pairs.select(F.array("item").alias("items"), F.lit(0).cast("long").alias("n")).limit(0)
    # the share is half a basket low, so that rounding loses none at the boundary
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(sets)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("n"))
