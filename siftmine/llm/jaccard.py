"""N-gram Jaccard join with count-vector R-trees.

A document is the set of hashes of its word shingles; documents with equal sets are one point. The hashes are dealt
into groups, and the counts of the groups are the point's coordinates: the overlap of two sets is at most the sum of
the smaller coordinate in each group, and for a box of points at most the sum with the box's upper corner. R-trees
over the points of a district yield all pairs that the bound can't exclude, and what they yield is compared in full.

Count vectors alone can't part long sets at a threshold of 0.8, where the radius is wider than the spread of
unrelated points, so an exact rule deals the points into districts, and every district is joined through trees. Of
each set the first n - ceil(t n) + 1 hashes count, in an order that is the same everywhere and puts widely shared
hashes last: linked sets share one of those. Each run of neighbouring sizes that shares such a hash has a leader, its
smallest point, and all runs of one leader are a district. For widely shared hashes the leader by size is known from
the first pass over the texts, so that no task has to gather all points of such a hash.

Trees are joined twice. In chunks of bounded size, the strongest bounds first, pairs are kept that join what the
chunk's pairs so far don't: a forest, with fewer pairs than points, that makes one component of a large class of near
copies. Then every district that still holds several components is joined in full, but for pairs within a component.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, discard, free, kept, scratch, ship

# odd multipliers, one for each place in a shingle; any would do
MULTIPLIERS = [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % i) | 1) for i in range(64)]
COARSE = 64  # coordinates of the shortest count vectors
TREE = 1024  # and at most of those in a tree
FINEST = 1 << 16  # twice as many as a set has hashes, up to this, for the last bound
LEAF = 16
FOREST = 192  # points of a district that are joined at once, at first
CHUNK = 384  # and those of each side later
FEW = 1_000_000  # rows of two numbers that may be sent to every task
SALT = 256  # partners of a set for each copy of it
NONE = np.iinfo(np.int64).max


class WordHashes(dict):
    """Word -> 64-bit hash. Emptied beyond `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """Sorted distinct hashes of the k-word shingles; of all words together if there are fewer."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
        h = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(h):
            return h
        if len(h) < k:
            raw = np.uint64(len(h)).tobytes() + h.tobytes()
            return np.array([xxhash.xxh3_64_intdigest(raw)], np.uint64)
        n = len(h) - k + 1
        out = h[:n] * MULTIPLIERS[0]
        for i in range(1, k):
            out += h[i : n + i] * MULTIPLIERS[i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def word_hashes() -> WordHashes:
    return kept("word hashes", WordHashes)


def identity(s: np.ndarray, narrow: int = 64) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed numbers, of which the first may be narrower."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(int(np.uint64(x).astype(np.int64)) for x in (d & ((1 << narrow) - 1), d >> 64))


def size_class(n, t: int):
    """Linked sizes differ by one class at most."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / t * 1.01 if t < 100 else 1.01)).astype(np.int64)


def count_vector(s: np.ndarray, groups: int) -> bytes:
    """The counts of a power of two of groups, packed: the width of a count, then the counts."""
    v = np.bincount((s >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return zlib.compress(b"\1" + v.astype("u1").tobytes() if v.max(initial=0) < 256 else b"\4" + v.astype("<u4").tobytes(), 1)


def fine_groups(n: int) -> int:
    return min(FINEST, max(COARSE, 1 << (2 * max(1, n) - 1).bit_length()))


def vector(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, "u1" if raw[0] == 1 else "<u4", offset=1)


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    """The coarser count vector; groups are residues, so those of the finer one nest."""
    return v.reshape(-1, groups).sum(0, dtype=np.int32) if len(v) > groups else v


def needed(a, b, t: int):
    """Least overlap of linked sets of these sizes: 100 i >= t (a + b - i)."""
    return -(-t * (a + b) // (100 + t))


class RTree:
    """Count vectors packed by size and then by their coordinates; boxes keep the upper corner and the span of sizes."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((vectors[:, 1], vectors[:, 0], (vectors.astype(np.float32) @ np.arange(1, vectors.shape[1] + 1, dtype=np.float32)) // 64, sizes))
        self.order, self.sizes, self.vectors = order, sizes[order], vectors[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corners, least and largest size
        cuts = np.arange(0, len(order), LEAF)
        level = (np.maximum.reduceat(self.vectors, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts))
        self.levels.append(level)
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), LEAF)
            level = (np.maximum.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts))
            self.levels.append(level)

    def within(self, size: int, vector: np.ndarray, t: int) -> np.ndarray:
        """Points that the bound can't exclude for a point of this size and vector (places before packing)."""
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = (x[nodes] for x in self.levels[depth])
            ok = (100 * high >= t * size) & (100 * size >= t * low) & (np.minimum(upper, vector).sum(1, dtype=np.int64) >= needed(size, np.maximum(low, -(-t * size // 100)), t))
            nodes = (nodes[ok][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < (len(self.levels[depth - 1][0]) if depth else len(self.order))]
        ok = (100 * np.minimum(self.sizes[nodes], size) >= t * np.maximum(self.sizes[nodes], size)) & (np.minimum(self.vectors[nodes], vector).sum(1, dtype=np.int64) >= needed(size, self.sizes[nodes], t))
        return self.order[nodes[ok]]


class District:
    """Points of a district, or two chunks of it, with trees over some of them."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray], t: int):
        self.sizes, self.vectors, self.t = sizes, vectors, t
        self.groups = min(TREE, *(len(v) for v in vectors))
        flat = np.stack([fold(v, self.groups) for v in vectors])
        self.flat = flat.astype("u1") if flat.max() < 256 else flat

    def tree(self, some: np.ndarray) -> RTree:
        return RTree(self.sizes[some], self.flat[some])

    def near(self, tree: RTree, some: np.ndarray, i: int) -> np.ndarray:
        """Points of the tree over `some` that its bound can't exclude for point i."""
        return some[tree.within(int(self.sizes[i]), self.flat[i], self.t)]

    def allowed(self, i: int, j: int) -> bool:
        """Whether the bound over the finest common groups allows a link."""
        return len(self.vectors[i]) == len(self.vectors[j]) == self.groups or bounded(int(self.sizes[i]), self.vectors[i], int(self.sizes[j]), self.vectors[j], self.t)


def forest(d: District) -> list[tuple[int, int]]:
    """Pairs that the trees yield and that join what stronger pairs don't: at most one fewer than points."""
    everyone = np.arange(len(d.sizes))
    tree = d.tree(everyone)
    left, right, strength = [], [], []
    for i in everyone:
        near = d.near(tree, everyone, i)
        near = near[near > i]
        if len(near):
            most = np.minimum(d.flat[near], d.flat[i]).sum(1, dtype=np.int64)
            left.append(np.full(len(near), i))
            right.append(near)
            strength.append(most / (d.sizes[near] + d.sizes[i] - most))
    if not left:
        return []
    left, right, strength = (np.concatenate(x) for x in (left, right, strength))
    root, out = list(everyone), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in np.argsort(-strength, kind="stable"):
        i, j = int(left[k]), int(right[k])
        a, b = find(i), find(j)
        if a != b and d.allowed(i, j):
            root[b] = a
            out.append((i, j))
            if len(out) == len(root) - 1:
                break
    return out


def across(d: District, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """All pairs of a point of left and one of right, of different components, that the bounds can't exclude."""
    tree, out = d.tree(right), []
    for i in left:
        near = d.near(tree, right, i)
        out += [(int(i), int(j)) for j in near[comp[near] != comp[i]] if d.allowed(i, j)]
    return out


def bounded(n: int, a: np.ndarray, m: int, b: np.ndarray, t: int) -> bool:
    """Whether the bound on the overlap allows a link."""
    g = min(len(a), len(b))
    return 100 * min(n, m) >= t * max(n, m) and int(np.minimum(fold(a, g), fold(b, g)).sum(dtype=np.int64)) >= needed(n, m, t)


def _points(batches: Iterator[pa.RecordBatch], k: int, t: int, narrow: int, chunk: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A row for each document: id, place, n, name (h1, h2), count vector. Rows without a count vector tell of widely
    shared hashes: hash (h1), size class (place), in how many of some sets of that class (n), and the least of them (h2)."""
    words, seen, held, size = word_hashes(), set(), [], 0
    names = ["doc_id", "place", "n", "h1", "h2", "w"]

    def shared() -> pa.RecordBatch:
        sets = [x[0] for x in held]
        sizes = np.array([len(x) for x in sets])
        h = np.concatenate(sets)
        order = np.argsort(h)
        h = h[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        often = np.repeat(np.diff(np.append(new, len(h))) >= 3, np.diff(np.append(new, len(h))))
        h, of = h[often].view(np.int64), np.repeat(np.arange(len(sets)), sizes)[order[often]]
        name, c = np.array([x[1] for x in held], np.int64)[of], size_class(sizes, t)[of]
        order = np.lexsort((name, c, h))
        h, c, name = h[order], c[order], name[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(h)))
        return pa.RecordBatch.from_arrays([pa.nulls(len(new), pa.int64()), pa.array(c[new]), pa.array(counts, pa.int64()), pa.array(h[new]), pa.array(name[new]), pa.nulls(len(new), pa.binary())], names=names)

    for b in batches:
        rows: list[list] = [[], [], [], []]
        for text in b.column(2).to_pylist():
            s = words.shingles(text, k)
            name = identity(s, narrow)
            for col, x in zip(rows, (len(s), *name, count_vector(s, fine_groups(len(s))))):
                col.append(x)
            if len(s) and name not in seen:
                seen.add(name)
                held.append((s, name[0]))
                size += len(s)
                if size >= chunk:
                    yield shared()
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.binary())], names=names)
    if held:
        yield shared()


@dataclass
class Common:
    """What all tasks know of widely shared hashes, and which halves of names are not names."""

    hot: np.ndarray  # sorted
    count: np.ndarray
    codes: np.ndarray  # place in hot * 256 + size class, sorted
    least: np.ndarray  # the least point of that class
    clash: frozenset

    def leaders(self, at: np.ndarray, c: int) -> np.ndarray:
        """Leaders of sets of class c that have the hashes at those places: of classes (c - 1, c) and (c, c + 1)."""
        of = []
        for k in (c - 1, c, c + 1):
            x = at * 256 + k
            i = np.minimum(np.searchsorted(self.codes, x), len(self.codes) - 1)
            of.append(np.where(self.codes[i] == x, self.least[i], NONE))
        both = np.stack([np.minimum(of[0], of[1]), np.minimum(of[1], of[2])])
        return np.unique(np.where(both == NONE, self.hot[at].view(np.int64), both))

    def name(self, s: np.ndarray, narrow: int) -> int:
        h1, h2 = identity(s, narrow)
        return h2 if h1 in self.clash else h1


def _keys(batches: Iterator[pa.RecordBatch], k: int, t: int, narrow: int, shared) -> Iterator[pa.RecordBatch]:
    """(key, salt, name, n): the hashes of each set that a linked set must share one of, with salt 0; for widely
    shared ones their leaders, with a salt of the set's own."""
    words, seen = word_hashes(), set()
    known: Common = shared.value
    for b in batches:
        keys, salts, names, sizes, counts = [], [], [], [], []
        for text in b.column(0).to_pylist():
            s = words.shingles(text, k)
            name = known.name(s, narrow)
            if not len(s) or name in seen:
                continue
            seen.add(name)
            p = len(s) - -(-t * len(s) // 100) + 1
            lead = np.zeros(0, np.int64)
            first = s[:p]
            if len(known.hot):
                at = np.minimum(np.searchsorted(known.hot, s), len(known.hot) - 1)
                hit = known.hot[at] == s
                first = np.argsort(np.where(hit, known.count[at], 0), kind="stable")[:p]
                lead = known.leaders(at[first[hit[first]]], int(size_class(len(s), t))) if hit[first].any() else lead
                first = s[first[~hit[first]]]
            keys += [first.view(np.int64), lead]
            salts += [np.zeros(len(first), np.int64), np.full(len(lead), name | 1)]
            names.append(name)
            sizes.append(len(first) + len(lead))
            counts.append(len(s))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(salts)), *[pa.array(np.repeat(np.array(c, np.int64), sizes)) for c in (names, counts)]], names=["key", "salt", "name", "n"])


def _sets(batches: Iterator[pa.RecordBatch], k: int, narrow: int, shared) -> Iterator[pa.RecordBatch]:
    words, known = word_hashes(), shared.value
    for b in batches:
        sets = [words.shingles(t, k) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([known.name(s, narrow) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "s"])


def _compared(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column(0), b.column(1)
        linked = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            i = len(x) + len(y) - len(np.union1d(x, y))
            linked.append(100 * i >= t * (len(x) + len(y) - i))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each group, of rows sorted by their first columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _pair_batches(pairs: Iterator[tuple[int, int]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    out: set[tuple[int, int]] = set()

    def batch() -> pa.RecordBatch:
        rows = sorted(out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in rows], pa.int64()) for i in range(2)], names=["a", "b"])

    for a, b in pairs:
        out.add((min(a, b), max(a, b)))
        if len(out) >= most:
            yield batch()
    if out:
        yield batch()


def _forests(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Of rows (leader, chunk, name, n, w) the forest of each chunk."""

    def pairs() -> Iterator[tuple[int, int]]:
        for _, rows in _groups(batches, 2):
            rows = list({r[0]: r for r in rows}.values())
            if len(rows) > 1:
                d = District(np.array([r[1] for r in rows], np.int64), [vector(r[2]) for r in rows], t)
                yield from ((rows[i][0], rows[j][0]) for i, j in forest(d))

    return _pair_batches(pairs())


def _rest(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Of rows (leader, l, r, name, n, comp, side, w) the pairs of each two chunks; side 2 is on both."""

    def pairs() -> Iterator[tuple[int, int]]:
        for _, rows in _groups(batches, 3):
            comp, side = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if len(left) and len(right) and len(set(comp)) > 1:
                d = District(np.array([r[1] for r in rows], np.int64), [vector(r[4]) for r in rows], t)
                yield from ((rows[i][0], rows[j][0]) for i, j in across(d, comp, left, right))

    return _pair_batches(pairs())


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """A scratch table that goes to every task if it has few rows, and is joined by shuffles otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def salted(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """pairs with the set of one side; a set of many partners is copied, so that they needn't meet in one task."""
    many = scratch(pairs.groupBy(side).agg(F.count("*").alias("m")).where(F.col("m") > SALT).select(F.col(side).alias("name"), F.ceil(F.col("m") / SALT).cast("int").alias("of")))
    few = small(many)
    salt = F.pmod(F.xxhash64("a", "b"), F.coalesce("of", F.lit(1))).cast("int")
    left = pairs.join(few.withColumnRenamed("name", side), side, "left").withColumn("salt", salt).drop("of")
    copies = sets.join(few, "name", "left").select(F.col("name").alias(side), F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1)).alias("salt"), F.col("s").alias(f"s{side}"))
    return left.join(copies, [side, "salt"]).drop("salt")


class Join:
    """The steps of the join over one table of texts (doc_id, place, text)."""

    def __init__(self, base: DataFrame, t: int, k: int, hot_rows: int, narrow: int):
        self.base, self.t, self.k, self.narrow = base, t, k, narrow
        spark = base.sparkSession
        facts = scratch(base.mapInArrow(lambda b: _points(b, k, t, narrow), "doc_id long, place long, n long, h1 long, h2 long, w binary"))
        rows = facts.where("w is not null")
        named = rows.withColumn("name", F.col("h1"))
        self.points = self._points_of(named)
        clash = [r["name"] for r in self.points.where("lo1 <> hi1 or lo2 <> hi2").select("name").collect()]  # 64 bits of different sets agree next to never
        if clash:
            discard(self.points)
            named = rows.withColumn("name", F.when(F.col("h1").isin(clash), F.col("h2")).otherwise(F.col("h1")))
            self.points = self._points_of(named)
            if not self.points.where("lo1 <> hi1 or lo2 <> hi2").isEmpty():
                raise RuntimeError("names of different sets agree")
        self.rows = scratch(named.select("doc_id", "place", "n", "name"))
        hot = facts.where("w is null").groupBy("h1", "place").agg(F.sum("n").alias("n"), F.min("h2").alias("least"))
        hot = hot.groupBy("h1").agg(F.sum("n").alias("n"), F.collect_list(F.struct("place", "least")).alias("by")).orderBy(F.desc("n"), "h1").limit(hot_rows).collect()
        hot.sort(key=lambda r: r["h1"] % (1 << 64))
        discard(facts)
        free(spark)
        codes = np.array([i * 256 + x["place"] for i, r in enumerate(hot) for x in r["by"]], np.int64)
        least = np.array([x["least"] for r in hot for x in r["by"]], np.int64)
        order = np.argsort(codes)
        self.known = spark.sparkContext.broadcast(Common(np.array([r["h1"] for r in hot], np.int64).view(np.uint64), np.array([r["n"] for r in hot], np.int64), codes[order], least[order], frozenset(clash)))

    def _points_of(self, rows: DataFrame) -> DataFrame:
        """A row for each set; its least and greatest halves differ where different sets have one name."""
        return scratch(rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("rep"), F.min("place").alias("place"), F.first("n").alias("n"), F.first("w").alias("w"), *[f(h).alias(f"{k}{h[1]}") for k, f in (("lo", F.min), ("hi", F.max)) for h in ("h1", "h2")]))

    def districts(self) -> DataFrame:
        """(leader, name): linked sets share a district."""
        k, t, narrow, known = self.k, self.t, self.narrow, self.known
        keyed = self.base.select("text").mapInArrow(lambda b: _keys(b, k, t, narrow, known), "key long, salt long, name long, n long")
        at = W.partitionBy("key", "salt")
        by_size = at.orderBy("n", "name")
        once = keyed.withColumn("same", F.lag("name").over(by_size)).where("same is null or same <> name")  # equal sets of several tasks
        once = once.withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size))
        starts = F.col("less").isNull() | (100 * F.col("less") < t * F.col("n"))
        alone = starts & (F.col("more").isNull() | (100 * F.col("n") < t * F.col("more")))
        runs = once.where((F.col("salt") != 0) | ~alone).withColumn("run", F.sum(starts.cast("int")).over(by_size.rowsBetween(W.unboundedPreceding, 0)))
        leader = F.when(F.col("salt") != 0, F.col("key")).otherwise(F.min("name").over(W.partitionBy("key", "salt", "run")))
        out = scratch(runs.select(leader.alias("leader"), "name").distinct())
        del keyed, once, runs, starts, alone, leader
        free(self.base.sparkSession)
        return out

    def chunked(self, led: DataFrame) -> DataFrame:
        """(leader, chunk, name): large districts in chunks, each with the leader."""
        large = scratch(led.groupBy("leader").agg(F.count("*").alias("m")).where(F.col("m") > FOREST).select("leader", F.ceil(F.col("m") / FOREST).cast("int").alias("of")))
        dealt = led.join(small(large), "leader", "left").select("leader", F.pmod(F.xxhash64("name"), F.coalesce("of", F.lit(1))).cast("int").alias("chunk"), "name")
        return dealt.unionByName(large.select("leader", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("chunk"), F.col("leader").alias("name")))

    def forests(self, led: DataFrame) -> DataFrame:
        t = self.t
        rows = self.chunked(led).join(self.points.select("name", "n", "w"), "name").select("leader", "chunk", "name", "n", "w")
        return scratch(rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk").mapInArrow(lambda b: _forests(b, t), "a long, b long").distinct())

    def rest(self, led: DataFrame, early: DataFrame, first: DataFrame) -> DataFrame:
        """Pairs of different components in districts that hold several, without those compared before. The largest
        component of a district meets the others, and those meet one another, in chunks."""
        t = self.t
        known = scratch(led.join(early.withColumnRenamed("node", "name"), "name", "left").select("leader", "name", F.coalesce("component", "name").alias("comp")))
        per = known.groupBy("leader", "comp").agg(F.count("*").alias("m"))
        per = per.groupBy("leader").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("comps")).where("comps > 1")
        chunks = lambda n: F.ceil(n / CHUNK).cast("int")
        spread = scratch(per.select("leader", F.col("top.comp").alias("top"), chunks(F.col("top.m")).alias("of_top"), chunks(F.col("all") - F.col("top.m")).alias("of_rest")))
        rows = known.join(small(spread), "leader")
        is_top = F.col("comp") == F.col("top")
        rows = rows.withColumn("c", F.pmod(F.xxhash64("name"), F.when(is_top, F.col("of_top")).otherwise(F.col("of_rest"))).cast("int"))
        # chunks of the largest component are numbered from -1 down
        meet = lambda l, r, side: F.struct(l.alias("l"), r.alias("r"), side.alias("side"))
        others = F.sequence(F.lit(0), F.col("of_rest") - 1)
        top = F.transform(others, lambda r: meet(-F.col("c") - 1, r, F.lit(0)))
        with_top = F.transform(F.sequence(F.lit(1), F.col("of_top")), lambda l: meet(-l, F.col("c"), F.lit(1)))
        own = F.transform(others, lambda o: meet(F.least(o, F.col("c")), F.greatest(o, F.col("c")), F.when(o == F.col("c"), 2).when(F.col("c") < o, 0).otherwise(1)))
        dealt = rows.select("leader", "name", "comp", F.explode(F.when(is_top, top).otherwise(F.concat(with_top, own))).alias("at"))
        dealt = dealt.join(self.points.select("name", "n", "w"), "name").select("leader", "at.l", "at.r", "name", "n", "comp", "at.side", "w")
        found = dealt.repartition("leader", "l", "r").sortWithinPartitions("leader", "l", "r").mapInArrow(lambda b: _rest(b, t), "a long, b long")
        out = scratch(found.distinct().join(first, ["a", "b"], "left_anti"))
        discard(known, spread)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Linked pairs among (a, b), by the sets of their texts."""
        t, k, narrow, known = self.t, self.k, self.narrow, self.known
        wanted = scratch(pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).distinct())
        texts = scratch(self.points.join(wanted, "name").select("place").distinct())
        bucket = F.pmod("place", F.lit(1 << 20))
        some = texts.select(bucket.alias("bucket")).distinct()  # at most 2^20 rows of one number
        near = self.base.select("place", "text").withColumn("bucket", bucket).join(F.broadcast(some), "bucket", "left_semi")
        sets = near.join(texts, "place", "left_semi").select("text").mapInArrow(lambda b: _sets(b, k, narrow, known), "name long, s binary")
        sets = scratch(sets.join(wanted, "name", "left_semi").dropDuplicates(["name"]), "lz4")
        both = salted(salted(pairs, sets, "b"), sets, "a")
        out = scratch(both.select("a", "b", "sa", "sb").mapInArrow(lambda x: _compared(x, t), "a long, b long"))
        discard(sets, texts, wanted)
        return out


def jaccard_classes(docs: DataFrame, threshold: int = 80, words: int = 5, id: str = "doc_id", text: str = "text", hot_rows: int = 65_536, name_bits: int = 64) -> DataFrame:
    """Classes of documents whose sets of word shingles link, 100 * intersection >= threshold * union: id, n_shingles,
    component_id (the smallest id reachable, its own included), place (a hash of the text) and name (of the set; of
    the class as `class`); a row for each row.

    ASCII letters are folded, and words part at ASCII white space. Texts with fewer words are one shingle. Null and
    empty texts have no shingle and link with nothing. Rows without an id take part in links like any other; a class
    without any id has none. Equal ids with different texts are different points, and the class of either is reported
    by row. Texts of any length are one set in one task's memory. Further columns are left alone; an empty table gives
    no rows. Every linked pair is found, at the threshold too: the order of the hashes, the leaders and the list of
    `hot_rows` widely shared hashes bear on cost alone. Sets are named by 64 bits of a hash of 128, and by the other
    half where those of different sets agree (name_bits: narrower halves, for tests).
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text).cast("string")
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), text.alias("text"))
    join = Join(base, threshold, words, hot_rows, name_bits)
    led = join.districts()
    first = join.forests(led)
    links = join.verified(first)
    early = scratch(components(links))
    second = join.rest(led, early, first)
    free(spark)
    late = join.verified(second)
    classes = components(links.unionByName(late))
    named = join.points.select("name", "rep").join(classes.withColumnRenamed("node", "name"), "name", "left").select("name", "rep", F.coalesce("component", "name").alias("class"))
    smallest = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    per_set = scratch(named.join(smallest, "class").select("name", "class", "component_id"))
    discard(join.points, led, first, links, early, second, late)
    full = join.rows.where("n > 0").join(per_set, "name").select("doc_id", "n", "component_id", "place", "name", "class")
    none = F.lit(None).cast("long")
    empty = join.rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "place", none.alias("name"), none.alias("class"))
    return full.unionByName(empty).select(F.col("doc_id").alias(id), F.col("n").alias("n_shingles"), "component_id", "place", "name", "class")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    from .common import table

    return jaccard_classes(table(spark, sf_dir, "documents")).drop("place", "name", "class")


def oracle() -> str:
    """op9 in SQL."""
    return r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id AS doc_id, min(other) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
