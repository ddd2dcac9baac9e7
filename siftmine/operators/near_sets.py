"""Similar sets by blocks of sets of like size, without a shuffled pair.

Rows are packed in chunks with a dictionary each, so that elements are counted and numbered by dictionary and not by row. A set
is its elements' ranks, the rarest first, with its MinHashes. Sets are cut into blocks by size; a block travels to every block
of smaller sets that are large enough for the threshold, whose task holds its own sets by element and goes through the others.
Two sets that are similar share some of their rarest elements: how many, and of how many, follows from the sizes of the two
blocks. Pairs that do and agree in a band of MinHashes are compared in full there.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmine.sources.scratch import free, settled
from siftmine.sources.shipping import ship

TOLD = ["chunk", "element", "code", "times", "raw"]
CHUNK = 1_000_000  # rows with a dictionary of their own
LAST = 0xFFFFFFFF  # behind every place in a dictionary
BLOCK = (1_000_000, 16_000_000)  # elements of a block, least and most; between them a sixteenth of all
SETS = 40_000  # sets of a block at most
CELLS = 2_000_000  # pairs that are counted at once
HITS = 2_000_000  # common elements that are counted at once, unless one set has more
ROWS = 2_000  # sets of another block that are taken at once


def _shrunk(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32 by their steps."""
    steps = np.diff(x.astype(np.int64), prepend=0).astype("<u4")  # a step down is one modulo 2^32
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _opened(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.uint32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some CHUNK rows; rows of a set that come one after the other stay together."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= CHUNK:
            table = pa.concat_tables(held).combine_chunks()
            ids = table.column(0).combine_chunks()
            change = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False))
            cut = int(change[-1]) + 1 if len(change) else len(ids)
            yield table.slice(0, cut)
            held = [table.slice(cut)]
    if sum(t.num_rows for t in held):
        yield pa.concat_tables(held)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk its elements, numbered, with their times; and one row with its sets, as numbers."""
    part = TaskContext.get().partitionId()
    for k, table in enumerate(_chunks(batches)):
        chunk = (part << 32) + k
        ids, words = (table.column(c).combine_chunks().dictionary_encode() for c in (0, 1))
        many = len(words.dictionary)
        cells = np.sort(ids.indices.to_numpy().astype(np.int64) * many + words.indices.to_numpy())
        of, code = np.divmod(cells[np.diff(cells, prepend=-1) > 0], many)
        times = np.bincount(code, minlength=many)
        for at in range(0, many, 100_000):
            some = words.dictionary.slice(at, 100_000)
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), some, pa.array(np.arange(at, at + n)), pa.array(times[at : at + n].astype(np.int64)), pa.nulls(n, pa.binary())], names=TOLD)
        sets = pa.RecordBatch.from_arrays([ids.dictionary, pa.array(np.bincount(of))], names=["set_id", "n"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, sets.schema) as stream:
            stream.write_batch(sets)
        raw = pickle.dumps((out.getvalue().to_pybytes(), _shrunk(code)))  # one value, as Arrow lists cost Spark time in rows without them, too
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, words.dictionary.type), pa.array([LAST]), pa.nulls(1, pa.int64()), pa.array([raw], pa.binary())], names=TOLD)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted elements (element, times) with their part, how rare they are, and their places in the part and among its equally rare ones."""
    part, rank, seen = TaskContext.get().partitionId(), 0, np.zeros(1024, np.int64)
    for batch in batches:
        n = batch.num_rows
        rare = np.floor(16 * np.log2(batch.column(1).to_numpy())).astype(np.int64)
        order = np.argsort(rare, kind="stable")
        count = np.bincount(rare, minlength=1024)
        within = np.empty(n, np.int64)
        within[order] = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part)), pa.array(rare), pa.array(np.arange(rank, rank + n)), pa.array(within + seen[rare])], names=["element", "part", "rare", "place", "within"])
        rank, seen = rank + n, seen + count


def _sets(batches: Iterator[pa.RecordBatch], m: int, hashes: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The sets of each chunk, whose dictionary's numbers come before it."""
    es, rs = [], []
    for batch in batches:
        code, e, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
        at = 0
        for k in [*np.flatnonzero(code == LAST).tolist(), len(code)]:
            es.append(e[at:k])
            rs.append(r[at:k])
            at = k + 1
            if k == len(code):
                continue
            e_of, r_of = (np.concatenate(x).astype(np.int64) for x in (es, rs))
            es, rs = [], []
            h_of = [(((a * e_of + b) % p) % m).astype(np.int32) for a, b, p in hashes]
            names, codes = pickle.loads(batch.column(4)[k].as_py())
            (sets,), codes = list(pa.ipc.open_stream(names)), _opened(codes)
            ids, sizes = sets.column(0), sets.column(1).to_numpy()
            starts = np.cumsum(sizes) - sizes
            ranks = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) + r_of[codes]) & LAST
            h = np.stack([np.minimum.reduceat(x[codes], starts) for x in h_of], 1)
            for i in range(0, len(ids), 500):
                part = slice(i, i + 500)
                raw = [_shrunk(ranks[s : s + n]) for s, n in zip(starts[part].tolist(), sizes[part].tolist())]
                yield _rows(ids.slice(i, 500), sizes[part], h[part], raw)


def _rows(ids: pa.Array, sizes: np.ndarray, h: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
    hs = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1]), pa.int32()), pa.array(h.astype(np.int32).ravel()))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), hs, pa.array(raw, pa.binary())], names=["set_id", "n", "h", "raw"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of which several chunks have parts."""
    for batch in batches:
        for k in range(batch.num_rows):
            parts = batch.column(1).slice(k, 1).flatten()
            h = np.min(parts.field("h").to_pylist(), 0)[None, :]
            ranks = np.unique(np.concatenate([_opened(x) for x in parts.field("raw").to_pylist()]))
            yield _rows(batch.column(0).slice(k, 1), np.array([len(ranks)]), h, [_shrunk(ranks)])


def prepared(df: DataFrame, set_id: str, element: str, hashes: list[tuple[int, int, int]]) -> tuple[DataFrame, int, int]:
    """Table (set_id, n, h, raw): each set's number of elements, MinHashes of their places among all sorted ones, and their
    ranks, the rarest first, packed; the number of all elements, and of those that one set has."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(set_id).alias("set_id"), F.col(element).alias("element")).where("set_id is not null and element is not null")
    kind, word = (rows.schema[c].dataType.simpleString() for c in ("set_id", "element"))
    told = settled(rows.mapInArrow(_told, f"chunk long, element {word}, code long, times long, raw binary"))
    words = told.where("raw is null").select("chunk", "code", "element", "times")
    counts = settled(words.groupBy("element").agg(F.sum("times").alias("times")))
    ranged = counts.repartitionByRange("element").sortWithinPartitions("element")
    index = settled(ranged.mapInArrow(_numbered, f"element {word}, part long, rare long, place long, within long"))
    sizes = index.groupBy("rare", "part").agg(F.count("*").alias("size")).toArrow()  # a thousand at most for each part
    rare, part, size = (sizes.column(c).to_numpy().astype(np.int64) for c in ("rare", "part", "size"))
    m = int(size.sum())
    if m >= LAST:
        raise ValueError("more elements than 32 bits number")
    order = np.lexsort((part, rare))
    first = np.empty(len(size), np.int64)
    first[order] = np.cumsum(size[order]) - size[order]
    of = np.bincount(part, size, minlength=1).astype(np.int64)
    base = spark.createDataFrame(pa.table({"rare": rare, "part": part, "first": first, "before": (np.cumsum(of) - of)[part]}), "rare long, part long, first long, before long")
    names = index.join(F.broadcast(base), ["rare", "part"]).select("element", (F.col("before") + F.col("place")).alias("e"), (F.col("first") + F.col("within")).alias("r"))
    dictionaries = words.join(names, "element").select("chunk", "code", "e", "r", F.lit(None).cast("binary").alias("raw"))
    packs = told.where("raw is not null")
    sets = packs.select("chunk", "code", F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("r"), "raw")
    chunks = sorted(r[0] for r in packs.select("chunk").collect())  # one for CHUNK rows
    turn = F.broadcast(spark.createDataFrame([(c, k) for k, c in enumerate(chunks)], "chunk long, turn int"))
    laid = dictionaries.unionByName(sets).join(turn, "chunk").repartitionById(max(1, len(chunks)), "turn").sortWithinPartitions("chunk", "code").drop("turn")
    form = f"set_id {kind}, n int, h array<int>, raw binary"
    out = settled(laid.mapInArrow(lambda b: _sets(b, m, hashes), form))
    if not out.groupBy("set_id").agg(F.count("*").alias("parts")).where("parts > 1").isEmpty():
        parts, out = out, settled(out.groupBy("set_id").agg(F.collect_list(F.struct("h", "raw")).alias("parts")).mapInArrow(_merged, form))
        free(spark, parts)
    free(spark, told, counts, index)
    return out, m, int(size[rare == 0].sum())


def _least(n: np.ndarray, low: int, threshold: float) -> np.ndarray:
    """Size of the smallest set, of those of at least `low`, that may be similar to one of n."""
    return np.maximum(low, np.ceil(threshold * n - 1e-9).astype(np.int64))


def _common(n: np.ndarray | int, other: np.ndarray | int, threshold: float) -> np.ndarray:
    """Elements that similar sets of such sizes share at least."""
    return np.ceil(threshold / (1 + threshold) * (n + other) - 1e-9).astype(np.int64)


class Sets:
    """Sets of one batch: e, their ranks one set after the other, where each begins, and the bands of MinHashes."""

    def __init__(self, batches: list[pa.RecordBatch], band: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        one = lambda c: table.column(c).combine_chunks()
        self.ids, self.n = one("set_id"), one("n").to_numpy().astype(np.int64)
        h = one("h").flatten().to_numpy().reshape(len(self.n), -1, band)
        self.bands = h[:, :, 0].astype(np.int64)
        for k in range(1, band):
            self.bands = self.bands * 2_000_003 + h[:, :, k]  # only pairs that agree by `h` are kept
        self.h = h
        self.e = np.concatenate([_opened(x) for x in one("raw").to_pylist()])
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def prefix(self, low: int, k: int, once: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places and ranks of the elements among which a similar set of `low` elements or more shares k or more, without
        those that no other set has."""
        upto = np.clip(self.n - _common(self.n, _least(self.n, low, threshold), threshold) + k, 0, self.n)
        row, place = np.repeat(np.arange(len(self.n)), upto), np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)
        e = self.e[self.start[row] + place]
        some = e >= once
        return row[some], place[some], e[some]

    def slice(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements of the given sets, one after the other, and where each begins."""
        size = self.n[rows]
        begin = np.cumsum(size) - size
        return self.e[np.repeat(self.start[rows] - begin, size) + np.arange(size.sum())], begin


class Index:
    """The prefixes of a block's sets by element."""

    def __init__(self, sets: Sets, low: int, k: int, once: int, threshold: float):
        self.sets, self.low, self.k, self.once, self.threshold = sets, low, k, once, threshold
        row, place, e = sets.prefix(low, k, once, threshold)
        order = np.argsort(e, kind="stable")
        self.all = row[order], place[order].astype(np.int32), e[order]

    def towards(self, low: int) -> None:
        """From now on others have `low` elements at least; the larger they are, the fewer of a prefix count."""
        n = self.sets.n
        self.need = int(min(self.k, _common(self.low, low, self.threshold)))
        upto = n - _common(n, _least(n, low, self.threshold), self.threshold) + self.need
        row, place, e = self.all
        some = place < upto[row]
        self.rows, e = row[some], e[some]
        first = np.flatnonzero(np.diff(e, prepend=e[:1] + 1) != 0) if len(e) else np.zeros(0, np.int64)
        self.keys, self.bounds = e[first], np.append(first, len(e))

    def pairs(self, right: Sets, same: bool, mark: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Left rows, right rows and similarities."""
        left, threshold = self.sets, self.threshold
        many = len(left.n)
        step = max(1, CELLS // many)
        row, _, e = right.prefix(self.low, self.need, self.once, threshold)
        if not len(self.keys) or not len(e):
            return
        at = np.minimum(np.searchsorted(self.keys, e), len(self.keys) - 1)
        met = self.keys[at] == e
        row, at = row[met], at[met]
        place, common = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        bounds = np.searchsorted(row, np.arange(len(right.n) + 1))
        upto = np.concatenate([[0], np.cumsum(common)])[bounds]  # hits before each right set
        k = stop = 0
        while stop < len(right.n):
            k, stop = stop, max(stop + 1, min(stop + step, int(np.searchsorted(upto, upto[stop] + HITS, "right")) - 1, len(right.n)))
            low, high = bounds[k], bounds[stop]
            size = common[low:high]
            hits = self.rows[np.repeat(place[low:high] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            count = np.bincount(np.repeat((row[low:high] - k) * many, size) + hits)
            r, x = np.divmod(np.flatnonzero(count >= self.need), many)
            r += k
            nl, nr = left.n[x], right.n[r]
            ok = np.minimum(nl, nr) >= threshold * np.maximum(nl, nr) - 1e-9
            if same:
                ok &= x < r
            r, x = r[ok], x[ok]
            agree = (left.bands[x] == right.bands[r]).any(1)
            r, x = r[agree], x[agree]
            agree = (left.h[x] == right.h[r]).all(2).any(1)
            r, x = r[agree], x[agree]
            ends = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]]) if len(r) else [0]
            for i, j in zip(ends[:-1], ends[1:]):
                own = right.e[right.start[r[i]] : right.start[r[i] + 1]]
                mark[own] = True
                for p in range(i, j, 2_000):
                    rows = x[p : min(j, p + 2_000)]
                    e, begin = left.slice(rows)
                    both = np.add.reduceat(mark[e], begin, dtype=np.int64)
                    s = both / (left.n[rows] + right.n[r[i]] - both)
                    near = s >= threshold
                    yield rows[near], np.full(near.sum(), r[i]), s[near]
                mark[own] = False


def similar(sets: DataFrame, m: int, once: int, threshold: float, band: int) -> DataFrame:
    """id1 < id2, similarity of the pairs that agree in a whole band of MinHashes and are within the threshold."""
    spark = sets.sparkSession
    kind = sets.schema["set_id"].dataType.simpleString()
    sizes = sorted(map(tuple, sets.groupBy("n").agg(F.count("*")).collect()))  # as many as sets differ in size
    total = sum(n * c for n, c in sizes)
    most = min(BLOCK[1], max(BLOCK[0], total // 16))
    dealt, blocks, filled = [], [], 0  # (n, first block, parts); least and most size and sets of each block
    for n, c in sizes:
        parts = max(-(-n * c // most), -(-c // SETS))
        if blocks and parts == 1 and filled + n * c <= most and blocks[-1][2] + c <= SETS:
            blocks[-1][1], blocks[-1][2], filled = n, blocks[-1][2] + c, filled + n * c
            dealt.append((n, len(blocks) - 1, 1))
        else:
            dealt.append((n, len(blocks), parts))
            blocks += [[n, n, -(-c // parts)] for _ in range(parts)]
            filled = n * c if parts == 1 else most
    if not blocks:
        return spark.createDataFrame([], f"id1 {kind}, id2 {kind}, similarity double")
    meets = [[i for i in range(b + 1) if blocks[i][1] >= threshold * low - 1e-9] for b, (low, _, _) in enumerate(blocks)]
    work = np.zeros(len(blocks))
    for b, to in enumerate(meets):
        work[to] += blocks[b][2] * np.array([blocks[i][2] for i in to], float)
    turn = np.argsort(np.argsort(-work, kind="stable")).tolist()  # the most work first
    lows = [b[0] for b in blocks]
    which = spark.createDataFrame(dealt, "n int, block int, parts int")
    targets = spark.createDataFrame([(b, [(i, turn[i]) for i in to]) for b, to in enumerate(meets)], "block int, to array<struct<to:int,turn:int>>")
    told = sets.join(F.broadcast(which), "n").withColumn("block", (F.col("block") + F.pmod(F.xxhash64("set_id"), "parts")).cast("int")).drop("parts")
    copies = told.join(F.broadcast(targets), "block").withColumn("to", F.explode("to")).select("to.to", "to.turn", "block", "set_id", "n", "h", "raw")
    copies = copies.repartitionById(len(blocks), "turn").sortWithinPartitions("to", "block").drop("turn")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(m, bool)
        now = at = index = None
        own, waiting = [], []

        def found(right: Sets, same: bool) -> Iterator[pa.RecordBatch]:
            left = index.sets
            for x, r, s in index.pairs(right, same, mark):
                yield pa.RecordBatch.from_arrays([left.ids.take(pa.array(x)), right.ids.take(pa.array(r)), pa.array(s)], names=["a", "b", "similarity"])

        def rest() -> Iterator[pa.RecordBatch]:
            """The block is whole: it is laid out by element and met with itself. Or what waits of another is met."""
            nonlocal index
            if own:
                sets = Sets(own, band)
                own.clear()
                index = Index(sets, lows[now], 2 + lows[now] // 40, once, threshold)
                index.towards(lows[now])
                yield from found(sets, True)
            if waiting and index is not None:
                yield from found(Sets(waiting, band), False)
            waiting.clear()

        for batch in batches:
            target, block = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(target) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(target)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if (target[i], block[i]) != (now, at):
                    yield from rest()
                    if target[i] != now:
                        index = None  # until its block is there, which may be empty
                    now, at = target[i], block[i]
                    if at != now and index is not None:
                        index.towards(lows[at])
                part = batch.slice(i, j - i)
                if at == now:
                    own.append(part)
                    continue
                waiting.append(part)
                if sum(x.num_rows for x in waiting) >= ROWS:
                    yield from rest()
        yield from rest()

    out = copies.mapInArrow(met, f"a {kind}, b {kind}, similarity double")
    return out.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "similarity")
