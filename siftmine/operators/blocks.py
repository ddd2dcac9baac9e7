"""All pairs of rows of a table of cells (row, place, value), by products of dense blocks of rows.

Where few places are shared by many rows, a join by place meets every pair of rows once for each place they share. Here
rows are sorted and cut into blocks, a block is packed into one value, and each pair of blocks is a task that multiplies
two dense matrices: what is shuffled are the blocks, a copy for each block that they meet, and no pair of rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmine.functions.scalar import dense_index
from siftmine.sources.scratch import settled
from siftmine.sources.shipping import ship

MOST_PLACES = 4096
LEAST_PAIRS = 1_000_000  # of cells with the same place; fewer are joined
JOINED = 500  # products that take the time of one joined pair
CELLS = 4_000_000  # of a dense block
TILE = 512  # rows whose products are held at once
MEMBERS = 4_000  # rows of a block of classes
BATCH = 200_000  # rows of a batch, unless those of one class with a block are more


def dense_enough(cells: DataFrame) -> tuple[int, int] | None:
    """Numbers of rows and places of cells(row, place, ..), if blocks are less work than a join by place, else None."""
    s = cells.groupBy("place").agg(F.count("*").cast("double").alias("m")).agg(F.count("*").alias("places"), F.sum(F.col("m") * F.col("m")).alias("pairs")).first()
    if not s["places"] or s["places"] > MOST_PLACES or s["pairs"] < LEAST_PAIRS:
        return None
    rows = cells.select("row").distinct().count()
    return (rows, s["places"]) if s["places"] * rows * rows <= JOINED * s["pairs"] else None


class Block:
    """Sorted rows: ids, and a dense matrix for each value column."""

    def __init__(self, ids: pa.Array, raw: bytes, places: int):
        lengths, at, values = pickle.loads(zlib.decompress(raw))
        row = np.repeat(np.arange(len(lengths)), lengths)
        self.ids, self.dense = ids, []
        for v in values:
            # sums of MOST_PLACES products of such numbers are exact in single precision
            m = np.zeros((len(lengths), places), np.float32 if v.dtype == np.int8 and np.abs(v).max(initial=0) < 64 else np.float64)
            m[row, at] = v
            self.dense.append(m)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    whole = x.astype("i8")
    if len(x) and not (whole == x).all():
        return x
    most = int(np.abs(whole).max(initial=0))
    return whole.astype("i1" if most < 1 << 7 else "i2" if most < 1 << 15 else "i8")


def _packed(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column(1).slice(k, 1).flatten()
            ids, cells = rows.field(0), rows.field(1)
            flat = cells.flatten()
            raw = pickle.dumps((cells.value_lengths().to_numpy().astype("i4"), flat.field(0).to_numpy().astype("u2"), [_narrow(flat.field(1 + v).to_numpy()) for v in range(values)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([zlib.compress(raw, 1)], pa.binary())], names=["block", "ids", "raw"])


def _met(batches: Iterator[pa.RecordBatch], places: int, kernel: Callable) -> Iterator[pa.RecordBatch]:
    """kernel(left, right, same) of each pair of blocks; the two rows of a pair come one after the other."""
    last = None
    for batch in batches:
        for k in range(batch.num_rows):
            i, j, side, raw = (batch.column(c)[k].as_py() for c in (0, 1, 2, 4))
            block = Block(batch.column(3).slice(k, 1).flatten(), raw, places)
            if i == j:
                yield from kernel(block, block, True)
            elif side == 0:
                last = block
            else:
                yield from kernel(last, block, False)
                last = None


def pairs(cells: DataFrame, rows: int, places: int, kernel: Callable, kind: str) -> DataFrame:
    """What kernel(left, right, same) yields, as batches of the type `kind`, for every pair of blocks.

    cells(row, place, further columns of whole or real numbers, once for each row and place). Every row of the left block
    is before every one of the right, or both are the same block, in ascending order.
    """
    return _by_blocks(_rows(cells), rows, max(256, min(16_384, CELLS // places, max(512, rows // 20))), places, kernel, kind)


def pairs_or_classes(cells: DataFrame, rows: int, places: int, kernel: Callable, by_class: Callable, kind: str) -> DataFrame:
    """pairs() by kernel, or by by_class, whose rows are lists of the equal ones, where there are two of a kind on average."""
    told = settled(_rows(cells))
    classes = settled(told.groupBy("cells").agg(F.sort_array(F.collect_list("row")).alias("row")).select("row", "cells"))
    n = classes.count()
    if 2 * n > rows:
        return _by_blocks(told, rows, max(256, min(16_384, CELLS // places, max(512, rows // 20))), places, kernel, kind)
    return _by_blocks(classes, n, max(1, min(CELLS // places, max(512, n // 20), MEMBERS * n // rows)), places, by_class, kind)


def _rows(cells: DataFrame) -> DataFrame:
    """row, cells (at, values), at the number of the place."""
    index = settled(dense_index(cells, "place", "at"))
    return cells.join(F.broadcast(index), "place").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", *[F.col(v).cast("double").alias(v) for v in cells.columns[2:]]))).alias("cells"))


def _by_blocks(told: DataFrame, rows: int, size: int, places: int, kernel: Callable, kind: str) -> DataFrame:
    spark = told.sparkSession
    ship(spark)
    of = -(-rows // size)
    ranged = settled(told.repartitionByRange(of, "row").withColumn("block", F.spark_partition_id()))
    whole = ranged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    id_type = told.schema["row"].dataType.simpleString()
    n = len(told.schema["cells"].dataType.elementType.fields) - 1
    packed = settled(whole.mapInArrow(lambda b: _packed(b, n), f"block int, ids array<{id_type}>, raw binary"))
    # left of the blocks after it, right of those before it
    meets = F.transform(F.sequence(F.lit(0), F.lit(of - 1)), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), (k < F.col("block")).cast("int").alias("side")))
    copies = packed.select(F.explode(meets).alias("m"), "ids", "raw").select("m.i", "m.j", "m.side", "ids", "raw")
    copies = copies.repartition(min(of * (of + 1) // 2, 400), "i", "j").sortWithinPartitions("i", "j", "side")
    return copies.mapInArrow(lambda b: _met(b, places, kernel), kind)


def _tiles(n: int) -> Iterator[slice]:
    return (slice(k, min(n, k + TILE)) for k in range(0, n, TILE))


def _upper(mask: np.ndarray, tile: slice) -> np.ndarray:
    """The mask without pairs of a row with itself or one before it."""
    return mask & (np.arange(mask.shape[1])[None, :] > np.arange(tile.start, tile.stop)[:, None])


def overlaps(shared: int) -> Callable:
    """Kernel: a, b, n of the pairs with at least so many places in common; the value is 1."""

    def kernel(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
        for t in _tiles(len(left.ids)):
            n = left.dense[0][t] @ right.dense[0].T
            mask = n >= shared
            a, b = np.nonzero(_upper(mask, t) if same else mask)
            yield pa.RecordBatch.from_arrays([left.ids.take(pa.array(a + t.start)), right.ids.take(pa.array(b)), pa.array(n[a, b].astype("i8"))], names=["a", "b", "n"])

    return kernel


def _correlation(left: Block, right: Block, t: slice) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of common places, and similarities, of a tile with a block; values are number, sum and sum of squares."""
    (ca, sa, qa), (cb, sb, qb) = [m[t] for m in left.dense], right.dense
    n, sx, sxx = (np.asarray(m @ cb.T, np.float64) for m in (ca, sa, qa))
    sy, syy = (np.asarray(ca @ m.T, np.float64) for m in (sb, qb))
    top = n * np.asarray(sa @ sb.T, np.float64) - sx * sy
    with np.errstate(all="ignore"):
        return n, np.where(top == 0, 0.0, top / (np.sqrt(n * sxx - sx * sx) * np.sqrt(n * syy - sy * sy)))


def pearson(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
    """Kernel: id1, id2, similarity of the pairs with a common place."""
    for t in _tiles(len(left.ids)):
        n, s = _correlation(left, right, t)
        a, b = np.nonzero(_upper(n > 0, t) if same else n > 0)
        yield pa.RecordBatch.from_arrays([left.ids.take(pa.array(a + t.start)), right.ids.take(pa.array(b)), pa.array(s[a, b])], names=["id1", "id2", "similarity"])


def rounded(kernel: Callable, digits: int | None) -> Callable:
    """The kernel with similarities rounded as Spark does, if to so many digits."""

    def inner(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
        for batch in kernel(left, right, same):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_round(batch.column(2).to_numpy(), digits))], names=batch.schema.names)

    return kernel if digits is None else inner


def _round(s: np.ndarray, digits: int | None) -> np.ndarray:
    return s if digits is None else _rank(s, digits) / 10.0**digits + 0.0


def pearson_of_classes(digits: int | None = None) -> Callable:
    """pearson() of rows that are lists of equal ones. Ids of a class follow one another, so that columns are long runs."""

    def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: pa.Array) -> pa.RecordBatch:
        a, b, s = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s)], names=["id1", "id2", "similarity"])

    def kernel(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
        sides = [left.ids] if same else [left.ids, right.ids]
        flat = pa.concat_arrays([x.flatten() for x in sides])
        order = pc.sort_indices(flat)
        ids, place = flat.take(order), np.empty(len(flat), np.int32)  # ids go by their place among the sorted ones
        place[order.to_numpy()] = np.arange(len(flat), dtype=np.int32)
        sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in sides]
        cut = int(sizes[0].sum())
        mine, other = place[:cut], place[0 if same else cut :]
        size, bounds = sizes[-1], np.concatenate([[0], np.cumsum(sizes[0])])
        of = np.repeat(np.arange(len(size)), size)
        parts, held = [], 0
        for t in _tiles(len(left.ids)):
            n, s = _correlation(left, right, t)
            s = _round(s, digits)
            for i in range(t.start, t.stop):
                a, row = mine[bounds[i] : bounds[i + 1]], i - t.start
                some = (n[row] > 0)[of]
                if same:
                    some[: bounds[i + 1]] = False
                    x, y = np.triu_indices(len(a), 1)
                    parts.append((a[x], a[y], np.full(len(x), s[row, i])))
                b, v = other[some], s[row, of[some]]
                after = b[None, :] > a[:, None]
                for mask in (after, ~after):
                    count = mask.sum(1)
                    one, two, w = np.repeat(a, count), np.broadcast_to(b, mask.shape)[mask], np.broadcast_to(v, mask.shape)[mask]
                    parts.append((one, two, w) if mask is after else (two, one, w))
                held += after.size + len(a) ** 2 // 2 * same
                if held >= BATCH:
                    yield joined(parts, ids)
                    parts, held = [], 0
        if parts:
            yield joined(parts, ids)

    return kernel


def _rank(s: np.ndarray, digits: int = 9) -> np.ndarray:
    """round(s, digits) in units of the last digit, as Spark rounds: half up, of the shortest decimal."""
    scaled = np.abs(s) * 10.0**digits
    low = np.floor(scaled)
    out = np.floor(scaled + 0.5)
    for k in zip(*np.nonzero(np.abs(scaled - low - 0.5) < 1e-5)):
        out[k] = float(Decimal(repr(abs(float(s[k])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, s)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest scores of each row, the earlier of equal ones first, and whether there is one."""
    score, at = score.copy(), []
    rows = np.arange(len(score))
    for _ in range(min(k, score.shape[1])):
        best = score.argmax(1)
        at.append((best, score[rows, best] > -np.inf))
        score[rows, best] = -np.inf
    return np.stack([b for b, _ in at], 1), np.stack([x for _, x in at], 1)


def best_correlated(k: int) -> Callable:
    """Kernel: id, other, s of each row's k most similar ones in the other block, by round(s, 9), then by order."""

    def found(ids: pa.Array, others: pa.Array, row: np.ndarray, other: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), others.take(pa.array(other)), pa.array(s)], names=["id", "other", "s"])

    def kernel(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each tile: scores, rows and similarities of the best for each right row
        for t in _tiles(len(left.ids)):
            n, s = _correlation(left, right, t)
            rows = np.arange(t.start, t.stop)
            score = np.where(n > 0, _rank(s), -np.inf)
            if same:
                score[np.arange(len(rows)), rows] = -np.inf
            at, there = _best(score, k)
            r = np.broadcast_to(np.arange(len(rows))[:, None], at.shape)[there]
            yield found(left.ids, right.ids, rows[r], at[there], s[r, at[there]])
            if not same:
                at, _ = _best(score.T, k)
                col = np.arange(len(right.ids))[:, None]
                back.append((score[at, col], rows[at], s[at, col]))
        if back:
            score, rows, s = (np.concatenate([b[c] for b in back], 1) for c in range(3))
            at, there = _best(score, k)
            r = np.broadcast_to(np.arange(len(score))[:, None], at.shape)[there]
            yield found(right.ids, left.ids, r, rows[r, at[there]], s[r, at[there]])

    return kernel
