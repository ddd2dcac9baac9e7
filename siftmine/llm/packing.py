"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens. A round is one mixture window of `window` tokens: every queue's deficit grows by
its target share of the window and is served in whole tokens; what is left of a deficit is carried to the next
window, and so across the partitions, since the deficit after any number of windows follows from that number alone:
queues are leaves of a binary tree, and at each node the left side has had the floor of its share after any window, the
right side what is left. So every piece's place is computed where its document lies, and no token moves.
When a queue runs out, a new phase begins in which the others share its part in proportion to their targets.

Sources without a target are in proportion to their sizes. There may be any number of them, so their places are not
planned on the driver: sources of like size (within a factor of two) are a class, a queue of the plan, and within
the class each source's share is a row of a table. A class serves its sources in rounds of its own, long enough for
each to be served QUANTUM tokens or so: a source of few tokens isn't dealt out one by one, but some every few windows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, scratch, ship
from .tokens import encoder_of, vocabulary

MOST_BASES = 500_000  # rows of (source, part) that are sent to every task
QUANTUM = 64  # tokens
REST = "*"  # the queue of all sources without a target


def served(w: int, window: int, low: int, high: int, total: int) -> tuple[int, int]:
    """Tokens of the shares before a queue's, and of its own, after w windows of a total of which it has [low, high)."""
    c = min(w * window, total)
    a = c * low // total
    return a, c * high // total - a


def spread(y: int, n: int, window: int, low: int, high: int, total: int) -> Iterator[tuple[int, int, int]]:
    """(ids of the range before, length, position among the total) of tokens y to y + n of a queue, in order."""
    done = 0
    while done < n:
        at = y + done
        w = at * total // ((high - low) * window)
        while served(w, window, low, high, total)[1] > at:
            w -= 1
        while served(w + 1, window, low, high, total)[1] <= at:
            w += 1
        (a0, s0), (a1, s1) = served(w, window, low, high, total), served(w + 1, window, low, high, total)
        length = min(n - done, s1 - at)
        yield done, length, w * window + (a1 - a0) + (at - s0)
        done += length


def at_node(y: int, n: int, window: int, left: int, total: int, is_left: bool) -> Iterator[tuple[int, int, int]]:
    """As spread(), for one side of a node whose left side has so many of the total."""

    def had(w: int) -> tuple[int, int]:
        """Tokens of both sides after w windows, and of this one."""
        c = min(w * window, total)
        return c, c * left // total if is_left else c - c * left // total

    done, mine = 0, left if is_left else total - left
    while done < n:
        at = y + done
        w = at * total // (mine * window)
        while had(w)[1] > at:
            w -= 1
        while had(w + 1)[1] <= at:
            w += 1
        (c0, s0), (c1, s1) = had(w), had(w + 1)
        length = min(n - done, s1 - at)
        yield done, length, c0 + (at - s0) + (0 if is_left else (c1 - c0) - (s1 - s0))
        done += length


class Plan:
    """Where each queue's tokens go: phases, and within a phase a tree of queues, the larger nearer to its root."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, window: int, least: int = 1):
        """least: tokens of a round of queues that are a small part of a window."""
        self.phases: list[tuple[int, dict[str, tuple[int, int, list]]]] = []  # first token, queue -> (tokens before in the queue, tokens, nodes up to the root)
        left = {q: n for q, n in sorted(totals.items()) if n}
        used = dict.fromkeys(left, 0)
        at = 0
        while left:
            weights = {q: (targets or {}).get(q, 0.0) if targets else float(n) for q, n in left.items()}
            if targets is None or not any(weights.values()):
                take = dict(left)  # each at its own size: all run out together
            else:
                rate = min(n / weights[q] for q, n in left.items() if weights[q] > 0)
                take = {q: n if n <= rate * weights[q] * (1 + 1e-12) else min(n, int(rate * weights[q])) for q, n in left.items() if weights[q] > 0}
            take = {q: n for q, n in take.items() if n}
            self.phases.append((at, {q: (used[q], take[q], nodes) for q, nodes in self._tree(take, window, least).items()}))
            for q, n in take.items():
                used[q] += n
                left[q] -= n
            left = {q: n for q, n in left.items() if n}
            at += sum(take.values())
        self.starts: dict[str, list[tuple[int, int]]] = {}
        for k, (_, shares) in enumerate(self.phases):
            for q, (before, _, _) in shares.items():
                self.starts.setdefault(q, []).append((before, k))

    @staticmethod
    def _tree(take: dict[str, int], window: int, least: int) -> dict[str, list[tuple[int, int, int, bool]]]:
        """(window, left, total, on the left) of the nodes above each queue, from it up; the two least are joined first."""
        total = sum(take.values())
        heap = [(n, k, [q]) for k, (q, n) in enumerate(take.items())]
        heapq.heapify(heap)
        nodes: dict[str, list] = {q: [] for q in take}
        k = len(heap)
        while len(heap) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            own = max(min(window, least), window * (a + b) // total)
            for side, is_left in ((left, True), (right, False)):
                for q in side:
                    nodes[q].append((own, a, a + b, is_left))
            heapq.heappush(heap, (a + b, k, left + right))
            k += 1
        return nodes

    def places(self, queue: str, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(ids of the range before, length, global position) of tokens x to x + n of a queue, in order."""
        starts, done = self.starts[queue], 0
        while done < n:
            at = x + done
            k = starts[bisect_right(starts, (at, 1 << 60)) - 1][1]
            first, shares = self.phases[k]
            before, most, nodes = shares[queue]
            some = min(n - done, before + most - at)
            for d, length, pos in self._up(nodes, 0, at - before, some):
                yield done + d, length, first + pos
            done += some

    def _up(self, nodes: list, level: int, y: int, n: int) -> Iterator[tuple[int, int, int]]:
        if level == len(nodes):
            yield 0, n, y
            return
        for d, some, pos in at_node(y, n, *nodes[level]):
            for e, length, place in self._up(nodes, level + 1, pos, some):
                yield d + e, length, place


class Mixture:
    """Places of all tokens: of sources with a target by the plan, of the others by class within the rest."""

    def __init__(self, own: dict[str, int], classes: dict[str, tuple[int, int]], targets: dict[str, float] | None, window: int):
        """own: tokens of each source with a target; classes: tokens and sources of each class of the others."""
        rest = sum(n for n, _ in classes.values())
        self.outer = Plan(own | {REST: rest}, targets, window) if targets is not None else None
        self.inner = Plan({k: n for k, (n, _) in classes.items()}, None, window, QUANTUM)
        self.windows = {k: max(window * n // max(1, rest), of * QUANTUM, 1) for k, (n, of) in classes.items()}
        self.totals = {k: n for k, (n, _) in classes.items()}

    def places(self, queue: str, x: int, n: int, low: int | None, high: int | None) -> Iterator[tuple[int, int, int]]:
        """(ids of the range before, length, global position) of tokens x to x + n of a source."""
        if low is None:
            yield from self.outer.places(queue, x, n)
            return
        for d1, n1, p1 in spread(x, n, self.windows[queue], low, high, self.totals[queue]):
            for d2, n2, p2 in self.inner.places(queue, p1, n1):
                if self.outer is None:
                    yield d1 + d2, n2, p2
                else:
                    for d3, n3, p3 in self.outer.places(REST, p2, n2):
                        yield d1 + d2 + d3, n3, p3


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int, group: int = 3000) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, encoder, seen = TaskContext.get().partitionId(), encoder_of(path), {}
    small = max(end_id, encoder.size) < 1 << 16
    tail = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        docs, sources, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i in range(0, len(texts), group):
            raw = [x + tail for x in encoder.encode(texts[i : i + group])]
            n = [len(x) // 4 for x in raw]
            before = []
            for q, k in zip(sources[i : i + group], n):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + k
            if small:
                raw = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in raw]
            yield pa.RecordBatch.from_pydict({"doc_id": docs.slice(i, len(n)), "source": pa.array(sources[i : i + group], pa.string()), "part": pa.array([part] * len(n), pa.int32()), "before": pa.array(before, pa.int64()), "n": pa.array(n, pa.int64()), "width": pa.array([2 if small else 4] * len(n), pa.int32()), "ids": pa.array(raw, pa.binary())})


def _pieces(batches: Iterator[pa.RecordBatch], shared, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    forget()
    plan: Mixture = shared.value
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"] + ["ids"] * with_ids
    for batch in batches:
        rows = batch.to_pydict()
        out: list[list] = [[] for _ in names]
        for doc, source, queue, low, high, x, n, width, ids in zip(*(rows[k] for k in ("doc_id", "source", "queue", "low", "high", "x", "n", "width", "ids"))):
            raw = np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids
            now = None  # a piece may go on where the one before ends
            for done, size, pos in plan.places(queue, x, n, low, high):
                if now and now[2] + now[1] == pos:
                    now[1] += size
                    continue
                if now:
                    _cut(now, doc, n, source, raw, length, out)
                now = [done, size, pos]
            if now:
                _cut(now, doc, n, source, raw, length, out)
            if len(out[0]) >= 20_000:
                yield _batch(names, out)
                out = [[] for _ in names]
        if out[0]:
            yield _batch(names, out)


def _cut(piece: list[int], doc, n: int, source, raw: bytes, length: int, out: list[list]) -> None:
    """Rows for what lies in each sequence."""
    done, size, pos = piece
    while size:
        some = min(size, length - pos % length)
        ids = raw[done * 4 : (done + some) * 4]
        for col, v in zip(out, (doc, done, some, zlib.crc32(ids), n, pos // length, pos % length, source, ids)):
            col.append(v)
        done, size, pos = done + some, size - some, pos + some


def _batch(names: list[str], out: list[list]) -> pa.RecordBatch:
    kinds = {"source": pa.string(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, out)], names=names)


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """A scratch table of df with the sum of `value` over all rows before, in an order without ties; no task gets all rows."""
    ranged = scratch(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_w", F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    sums = ranged.groupBy("_p").agg(F.sum(value).alias("_m"))
    base = sums.select("_p", F.coalesce(F.sum("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each part
    return ranged.join(F.broadcast(base), "_p").withColumn(name, F.col("_w") + F.col("_b")).drop("_p", "_w", "_b")


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, length: int = 2048, window: int | None = None, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pack docs(doc_id, text, source) into sequences of `length` tokens; returns their pieces.

    targets: wanted share of each source (any positive scale; None names the null source), whatever its size; the
    others form the rest "*", served by its own entry or else when the targets are done, each in proportion to its
    size. None: all sources in proportion to their sizes, so that every window has the corpus's mixture to the end.
    A window is one sequence, or `window` tokens.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and ids (little-endian,
    four bytes each). Every id lies in exactly one piece, sequences are full but for the last, and null sources are
    a source like any other, apart from the empty one. A null or empty text is an end id alone; texts of any length
    are cut freely; an empty table gives no piece; repeated rows, and rows without an id, are packed as often as they
    come. Further columns are left alone. The driver sees the totals of the targets and of some 60 classes by size.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or vocabulary()
    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    ids = scratch(plain.mapInArrow(lambda b: _tokenised(b, tokenizer, end_id), "doc_id long, source string, part int, before long, n long, width int, ids binary"))
    sizes = scratch(ids.groupBy("source", "part").agg(F.sum("n").alias("m")))
    wanted = sorted(k for k, v in (targets or {}).items() if k is not None and k != REST and v > 0)
    nulls = (targets or {}).get(None, 0) > 0
    is_own = F.coalesce(F.col("source").isin(wanted), F.lit(False)) | (F.col("source").isNull() & F.lit(nulls))
    each = sizes.groupBy("source").agg(F.sum("m").alias("total")).withColumn("own", is_own)
    # sources of like size are a class; a source's share of it is a range of the running total over classes and sources
    others = each.where(~F.col("own")).withColumn("queue", F.concat(F.lit("~"), F.lpad(F.floor(F.log2("total")).cast("string"), 2, "0")))
    others = others.withColumn("null", F.col("source").isNull())
    ranged = running(others, ["queue", "null", "source"], "total", "low")
    classes = {r["queue"]: r for r in ranged.groupBy("queue").agg(F.min("low").alias("first"), F.sum("total").alias("n"), F.count("*").alias("of")).collect()}
    first = F.broadcast(spark.createDataFrame([(k, r["first"]) for k, r in classes.items()], "queue string, first long"))
    shares = ranged.join(first, "queue").select("source", "queue", (F.col("low") - F.col("first")).alias("low"), (F.col("low") - F.col("first") + F.col("total")).alias("high"))
    own = {r["source"]: r["total"] for r in each.where("own").collect()}
    key = lambda s: "null" if s is None else f"={s}"
    said = None if targets is None else {q if q == REST else key(q): v for q, v in targets.items()}
    plan = spark.sparkContext.broadcast(Mixture({key(k): n for k, n in own.items()}, {k: (r["n"], r["of"]) for k, r in classes.items()}, said, window or length))
    none = F.lit(None).cast("long")
    shares = shares.unionByName(each.where("own").select("source", F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "source")).alias("queue"), none.alias("low"), none.alias("high")))
    order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("m").over(order), F.lit(0))).alias("z")
    bases = scratch(bases.join(shares.alias("s"), F.col("z.source").eqNullSafe(F.col("s.source"))).select("z.source", "part", "base", "queue", "low", "high"))
    if bases.count() <= MOST_BASES:  # else a shuffled join
        bases = F.broadcast(bases)
    left, right = ids.alias("i"), bases.alias("b")
    placed = left.join(right, (F.col("i.part") == F.col("b.part")) & F.col("i.source").eqNullSafe(F.col("b.source")))
    placed = placed.select("doc_id", "i.source", "queue", "low", "high", (F.col("base") + F.col("before")).alias("x"), "n", "width", "ids")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    return placed.mapInArrow(lambda b: _pieces(b, plan, length, with_ids), kind)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed rows: sequence_id, n_tokens, padded and ids. Padded to `length`, but not where the number of ids
    is a power of two. A sequence gathers at most `length` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("h"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return rows.withColumn("padded", F.when(power, F.col("n_tokens")).otherwise(F.lit(length))).select("sequence_id", "n_tokens", "padded", F.unhex(F.concat("h", F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.col("padded") - F.col("n_tokens")).cast("int")))).alias("ids"))


def op5_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, every sequence with the corpus's mixture of sources."""
    from .common import table

    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("source")
