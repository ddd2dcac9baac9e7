"""Token-id files: Simple-8b word-aligned coding with escapes, and the operator that writes and reads them.

A block is self-contained: a header, one entry for each document (id, null flag, number of ids), the first word of
each run of RUN ids, the escaped values, and the 64-bit words. The top four bits of a word select how many values of
what width its other 60 bits hold. A value of more than 60 bits is written as the selector ESCAPE and kept whole in
the list of escapes. Every run starts on a word of its own, so runs can be coded and decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, ship
from .tokens import encoder_of, vocabulary

# Fixed values of the Simple-8b format: (values in a word, bits of each) by selector; 0 is the escape here.
ESCAPE = 0
LAYOUT = [(1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]

COUNTS = np.array([c for c, _ in LAYOUT], dtype=np.int32)
RUN = 1024
MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIIIQQ")  # magic, documents, runs, escapes, ids, words


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    out = np.zeros(len(ids), dtype=np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        out[big] += step
        rest[big] >>= np.uint64(step)
    return out + (ids > 0)


_SMALL = widths(np.arange(1 << 16, dtype=np.uint64))


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each run and one past the last, and the escaped values, of unsigned 64-bit ids."""
    n = len(ids)
    runs = -(-n // RUN)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    need = _SMALL[ids] if int(ids.max()) < 1 << 16 else widths(ids)
    at = np.arange(n, dtype=np.int32)
    end = np.minimum((at // RUN + 1) * RUN, n).astype(np.int32)
    # runs as rows; what lies beyond a run's end fits everywhere, as the last word of a run is padded
    room = np.zeros((runs, RUN + 120), dtype=np.uint8)
    whole = n // RUN
    room[:whole, :RUN] = need[: whole * RUN].reshape(whole, RUN)
    room[whole:, : n - whole * RUN] = need[whole * RUN :]
    choice = np.zeros((runs, RUN), dtype=np.uint8)
    for sel in range(15, 0, -1):  # the selector that holds most is written last
        count, bits = LAYOUT[sel]
        fits = room <= bits
        if bits < 6 and np.count_nonzero(fits[:, :RUN]) < count:
            continue
        have = 1
        while have < count:
            more = min(have, count - have)
            fits = fits[:, : fits.shape[1] - more] & fits[:, more:]
            have += more
        np.putmask(choice, fits[:, :RUN], sel)
    choice = choice.reshape(-1)[:n]
    nxt = np.minimum(at + COUNTS[choice], end)
    heads = np.arange(0, n, RUN, dtype=np.int32)
    stops = end[heads]
    marks = np.zeros(n, dtype=bool)
    here = heads
    while len(here):
        marks[here] = True
        here = nxt[here]
        going = here < stops
        here, stops = here[going], stops[going]
    start = np.flatnonzero(marks)
    sels = choice[start]
    words = sels.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(120, np.uint64)])
    for sel in range(2, 16):
        mine = np.flatnonzero(sels == sel)
        if not len(mine):
            continue
        count, bits = LAYOUT[sel]
        first = start[mine]
        stop = end[first]
        for k in range(count):
            v = padded[first + k]
            if k:
                v = np.where(first + k < stop, v, np.uint64(0))
            words[mine] |= v << np.uint64(k * bits)
    offsets = np.searchsorted(start, np.arange(runs + 1, dtype=np.int64) * RUN).astype(np.uint32)
    return words, offsets, ids[start[sels == ESCAPE]]


def decode_words(words: np.ndarray, n: int, offsets: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The n ids of encode_words."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    sels = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[sels].astype(np.int64)
    # each run's words hold exactly its ids, but that the last is padded
    first = np.cumsum(counts) - counts
    offsets = offsets.astype(np.int64)
    run = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = first - first[offsets[run]] + run * RUN
    stop = np.minimum((run + 1) * RUN, n)
    for sel in range(16):
        mine = np.flatnonzero(sels == sel)
        if not len(mine) or sel == 1:
            continue
        if sel == ESCAPE:
            out[first[mine]] = escapes
            continue
        count, bits = LAYOUT[sel]
        mask = np.uint64((1 << bits) - 1)
        w, i, s = words[mine], first[mine], stop[mine]
        for k in range(count):
            real = i + k < s
            out[(i + k)[real]] = (w[real] >> np.uint64(k * bits)) & mask
    return out


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = encode_words(ids.astype(np.uint64))
    head = HEAD.pack(MAGIC, len(doc_ids), len(offsets) - 1, len(escapes), len(ids), len(words))
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = np.array([d or 0 for d in doc_ids], dtype="<i8")
    parts = (named, null, np.array(lengths, dtype="<u8"), offsets.astype("<u4"), escapes.astype("<u8"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def read_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    magic, docs, runs, n_escapes, n, n_words = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    named, null, lengths, offsets, escapes, words = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", runs + 1), take("<u8", n_escapes), take("<u8", n_words)
    return [None if z else int(d) for d, z in zip(named, null)], lengths, decode_words(words, n, offsets, escapes)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int, group: int = 3000) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, encoder = TaskContext.get().partitionId(), encoder_of(path)
    names, lengths, held, size, before, block = [], [], [], 0, 0, 0
    tail = np.array([end_id], "<u4").tobytes()

    def flush() -> pa.RecordBatch:
        nonlocal names, lengths, held, size, before, block
        raw = write_block(names, lengths, np.frombuffer(b"".join(held), "<u4"))
        row = pa.RecordBatch.from_pydict({"part": [part], "block": [block], "ids_before": [before], "n_docs": [len(names)], "n_ids": [size], "payload": [raw]})
        before, block = before + size, block + 1
        names, lengths, held, size = [], [], [], 0
        return row

    for batch in batches:
        doc_ids, texts = (batch.column(i).to_pylist() for i in range(2))
        for i in range(0, len(texts), group):
            for d, ids in zip(doc_ids[i : i + group], encoder.encode(texts[i : i + group])):
                ids += tail
                names.append(d)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= block_ids:
                    yield flush()
    if names:
        yield flush()


def part_of(docs: DataFrame, n: int) -> Column:
    """The part, of n that ascend with doc_id and have about as many rows each, of a document; null ids are in the first.

    The bounds come from quantiles of doc_id alone, so no text is read for them.
    """
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    bounds = sorted(set(bounds))[: n - 1]
    if not bounds:
        return F.lit(0)
    # a tree of bounds, 16 to a node, so that few are looked at; each level is one literal, whatever its size
    literal = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")
    levels = [bounds]
    while len(levels[-1]) > 16:
        levels.append(levels[-1][::16])
    at = F.lit(0)
    for k, of in enumerate(reversed(levels)):  # bounds at or below the id, first among all of the highest level
        first = at if not k else F.greatest(at - 1, F.lit(0)) * 16
        at = first + F.size(F.filter(F.slice(literal(of), first + 1, F.lit(16)), lambda x: x <= F.col("doc_id")))
    return F.coalesce(at.cast("int"), F.lit(0))


def write_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, block_ids: int = 500_000, partitions: int | None = None) -> DataFrame:
    """Write the token ids of docs(doc_id, text) in ascending doc_id order (nulls first, then by a hash of the text).

    The files are a table of blocks (part, block, ids_before, n_docs, n_ids, payload): parts ascend with doc_id,
    blocks within a part, documents within a block, and no document is cut. Without a path they go to the shared
    folder. Returns the table as read from its files. A null text has the end id alone; an empty table gives no block.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or vocabulary()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = plain.repartitionById(n, part_of(plain, n)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    blocks = ordered.mapInArrow(lambda b: _encoded(b, tokenizer, end_id, block_ids), "part long, block long, ids_before long, n_docs long, n_ids long, payload binary")
    if path is None:
        return scratch(blocks)
    blocks.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, before, payloads = (batch.column(i) for i in range(3))
        for part, at, raw in zip(parts.to_pylist(), before.to_pylist(), payloads):
            names, lengths, ids = read_block(raw.as_py())
            ends = np.cumsum(lengths).astype(np.int64)
            small = ids.astype("<u4") if not len(ids) or int(ids.max()) < 1 << 32 else ids.astype("<u8")
            view, w = memoryview(small.tobytes()), small.itemsize
            cuts = [(int(e - n) * w, int(e) * w) for e, n in zip(ends, lengths.astype(np.int64))]
            out = {"part": [part] * len(names), "doc_id": pa.array(names, pa.int64()), "before": at + ends - lengths.astype(np.int64), "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(view[a:b]) for a, b in cuts]}
            if with_ids:
                out["ids"] = pa.array([bytes(view[a:b]) for a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)


def read_ids(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of a table of blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids
    (little-endian, four bytes each, eight where a block holds larger ones)."""
    ship(blocks.sparkSession)
    kind = "part long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.select("part", "ids_before", "payload").mapInArrow(lambda b: _decoded(b, with_ids), kind)
    # one row for each part, so a single task can sum them in order
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read back from the files."""
    from .common import table

    blocks = write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read_ids(blocks, with_ids=False)
