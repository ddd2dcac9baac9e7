"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words with single spaces. An item of length L may be found with k = floor(L * share)
edits (insertions, deletions, substitutions of a character). Cut into k + 1 pieces, one piece at least survives k
edits, so every passage within the budget holds an exact piece: one automaton finds the pieces of all items. The cuts
form a binary tree in which the budgets of two parts are one less together than that of the whole, so some exact piece
lies next to a sibling that keeps to its parent's budget; that, and a count of shared 4-grams (k edits destroy 4k of
them at most), exclude most places. Myers' bit-parallel algorithm measures the rest. A passage begins and ends at
word edges, so a short item isn't found within a longer word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, unlike, with_columns

WORD = re.compile(r"[^\W_]+")
Q = 4
_PLAIN = str.maketrans({i: " " for i in range(128) if not chr(i).isalnum()})


def folded(text: str | None) -> str:
    """Lower-case words with single spaces."""
    low = (text or "").lower()
    return " ".join(low.translate(_PLAIN).split() if low.isascii() else WORD.findall(low))


def pieces(item: str, k: int, start: int = 0, end: int | None = None, over: tuple[int, int, int] | None = None) -> list[tuple[int, str, tuple[int, int, int] | None]]:
    """The item cut into k + 1 nearly equal pieces: place, text, and the sibling (place, end, budget of the parent)."""
    end = len(item) if end is None else end
    if not k:
        return [(start, item[start:end], over)]
    k1 = (k - 1) // 2
    k2 = k - 1 - k1
    cut = start + (end - start) * (k1 + 1) // (k + 1)
    return pieces(item, k1, start, cut, (cut, end, k)) + pieces(item, k2, cut, end, (start, cut, k))


def probes(item: str, at: int, sibling: tuple[int, int, int] | None) -> list[tuple[str, int]] | None:
    """Texts and their places from the piece's, one of which must be there if the sibling is within its parent's budget."""
    if sibling is None:
        return None
    a, b, k = sibling
    cuts = [a + i * (b - a) // (k + 1) for i in range(k + 2)]
    return [(item[x:y], x - at + shift) for x, y in zip(cuts, cuts[1:]) for shift in sorted(range(-k, k + 1), key=abs)]


def myers(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text and where that part ends (the first such place); (k + 1, -1) if it is over k."""
    m = len(pattern)
    if masks is None:
        masks = char_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, i + 1
        ph <<= 1  # a passage may begin anywhere, so nothing is carried into the lowest bit
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return (best, end) if best <= k else (k + 1, -1)


def scores(pattern: str, text: str, masks: dict[str, int], anchored: bool) -> list[int]:
    """For every end, from 0 on, the least edit distance of the pattern to a part of the text that ends there; to the whole text up to there if anchored."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    out = [m]
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        out.append(score)
        ph = ph << 1 | anchored
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return out


def whole_words(item: str, text: str, a: int, b: int, k: int, masks: dict[str, int]) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest run of whole words within k edits in a region of the text, then the first; None without one."""
    part, best = text[a:b], None
    ends = [(x, j) for j, x in enumerate(scores(item, part, masks, False)) if x <= k and j and (a + j == len(text) or text[a + j] == " ")]
    back = None
    for least, j in sorted(ends):
        if best and least >= best[0]:
            break
        back = back or char_masks(item[::-1])
        from_end = scores(item[::-1], part[:j][::-1][: len(item) + k], back, True)
        for i, x in enumerate(from_end):
            start = a + j - i
            if x <= k and i and (not start or text[start - 1] == " ") and (best is None or (x, start) < best[:2]):
                best = (x, start, a + j)
    return best


def char_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.texts, self.budget, self.masks, self.grams = [], [], [], []
        where: dict[str, list[tuple]] = {}
        self.ids = []
        for item_id, text in items:
            t = folded(text)
            if not t:
                continue
            n, k = len(self.ids), int(len(t) * share)
            self.ids.append(item_id)
            self.texts.append(t)
            self.budget.append(k)
            self.masks.append(char_masks(t))
            self.grams.append({t[i : i + Q] for i in range(len(t) - Q + 1)})
            for at, p, sibling in pieces(t, k):
                where.setdefault(p, []).append((n, at, probes(t, at, sibling)))
        self.automaton = ahocorasick.Automaton()
        for p, spots in where.items():
            self.automaton.add_word(p, (len(p), spots))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(place of the item, distance, start, end in the folded text, number of separate places) of each item found; of several places the nearest, then the first."""
        if not self.ids or not text:
            return []
        regions: dict[int, list[list[int]]] = {}
        for last, (size, spots) in self.automaton.iter(text):
            here = last + 1 - size
            for n, at, near in spots:
                if near is not None and not any(text.startswith(p, here + x) for p, x in near if here + x >= 0):
                    continue
                k, begin = self.budget[n], here - at
                a, b = max(0, begin - k), min(len(text), begin + len(self.texts[n]) + k)
                held = regions.setdefault(n, [])
                if held and a <= held[-1][1] and a >= held[-1][0]:
                    held[-1][1] = max(held[-1][1], b)
                else:
                    held.append([a, b])
        out = []
        for n, places in regions.items():
            item, k, grams = self.texts[n], self.budget[n], self.grams[n]
            least = len(item) - Q + 1 - k * Q
            best, count = None, 0
            merged: list[list[int]] = []
            for a, b in sorted(places):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                part = text[a:b]
                if least > 0 and sum(part[i : i + Q] in grams for i in range(len(part) - Q + 1)) < least:
                    continue
                if myers(item, part, k, self.masks[n])[1] < 0:
                    continue
                found = whole_words(item, text, a, b, k, self.masks[n])
                if found:
                    count += 1
                    best = min(best or found, found)
            if best:
                out.append((n, *best, count))
        return out


def _items(shared, name: str) -> Items:
    """One block for each Python worker: what a task has built serves the next."""
    return kept(("items", name), lambda: Items(*shared.value))


def _found(batches: Iterator[pa.RecordBatch], shared, name: str) -> Iterator[pa.RecordBatch]:
    items = _items(shared, name)
    for b in batches:
        docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows = []
        for doc, text in zip(docs, texts):
            low = folded(text)
            hits = items.find(low)
            if hits:
                starts, ends = _origin(text)
                for n, distance, a, c, count in hits:
                    rows.append((doc, items.ids[n], distance, items.budget[n], starts[a], ends[c - 1], count))
        names = ["doc_id", "item_id", "distance", "budget", "start", "end", "places"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=names)


def _marked(batches: Iterator[pa.RecordBatch], shared, name: str) -> Iterator[pa.RecordBatch]:
    items = _items(shared, name)
    for b in batches:
        found = [bool(items.find(folded(t))) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.bool_())], names=[*b.schema.names[:-1], "found"])


def _origin(text: str) -> tuple[list[int], list[int]]:
    """For each character of the folded text, where its original begins and ends."""
    starts: list[int] = []
    ends: list[int] = []
    low, source = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            low.append(x)
            source.append(i)
    for m in WORD.finditer("".join(low)):
        if starts:
            starts.append(ends[-1])
            ends.append(source[m.start()])
        starts += source[m.start() : m.end()]
        ends += [i + 1 for i in source[m.start() : m.end()]]
    return starts, ends


def _blocks(benchmark: DataFrame, share: float, chars: int) -> Iterator[tuple]:
    """(broadcast, name) of blocks of items of about that many characters; the driver holds one of them."""
    sc = benchmark.sparkSession.sparkContext
    block, size, any_yet = [], 0, False
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= chars:
            yield sc.broadcast((block, share)), uuid.uuid4().hex
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield sc.broadcast((block, share)), uuid.uuid4().hex


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, chars: int = 4_000_000) -> DataFrame:
    """Passages of benchmark(item_id, text) in docs(doc_id, text) within an edit budget of that share of the item's length.

    One row for each document and item found: doc_id, item_id, distance, budget, start and end of the nearest passage
    (code points of the document's text; of equally near ones the first) and the number of separate places. Items and
    texts that are null or have no word match nothing; an item of fewer than 1/share characters matches itself only,
    at word edges like any other. Repeated rows are found as often as they come, rows without an id too, and texts of
    any length are read whole, one at a time. Further columns are left alone. Items go to the executors in blocks of
    about `chars` characters, each block in a pass of its own over the documents, which are never shuffled.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id long, item_id long, distance long, budget long, start long, end long, places long"
    parts = [chosen.mapInArrow(lambda b, s=shared, n=name: _found(b, s, n), kind) for shared, name in _blocks(benchmark, share, chars)]
    return reduce(DataFrame.unionByName, parts)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: float = 0.1, chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, with all their columns, in which contaminated() would find nothing; row by row, whatever their ids."""
    mark = unlike("found", docs.columns)
    for shared, name in _blocks(benchmark, share, chars):
        found = with_columns(docs, docs.columns, text, {"found": "boolean"}, lambda b, s=shared, n=name: _marked(b, s, n))
        docs = found.where(~F.col(mark)).drop(mark)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """All benchmark passages in the documents, with a budget of a tenth of the item's length."""
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
