"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of a hashed table, its own and that of its first letters. Filters of several widths slide over the words, each is pooled by its
maximum over the whole text, and a logistic unit weighs the pooled values. The score is shifted so that 0.7 is the
best threshold on held-back training rows of the text's language, as guessed from the text's words alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forget, ship, with_columns

WORD = re.compile(r"[^\W\d_]+")
TABLE = 1 << 18
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS)  # empty places after each text, so that every filter has a place in any
THRESHOLD = 0.7


STEM = 4  # letters of a word's beginning


def rows_of(word: str) -> tuple[int, int]:
    """Rows of the hashed table for a word and its beginning; row 0 is the padding."""
    raw, stem = word.encode("utf-8", "surrogatepass"), f"{word[:STEM]}-".encode("utf-8", "surrogatepass")
    return 1 + zlib.crc32(raw) % (TABLE - 1), 1 + zlib.crc32(stem) % (TABLE - 1)


class WordBuckets(dict):
    """Word -> its two rows in one number. Emptied beyond `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        a, b = rows_of(word)
        self[word] = out = a << 32 | b
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Texts' words as rows: words x 2."""
        words = WORD.findall((text or "").lower())
        both = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).astype(np.int32)


class Responses(dict):
    """Word -> place of its filter responses in `rows`, for scoring. Emptied beyond `most` words."""

    def __init__(self, model: "Model", most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most
        self.rows = np.zeros((most, model.wide), np.float32)

    def learn(self, words: set[str]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = words
            if len(new) > self.most:
                self.most = len(new)
                self.rows = np.zeros((self.most, self.model.wide), np.float32)
        if new:
            new = list(new)
            ids = np.array([rows_of(w) for w in new], dtype=np.int32)
            self.rows[len(self) : len(self) + len(new)] = self.model.responses(ids)
            self.update(zip(new, range(len(self), len(self) + len(new))))


@dataclass
class Model:
    table: np.ndarray  # TABLE x DIMS
    filters: dict[int, np.ndarray]  # width -> (width, DIMS, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray  # len(WIDTHS) * FILTERS
    base: float
    langs: list[str] = field(default_factory=list)
    lang_table: np.ndarray | None = None  # TABLE x langs, log-likelihoods as float16
    cuts: np.ndarray | None = None  # by language, the last for texts of none

    @property
    def wide(self) -> int:
        return sum(WIDTHS) * FILTERS + max(1, len(self.langs))

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """What each word gives to every place of every filter, then its log-likelihood in every language."""
        e = self.table[ids[:, 0]] + self.table[ids[:, 1]]
        parts = [e @ self.filters[k][j] for k in WIDTHS for j in range(k)]
        parts.append(self.lang_table[ids[:, 0]].astype(np.float32) if self.langs else np.zeros((len(ids), 1), np.float32))
        return np.concatenate(parts, axis=1)

    def pooled(self, r: np.ndarray) -> np.ndarray:
        """Pooled filters of a text, from the responses of its words."""
        r = np.concatenate([r, np.zeros((PAD, r.shape[1]), np.float32)])
        out, at = [], 0
        for k in WIDTHS:
            v = r[:, at : at + FILTERS]
            for j in range(1, k):
                v = v[:-1] + r[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            out.append(np.maximum(v.max(0) + self.bias[k], 0))
            at += k * FILTERS
        return np.concatenate(out)

    def logit(self, r: np.ndarray) -> float:
        return float(self.pooled(r) @ self.out) + self.base

    def language(self, r: np.ndarray) -> int:
        """The likeliest language of a text; len(langs) for a text without words."""
        return int(r[:, sum(WIDTHS) * FILTERS :].sum(0).argmax()) if len(r) and self.langs else len(self.langs)

    def score(self, r: np.ndarray) -> float:
        z = self.logit(r)
        if self.cuts is not None:
            z += np.log(THRESHOLD / (1 - THRESHOLD)) - self.cuts[self.language(r)]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(ids: list[np.ndarray], labels: np.ndarray, langs: list[str | None] | None = None, epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit on word rows and 0/1 labels; langs serve to calibrate thresholds only. With one label only, all scores are low or high."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float32)
    held = rng.random(len(ids)) < 0.2
    kept = np.flatnonzero(~held)
    ones, zeros = np.zeros(TABLE, np.float32), np.zeros(TABLE, np.float32)
    for i in kept:
        (ones if labels[i] else zeros)[np.unique(ids[i])] += 1
    n1, n0 = max(1.0, labels[kept].sum()), max(1.0, len(kept) - labels[kept].sum())
    table = rng.normal(0, 0.05, (TABLE, DIMS)).astype(np.float32)
    odds = np.log((ones + 1) / (n1 + 2)) - np.log((zeros + 1) / (n0 + 2))
    seen = ones + zeros
    table[:, 0] = np.where(seen > 1, odds, np.minimum(odds, 0)) / 3  # the first dimension begins as the word's log-odds
    table[seen == 0] = 0  # words that training doesn't know say nothing
    m = Model(table, {k: rng.normal(0, 0.2, (k, DIMS, FILTERS)).astype(np.float32) for k in WIDTHS}, {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}, rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    for k in WIDTHS:
        m.filters[k][0, 0, : FILTERS // 2] += 1
        m.out[(k - 1) * FILTERS : (k - 1) * FILTERS + FILTERS // 2] += 0.5
    m.base = -1.0
    moments: dict[str, list[np.ndarray]] = {}
    weight = np.where(labels > 0, 0.5 * len(kept) / n1, 0.5 * len(kept) / n0)
    step, size = 0, 32

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        a = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        a[0] += 0.1 * (grad - a[0])
        a[1] += 0.01 * (grad * grad - a[1])
        value -= rate * (a[0] / (1 - 0.9**step)) / (np.sqrt(a[1] / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs if n1 > 1 or n0 > 1 else 0):
        rng.shuffle(kept)
        for at in range(0, len(kept), size):
            batch, step = kept[at : at + size], step + 1
            gf = {k: np.zeros_like(m.filters[k]) for k in WIDTHS}
            gb = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
            go, gc = np.zeros_like(m.out), 0.0
            rows: list[tuple[np.ndarray, np.ndarray]] = []
            for i in batch:
                x = np.concatenate([ids[i], np.zeros((PAD, 2), np.int32)])
                e = m.table[x[:, 0]] + m.table[x[:, 1]]
                pooled, best = [], []
                for k in WIDTHS:
                    r = e @ m.filters[k][0]
                    for j in range(1, k):
                        r[:-j] += e[j:] @ m.filters[k][j]
                    top = r.argmax(0)
                    best.append(top)
                    pooled.append(np.maximum(r[top, np.arange(FILTERS)] + m.bias[k], 0))
                p = np.concatenate(pooled)
                z = float(np.clip(p @ m.out + m.base, -30, 30))
                d = (1 / (1 + np.exp(-z)) - labels[i]) * weight[i] / len(batch)
                go += d * p
                gc += d
                back = (d * m.out * (p > 0)).reshape(len(WIDTHS), FILTERS)
                for k, top, g in zip(WIDTHS, best, back):
                    gb[k] += g
                    for j in range(k):
                        spot = np.minimum(top + j, len(x) - 1)
                        inside = (top + j < len(x))[:, None]
                        gf[k][j] += (e[spot] * inside * g[:, None]).T
                        pull = m.filters[k][j].T * g[:, None] * inside
                        rows += [(x[spot, 0], pull), (x[spot, 1], pull)]
            for k in WIDTHS:
                adam(f"f{k}", m.filters[k], gf[k])
                adam(f"b{k}", m.bias[k], gb[k])
            adam("o", m.out, go)
            m.base -= rate * float(gc)
            at_rows, grads = np.concatenate([a for a, _ in rows]), np.concatenate([g for _, g in rows]).astype(np.float32)
            np.add.at(m.table, at_rows, -rate * 5 * grads)
            m.table[0] = 0
    if langs is not None:
        _calibrate(m, ids, labels, langs, held)
    return m


def _calibrate(m: Model, ids: list[np.ndarray], labels: np.ndarray, langs: list[str | None], held: np.ndarray) -> None:
    names = sorted({x for x in langs if x is not None})
    table = np.full((TABLE, max(1, len(names))), 0.1, dtype=np.float32)
    for i, x in enumerate(langs):
        if x is not None:
            np.add.at(table[:, names.index(x)], ids[i][:, 0], 1)
    m.langs, m.lang_table = names, np.log(table / table.sum(0)).astype(np.float16)
    some = np.flatnonzero(held) if held.any() else np.arange(len(ids))
    both = [(m.logit(r), m.language(r)) for r in (m.responses(ids[i]) for i in some)]
    z, lang = np.array([x for x, _ in both]), np.array([x for _, x in both])
    y = labels[some]
    whole = _cut(z, y, 0.0)
    m.cuts = np.array([_cut(z[lang == k], y[lang == k], whole) if ((lang == k) & (y > 0)).sum() >= 10 else whole for k in range(len(names))] + [whole])


def _cut(z: np.ndarray, y: np.ndarray, other: float) -> float:
    """The logit that best parts the labels, in the middle of its gap."""
    if not len(z) or not (y > 0).any() or (y > 0).all():
        return other
    order = np.argsort(-z)
    z, hit = z[order], np.cumsum(y[order] > 0)
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + hit[-1])
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 0.5)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rule: Column, most: int) -> tuple[DataFrame, int]:
    """A bounded sample of labelled rows by a hash of doc_id: (documents joined to their label as `y`, rows of labels in reach)."""
    usable = labels.where(rule & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    # at most about `most` rows of two numbers, so they go to every task and no text is shuffled
    return docs.join(F.broadcast(usable), "doc_id"), n


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    buckets = WordBuckets()
    for b in batches:
        ids = [buckets.of(t).tobytes() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["y", "lang", "ids"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rule: Column | None = None, most: int = 8_000) -> Model:
    """Train on docs(doc_id, text, lang) with labels(doc_id, <label>) that meet the rule: a sample of about `most` of them
    at most, whole texts each. Null labels are left out; no usable label gives a model that scores all texts low."""
    ship(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows, _ = training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")), labels, label, F.lit(True) if rule is None else rule, most)
    got = rows.select("y", "lang", "text").mapInArrow(_word_rows, "y int, lang string, ids binary").toPandas()
    got = got.assign(k=[zlib.crc32(bytes(x)) for x in got["ids"]]).sort_values(["k", "y"])  # the same model whatever order the rows come in
    return train([np.frombuffer(x, np.int32).reshape(-1, 2) for x in got["ids"]], (got["y"] > 0).to_numpy(dtype=np.float32), [None if x != x or x is None else x for x in got["lang"]])


def _score(batches: Iterator[pa.RecordBatch], model, group: int = 200) -> Iterator[pa.RecordBatch]:
    forget()
    m = model.value
    known = Responses(m)
    for b in batches:
        texts, score = b.column(b.num_columns - 1).to_pylist(), []
        for i in range(0, len(texts), group):
            words = [WORD.findall((t or "").lower()) for t in texts[i : i + group]]
            known.learn(set().union(*words))
            for w in words:
                score.append(m.score(known.rows[np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=len(w))]))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and score, 0 to 1, of every whole text, a row for each row; repeated texts score the same.

    Null and empty texts get the score of no words. Texts of any length are read whole, one at a time. Where a kept
    column is called score, the score is _score. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: TABLE rows
    return with_columns(docs, keep, text, {"score": "double"}, lambda b: _score(b, shared))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), rule=crc_mod("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
