"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed surface features: the shape of every space-separated token (letters folded to their case,
digits to 0, runs shortened), pairs of shapes that follow one another, how far back a token last occurred, and, with a
smaller weight, the word itself. Bags are weighted by TF-IDF and projected on the leading singular vectors of the
labelled sample. Every document is compared with every labelled vector by exact cosine, block by block, and its
nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept, ship, with_columns
from .toxicity import training_rows

SHAPES, PAIRS, REPEATS, WORDS = 1024, 2048, 8, 1024
FEATURES = SHAPES + PAIRS + REPEATS + WORDS
WORD_WEIGHT = 0.3
THRESHOLD = 0.7
RUNS = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Case and kind of the characters, runs of the same kind once and of the same other character twice at most."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return RUNS.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)


class Tokens(dict):
    """Token -> word hash * SHAPES + shape bucket. Emptied beyond `most` tokens."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[token] = out = zlib.crc32(token.encode("utf-8", "surrogatepass")) * SHAPES + zlib.crc32(shape(token).encode("utf-8", "surrogatepass")) % SHAPES
        return out

    def bag(self, text: str | None) -> np.ndarray:
        """Counts of the features."""
        tokens = (text or "").split()
        codes = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        out = np.zeros(FEATURES, dtype=np.float32)
        if not len(codes):
            return out
        shapes, words = codes % SHAPES, codes // SHAPES
        out[:SHAPES] = np.bincount(shapes, minlength=SHAPES)
        out[SHAPES : SHAPES + PAIRS] = np.bincount((shapes[:-1] * 31 + shapes[1:] * 17 + 7) * 2654435761 % (1 << 32) % PAIRS, minlength=PAIRS)
        for k in range(1, REPEATS):
            if len(words) > k:
                out[SHAPES + PAIRS + k] = np.count_nonzero(words[k:] == words[:-k])
        out[-WORDS:] = np.bincount(words % WORDS, minlength=WORDS)
        return out


def known_tokens() -> Tokens:
    return kept("tokens", Tokens)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # FEATURES x dims
    vectors: np.ndarray  # labelled texts x dims, of length 1
    labels: np.ndarray
    neighbours: int

    def project(self, bags: np.ndarray) -> np.ndarray:
        return _unit(_weigh(bags, self.idf) @ self.basis)

    def scores(self, bags: np.ndarray) -> np.ndarray:
        """Share of the neighbours' similarity that is of label 1; without similar neighbours, the share of label 1."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(bags), prior)
        sims = self.project(bags) @ self.vectors.T
        k = min(self.neighbours, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** 4
        total = w.sum(1)
        return np.where(total > 1e-9, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-9), prior)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _weigh(bags: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF-IDF by kind of feature, each kind of length 1, words by their smaller weight."""
    size = np.maximum(bags[:, :SHAPES].sum(1, keepdims=True), 1)
    x = np.log1p(bags * (100 / size)) * idf
    ends = np.cumsum([0, SHAPES, PAIRS, REPEATS, WORDS])
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        x[:, a:b] = x[:, a:b] / 5 if k == 2 else _unit(x[:, a:b]) * (WORD_WEIGHT if k == 3 else 1)
    return _unit(x)


def train(bags: np.ndarray, labels: np.ndarray, dims: int = 48, neighbours: int = 31) -> Model:
    """Latent vectors of labelled bags, by subspace iteration for the leading singular vectors."""
    seen = (bags > 0).sum(0)
    idf = np.log((1 + len(bags)) / (1 + seen)).astype(np.float32) + 1
    x = _weigh(bags, idf)
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(FEATURES, dims + 16)))[0].astype(np.float32)
    for _ in range(8):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    values, turn = np.linalg.eigh((x @ basis).T @ (x @ basis))
    basis = np.ascontiguousarray((basis @ turn)[:, np.argsort(-values)[:dims]]).astype(np.float32)
    return Model(idf, basis, _unit(x @ basis), np.asarray(labels, np.float32), neighbours)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = known_tokens()
    for b in batches:
        texts = b.column(1).to_pylist()
        for i in range(0, len(texts), 500):
            bags = [tokens.bag(t) for t in texts[i : i + 500]]
            spots = [np.flatnonzero(x).astype(np.int32) for x in bags]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(bags)), pa.array([s.tobytes() for s in spots], pa.binary()), pa.array([x[s].tobytes() for x, s in zip(bags, spots)], pa.binary())], names=["y", "spots", "counts"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rule: Column | None = None, most: int = 4000) -> Model:
    """The labelled vectors of docs(doc_id, text): a sample of about `most` rows of labels at most that meet the rule.

    Null labels are left out. Without a usable label every text scores 0.5.
    """
    ship(docs.sparkSession)
    rows, _ = training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, label, F.lit(True) if rule is None else rule, most)
    got = rows.select("y", "text").mapInArrow(_bags, "y int, spots binary, counts binary").toPandas()
    got = got.assign(k=[zlib.crc32(bytes(a) + bytes(b)) for a, b in zip(got["spots"], got["counts"])]).sort_values(["k", "y"])
    bags = np.zeros((len(got), FEATURES), np.float32)
    for row, s, c in zip(bags, got["spots"], got["counts"]):
        row[np.frombuffer(s, np.int32)] = np.frombuffer(c, np.float32)
    if not len(bags):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 1)
    return train(bags, (got["y"] > 0).to_numpy())


def _score(batches: Iterator[pa.RecordBatch], model, block: int = 400) -> Iterator[pa.RecordBatch]:
    m, tokens = model.value, known_tokens()
    for b in batches:
        texts, out = b.column(b.num_columns - 1).to_pylist(), []
        for i in range(0, len(texts), block):
            out.append(m.scores(np.stack([tokens.bag(t) for t in texts[i : i + block]])))
        score = np.concatenate(out) if out else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score.astype(np.float64), pa.float64())], names=[*b.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and score, 0 to 1, of every whole text, a row for each row; repeated texts score the same.

    Null and empty texts get the share of label 1. Of labelled vectors that are equally similar at the edge of the
    neighbourhood any may vote. Texts of any length are read whole, one at a time. Where a kept column is called score,
    the score is _score. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of labelled rows that fit() keeps
    return with_columns(docs, keep, text, {"score": "double"}, lambda b: _score(b, shared))


def op8_quality_votes(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), rule=crc_mod("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
