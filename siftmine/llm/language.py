"""Language identification: every document as a mixture of languages.

The units of a document are its words; a word's likelihood in a language is that of its letter trigrams there,
learned from documents of known language. Expectation-maximisation finds the shares of the languages among the words,
first with all languages, then with fewer: those that claim less than half a word leave together, the others one by
one, the least likely first, while the likelihood less a penalty for each language (half the logarithm of the number of
words, times PENALTY) grows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ship, with_columns

WORD = re.compile(r"[^\W\d_]+")
TABLE = 1 << 16
PENALTY = 4.0
STEPS = 25
FLAT = 0.7  # n-grams of a word overlap, so their log-likelihoods count in part


def grams(word: str) -> list[int]:
    """Rows of the hashed table: the trigrams of the word between its edges, and the word itself."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(w[i : i + 3]) % TABLE for i in range(len(w) - 2)] + [zlib.crc32(w) % TABLE]


@dataclass
class Model:
    """Log-likelihoods of n-grams: by language what an unseen n-gram has, and by n-gram (as rows of a sparse table) what a seen one has more."""

    langs: list[str]
    unseen: np.ndarray
    starts: np.ndarray  # TABLE + 1
    lang: np.ndarray
    more: np.ndarray

    def sums(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over the n-grams of each word: words x langs."""
        k = len(self.langs)
        n = self.starts[flat + 1] - self.starts[flat]
        at = np.repeat(self.starts[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n)
        seen = np.bincount(word * k + self.lang[at], weights=self.more[at], minlength=len(sizes) * k).reshape(-1, k)
        return (seen + sizes[:, None] * self.unseen).astype(np.float32)


CELLS = 1 << 24  # log-likelihoods that are held at once


class Likelihoods(dict):
    """Word -> place of its log-likelihoods in `rows`. Emptied beyond `most` words, fewer with many languages."""

    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, max(1, min(most, CELLS // max(1, len(model.langs))))
        self.rows = np.zeros((self.most + 1, len(model.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
            if len(new) > self.most:
                self.most = len(new)
                self.rows = np.zeros((self.most + 1, len(self.model.langs)), np.float32)
        if not new:
            return
        g = [grams(w) for w in new]
        sizes = np.array([len(x) for x in g])
        flat = np.fromiter((i for x in g for i in x), dtype=np.int64, count=int(sizes.sum()))
        sums = self.model.sums(flat, sizes) * FLAT
        first = len(self)
        self.rows[first : first + len(new)] = sums
        self.update(zip(new, range(first, first + len(new))))


def mixtures(counts: np.ndarray, rows: np.ndarray, doc: np.ndarray, docs: int, penalty: float = PENALTY) -> np.ndarray:
    """Shares of the languages in each document (docs x langs); rows: log-likelihoods of its words, doc: whose they are, in order, each document with one word at least."""
    k = rows.shape[1]
    starts = np.searchsorted(doc, np.arange(docs))
    likely = np.exp(np.maximum(rows - rows.max(1, keepdims=True), -60))
    weight = counts[:, None].astype(np.float64)
    size = np.add.reduceat(counts, starts).astype(np.float64)

    def em(active: np.ndarray, share: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and penalised log-likelihoods (less what all sets have in common) of the documents `of`."""
        pick = np.isin(doc, of) if len(of) < docs else slice(None)
        d, lk, wt = doc[pick], likely[pick], weight[pick]
        at = np.searchsorted(of, d)
        first = np.searchsorted(at, np.arange(len(of)))
        p = share * active
        p = p / p.sum(1, keepdims=True)
        for _ in range(STEPS):
            r = lk * p[at]
            r *= wt / np.maximum(r.sum(1, keepdims=True), 1e-300)
            new = np.add.reduceat(r, first, axis=0) / size[of][:, None]
            moved = np.abs(new - p).max()
            p = new
            if moved < 1e-4:
                break
        ll = np.add.reduceat(wt[:, 0] * np.log(np.maximum((lk * p[at]).sum(1), 1e-300)), first)
        return p, ll - penalty * 0.5 * np.log(size[of] + 1) * active.sum(1)

    best = np.zeros((docs, k))
    active = np.ones((docs, k), bool)
    everyone = np.arange(docs)
    best, value = em(active, np.full((docs, k), 1.0 / k), everyone)
    # what claims less than half a word goes at once
    trial = best * size[:, None] >= 0.5
    going = np.flatnonzero(trial.any(1) & ~trial.all(1))
    if len(going):
        p, v = em(trial[going], np.maximum(best[going], 1e-3), going)
        better = v >= value[going]
        won = going[better]
        best[won], value[won], active[won] = p[better], v[better], trial[won]
    going = everyone[active.sum(1) > 1]
    for _ in range(k - 1):
        if not len(going):
            break
        # what each language alone can claim: the next to go has the smallest share
        share = np.where(active[going], best[going], 2.0)
        gone = share.argmin(1)
        trial = active[going].copy()
        trial[np.arange(len(going)), gone] = False
        p, v = em(trial, np.maximum(best[going], 1e-3), going)
        better = v >= value[going]
        won = going[better]
        best[won], value[won], active[won] = p[better], v[better], trial[better]
        going = won[active[won].sum(1) > 1]
    return best


def train(gram: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: list[str], smooth: float = 0.2) -> Model:
    """Of counts n by n-gram and place in langs, none twice."""
    order = np.lexsort((lang, gram))
    gram, lang, n = gram[order], lang[order], n[order].astype(np.float64)
    total = np.bincount(lang, weights=n, minlength=len(langs)) + smooth * TABLE
    return Model(langs, np.log(smooth / total), np.searchsorted(gram, np.arange(TABLE + 1)), lang, np.log((n + smooth) / smooth))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        for lang, seen in words.items():
            table = np.zeros(TABLE)
            for w, n in seen.items():
                for g in grams(w):
                    table[g] += n
            spots = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(spots), pa.string()), "gram": spots.astype(np.int64), "n": table[spots]})
        words = {}


def fit(docs: DataFrame, rule: Column | None = None, most: int = 20_000) -> Model:
    """Learn from docs(doc_id, text, lang) that meet the rule and have a language: whole texts of about `most` documents,
    by a hash of doc_id as many of each language as of another, and of each language, however rare, the least hash.

    Null texts count as empty; without any usable row no language is learned. The driver gets the n-gram counts of that
    sample."""
    ship(docs.sparkSession)
    known = docs.where((F.lit(True) if rule is None else rule) & F.col("lang").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(78)), F.lit(1 << 30)).alias("h"))
    langs = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).toPandas()  # a row for each language
    if not len(langs):
        return train(*[np.zeros(0, np.int64)] * 3, [])
    each = max(1, most // len(langs))
    langs["until"] = np.maximum((np.minimum(1.0, each / langs["n"]) * (1 << 30)).astype("int64"), langs["first"] + 1)
    until = F.broadcast(docs.sparkSession.createDataFrame(langs[["lang", "until"]], "lang string, until long"))
    chosen = known.join(until, "lang").where("h < until").select("lang", "text")
    got = chosen.mapInArrow(_counted, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(langs["lang"])
    place = {x: i for i, x in enumerate(names)}
    return train(got["gram"].to_numpy(dtype=np.int64), np.array([place[x] for x in got["lang"]], np.int64), got["n"].to_numpy(), names)


def _identify(batches: Iterator[pa.RecordBatch], shared, penalty: float, group: int = 300) -> Iterator[pa.RecordBatch]:
    model = shared.value
    known = Likelihoods(model)
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        pred: list[str | None] = []
        score: list[float] = []
        mix: list[list[tuple[str, float]]] = []
        group = max(1, min(group, CELLS // (1000 * max(1, len(model.langs)))))
        for i in range(0, len(texts), group):
            bags = [Counter(WORD.findall((t or "").lower())) for t in texts[i : i + group]]
            bags = [x if any(c.isalpha() for w in x for c in w) else None for x in bags]  # numerals alone are no words
            full = [j for j, x in enumerate(bags) if x]
            shares = np.zeros((len(bags), len(model.langs)))
            if full and model.langs:
                known.learn(set().union(*(bags[j] for j in full)))
                doc = np.repeat(np.arange(len(full)), [len(bags[j]) for j in full])
                counts = np.fromiter((n for j in full for n in bags[j].values()), dtype=np.float64, count=len(doc))
                place = np.fromiter((known[w] for j in full for w in bags[j]), dtype=np.int64, count=len(doc))
                shares[full] = mixtures(counts, known.rows[place], doc, len(full), penalty)
            for x, bag in zip(shares, bags):
                if bag and model.langs:
                    k = int(x.argmax())
                    pred.append(model.langs[k])
                    score.append(min(1.0, float(x[k])))
                    mix.append([(model.langs[j], float(x[j])) for j in np.argsort(-x, kind="stable") if x[j] >= 1e-3])
                else:
                    pred.append("und")
                    score.append(0.0)
                    mix.append([])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        listed = pa.array([[{"lang": q, "share": v} for q, v in m] for m in mix], kind)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), listed], names=[*b.schema.names[:-1], "lang_pred", "score", "languages"])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The kept columns, lang_pred (the language of the largest share), score (that share) and languages (all of the
    chosen set with their shares, largest first) of every whole text, a row for each row.

    A text that is null or has no letter is `und`, 0, and so is any if no language was learned. Of equal shares the
    language first in the alphabet wins. Repeated texts give the same. Texts of any length are read whole. Added columns
    whose names kept ones have get underscores before them. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows that fit() learns from
    return with_columns(docs, keep, text, {"lang_pred": "string", "score": "double", "languages": "array<struct<lang: string, share: double>>"}, lambda b: _identify(b, shared, penalty))


def op2_language_mixture(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages of every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, rule=crc_mod("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
