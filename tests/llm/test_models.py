"""Classifiers and language mixtures: held-out accuracy on the driver's tables, and odd tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmine.llm import language, quality, toxicity
from siftmine.llm.common import crc_mod, table

SF = "/root/testdata/sf0.1"
ODD = [(1, "", "a"), (2, None, "a"), (3, " \n\n ", None), (None, "no id here", "b"), (5, "same text", "b"), (5, "same text", "b"), (7, "word " * 60000, "a"), (8, "123 456 ½", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 1) for r in ODD], "doc_id long, text string, lang string, score double, y int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.mark.parametrize("module, label, rest, kinds", [(toxicity, "toxic", (3, 1), (0.85, 0.98)), (quality, "quality", (4, 2), (0.97, 0.9))])
def test_held_out(spark, docs, module, label, rest, kinds):
    labels = table(spark, SF, "labels")
    model = module.fit(docs, labels, rule=crc_mod("doc_id", rest[0]) != rest[1])
    got = module.score(docs, model).join(labels, "doc_id").where(crc_mod("doc_id", rest[0]) == rest[1]).select("score", F.col(label).alias("y")).toPandas()
    hit = got["score"] >= 0.7
    assert hit[got["y"] == 1].mean() > kinds[0] and (~hit)[got["y"] == 0].mean() > kinds[1]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_tables(spark, docs, odd, module, label):
    labels = table(spark, SF, "labels")
    model = module.fit(docs, labels)
    for df in (odd, odd.limit(0)):
        got = module.score(df, model, keep=("doc_id", "y")).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in module.score(odd, model).where("doc_id = 5").collect()]
    assert same[0] == same[1]
    none = module.fit(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in module.score(odd, none).collect())
    bad = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (5, 1)], f"doc_id long, {label} int")
    assert module.score(odd, module.fit(odd, bad)).count() == len(ODD)


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(1)
    bags = rng.poisson(0.05, (300, quality.FEATURES)).astype(np.float32)
    m = quality.train(bags, rng.integers(0, 2, 300))
    got = m.scores(bags[:20])
    for x, s in zip(bags[:20], got):
        sims = m.vectors @ m.project(x[None])[0]
        near = np.argsort(-sims)[: m.neighbours]
        w = np.maximum(sims[near], 0).astype(float) ** 4
        assert s == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-3)


def test_language(spark, docs, odd):
    model = language.fit(docs, rule=crc_mod("doc_id", 4) != 2)
    got = language.identify(docs, model, keep=("doc_id", "lang")).where(crc_mod("doc_id", 4) == 2).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    rows = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 and rows[k]["languages"] == [] for k in (1, 2, 3, 8))
    assert language.identify(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_mixture_of_two(spark, docs):
    model = language.fit(docs)
    en, de = (docs.where(f"lang = '{q}' and length(text) > 1500").orderBy("doc_id").first()["text"] for q in ("en", "de"))
    half = spark.createDataFrame([(1, en[:1500] + "\n" + de[:1500]), (2, en)], "doc_id long, text string")
    got = {r["doc_id"]: {x["lang"]: x["share"] for x in r["languages"]} for r in language.identify(half, model).collect()}
    assert set(got[1]) == {"en", "de"} and 0.3 < got[1]["en"] < 0.7 and set(got[2]) == {"en"}


def test_em_against_single_words():
    # two words, each certain of its language: shares follow the counts
    rows = np.array([[0.0, -50.0], [-50.0, 0.0]], np.float32)
    got = language.mixtures(np.array([3.0, 1.0]) * 100, rows, np.array([0, 0]), 1)
    assert got[0] == pytest.approx([0.75, 0.25], abs=1e-3)
    # one word of the other language doesn't pay for a language of its own
    got = language.mixtures(np.array([300.0, 1.0]), np.array([[0.0, -2.0], [-1.0, 0.0]], np.float32), np.array([0, 0]), 1)
    assert got[0] == pytest.approx([1, 0])


def test_sets_against_all_of_them():
    """The chosen set of languages has, of all sets, the best penalised likelihood or next to it."""
    rng = np.random.default_rng(5)
    for trial in range(25):
        words = int(rng.integers(3, 60))
        counts = rng.integers(1, 4, words).astype(float)
        rows = rng.normal(0, 0.3, (words, 4)) - 3
        for w in range(words):
            rows[w, [0, 2][w % 2] if trial % 2 else 1] += 2.5
        got = language.mixtures(counts, rows.astype(np.float32), np.zeros(words, int), 1)[0]

        def value(langs):
            p = np.full(len(langs), 1 / len(langs))
            like = np.exp(rows[:, langs])
            for _ in range(400):
                r = like * p
                p = (r / r.sum(1, keepdims=True) * counts[:, None]).sum(0) / counts.sum()
            return (counts * np.log((like * p).sum(1))).sum() - language.PENALTY * 0.5 * np.log(counts.sum() + 1) * len(langs)

        sets = [list(s) for k in range(1, 5) for s in itertools.combinations(range(4), k)]
        assert value(list(np.flatnonzero(got > 1e-9))) >= max(map(value, sets)) - 0.5


def test_more_languages_than_documents_are_learned_from(spark):
    """However rare, each is learned."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) * 2
    rows = [(i, f"{word(i * 7919)} {word(i * 104729 + 5)} " * 3, f"l{i:03d}") for i in range(600)] + [(1000 + i, "the common words of all " * 2, "l000") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, most=50)
    assert len(model.langs) == 600
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df.where("doc_id between 1 and 599"), model).collect()}
    assert sum(got[i] == f"l{i:03d}" for i in got) > 0.97 * len(got)
