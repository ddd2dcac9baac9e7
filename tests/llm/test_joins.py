"""Similarity joins and components against brute force, and on odd tables."""

import random
from fractions import Fraction

import numpy as np
import pytest

from siftmine.llm import embeddings, jaccard
from siftmine.llm.common import components


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: u.find(x) for x in list(u)}
    assert components(df.limit(0)).count() == 0


# --- documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, t=80):
    u, sets = Union(), {}
    for k, (d, text) in enumerate(docs):
        sets[k] = shingles(text)
    keys = list(sets)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= t * (len(sets[a]) + len(sets[b]) - i):
                u.join(a, b)
    least = {}
    for k in keys:
        d = docs[k][0]
        if d is not None:
            least[u.find(k)] = min(d, least.get(u.find(k), d))
    return sorted(((d, len(sets[k]), d if not sets[k] else least.get(u.find(k))) for k, (d, _) in enumerate(docs)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop")
    passage = " ".join(word() for _ in range(60))
    docs, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 120, 700]))]
        if rng.random() < 0.5:
            base += passage.split()
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 30])):
                w[rng.randrange(len(w))] = word()
            docs.append((n, rng.choice([" ", "\n", "  "]).join(w)))
            n += 1
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    docs = corpus(seed)
    docs += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One two"), (9005, "one TWO"), (9006, "É one"), (9007, "é one"), (None, docs[40][1]), (9008, docs[0][1]), (9008, docs[0][1]), (9009, "a b c d e f"), (9010, "x " * 30000)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, n long, h1 long, key long").repartition(4)
    got = sorted((tuple(r)[:3] for r in jaccard.jaccard_classes(df).collect()), key=str)
    assert got == brute(docs)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_against_the_bound():
    rng = np.random.default_rng(3)
    base = rng.poisson(4, (6, 64))
    v = np.concatenate([np.maximum(base[i % 6] + rng.integers(-1, 2, 64) * (rng.random(64) < 0.15), 0)[None] for i in range(400)]).astype(np.int64)
    sizes = v.sum(1)
    tree = jaccard.RTree(sizes, v)
    for i in range(0, 400, 7):
        want = {j for j in range(400) if jaccard.bounded(int(sizes[i]), v[i], int(sizes[j]), v[j], 80)}
        assert set(tree.within(int(sizes[i]), v[i], 80).tolist()) == want and i in want


def test_chunked_cells_give_the_same(spark, monkeypatch):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "FOREST", 4)
    monkeypatch.setattr(jaccard, "SALT", 2)
    monkeypatch.setattr(jaccard, "small", lambda t, most=0: t)  # joined by shuffles
    assert sorted((tuple(r)[:3] for r in jaccard.jaccard_classes(df, name_bits=3).collect()), key=str) == brute(docs)  # and names that agree


def test_links_through_documents_without_an_id(spark):
    """A and B link with N, not with each other."""
    w = [f"w{i}" for i in range(60)]
    a, n, b = ["x"] * 10 + w, list(w), w + ["y"] * 10
    docs = [(5, " ".join(a)), (None, " ".join(n)), (3, " ".join(b)), (None, " ".join(n)), (None, "alone " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in jaccard.jaccard_classes(df).collect()), key=str)
    assert got == brute(docs) and [r[2] for r in got if r[0] is not None] == [3, 3]
    less = [d for d in docs if d[0] is not None]
    assert {r[2] for r in brute(less)} == {3, 5}


@pytest.mark.parametrize("hot_rows", [0, 65_536])
def test_a_large_class_over_widely_shared_hashes(spark, monkeypatch, hot_rows):
    """Near copies of one text, in chunks, with and without leaders known beforehand."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for n in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"v{n}"
        docs.append((n, " ".join(w)))
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    monkeypatch.setattr(jaccard, "FOREST", 15)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r)[:3] for r in jaccard.jaccard_classes(df, hot_rows=hot_rows).collect()), key=str) == brute(docs)


def test_size_classes():
    for t in (50, 80, 95):
        n = np.arange(1, 5000)
        assert (jaccard.size_class(n * 100 // t, t) - jaccard.size_class(n, t) <= 1).all()


# --- vectors


def brute_vectors(rows, t):
    u, n = Union(), dict.fromkeys(range(len(rows)), 0)
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for x, a in enumerate(good):
        u.find(a)
        for b in good[:x]:
            p, q = ([Fraction(float(x)) for x in rows[k][1]] for k in (a, b))
            dot, square = sum(x * y for x, y in zip(p, q)), sum(x * x for x in p) * sum(y * y for y in q)
            if len(p) == len(q) and dot > 0 and dot * dot >= Fraction(t) * Fraction(t) * square:
                u.join(a, b)
                n[a] += 1
                n[b] += 1
    least = {}
    for k in good:
        least[u.find(k)] = min(rows[k][0], least.get(u.find(k), rows[k][0]))
    return sorted(((i, n[k], least[u.find(k)] if k in good else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_vectors(spark, cell_rows):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(14):
        mean = rng.normal(size=6)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), [float(x) for x in (mean + rng.normal(size=6) * 0.18).astype(np.float32)]))
    rows += [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5), (906, rows[3][1]), (906, rows[3][1]), (907, rows[3][1]), (908, [1.0, 0.0]), (909, [2.0, 0.0]), (910, [x * 1e-30 for x in rows[3][1]]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, weight int, cell int").repartition(3)
    got = embeddings.near_duplicates(df, 0.9, cell_rows=cell_rows).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_vectors(rows, "0.9")
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1


def test_vectors_at_the_threshold_and_beyond_floats(spark):
    ones = lambda *places: [1.0 if i in places else 0.0 for i in range(11)]
    rows = [(1, ones(*range(10))), (2, ones(*range(9), 10)), (3, ones(*range(8))), (4, [1e-60, 1e-60] + [0.0] * 9), (5, [2e-60, 2e-60] + [0.0] * 9), (6, [1e50] + [0.0] * 10), (7, [1e300] + [0.0] * 10), (8, [5e-320] + [0.0] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (2, 6), 7: (2, 6), 8: (2, 6)}


def test_pivots_in_two_levels():
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.normal(size=(3000, 5)))
    p = embeddings.Pivots.of(embeddings.choose_pivots(x[:1500], 600))
    assert len(p.at) == 600 and len(p.tops) > 1
    own, near = p.nearest(x)
    a = embeddings.angles(x, p.at)
    assert np.abs(near - a.min(1)).max() < 1e-6
    radius = np.array([near[own == c].max(initial=-10) for c in range(600)])
    go = set(zip(*(v.tolist() for v in p.visits(x, own, near, radius, 0.1))))
    for i in range(0, 3000, 97):
        for j in np.flatnonzero(x[i + 1 :] @ x[i] >= np.cos(0.1)) + i + 1:
            first, second = sorted((i, j), key=lambda k: own[k])
            assert own[i] == own[j] or (first, own[second]) in go
