"""Pairs by products of blocks: the rows of a plain count, and no join of rows with one another."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmine.operators import blocks, graph, itemsets, recommend, similarity


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks and tiles even of few rows."""
    for name, value in (("LEAST_PAIRS", 1), ("CELLS", 1), ("TILE", 100)):
        monkeypatch.setattr(blocks, name, value)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def held(rng, users, items, n):
    return {u: sorted(rng.sample(range(items), rng.randint(1, n))) for u in users}


def shared(sets, least):
    at = Counter()
    holders = {}
    for u, s in sets.items():
        for i in s:
            holders.setdefault(i, []).append(u)
    for us in holders.values():
        at.update(itertools.combinations(sorted(us), 2))
    return {p for p, n in at.items() if n >= least}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_overlap_graph_by_blocks(spark, small_blocks, kind):
    rng = random.Random(4)
    users = [k * 7 - 300 if kind == "long" else f"u{k}é" for k in range(600)]
    sets = held(rng, users, 30, 20)
    rows = [(u, i) for u, s in sets.items() for i in s] + [(users[0], None), (None, 3), (users[0], sets[users[0]][0])]
    e = graph.overlap_graph(spark.createDataFrame(rows, f"u {kind}, i int").repartition(3), "u", "i", 9)
    assert "Join" not in plan(e)
    want = shared(sets, 9)
    assert sorted(map(tuple, e.collect())) == sorted(want | {(b, a) for a, b in want})
    assert len(want) > 1000


def cliques(spark):
    """Two groups of users with items of their own, and one user between them."""
    sets = {u: [*range(20)] if u < 300 else [*range(30, 50)] for u in range(600)} | {600: [*range(10, 40)]}
    return spark.createDataFrame([(u, i) for u, s in sets.items() for i in s], "u long, i int")


def test_label_propagation_of_a_graph_by_blocks(spark, small_blocks):
    got = {r["id"]: r["label"] for r in graph.label_propagation(graph.overlap_graph(cliques(spark), "u", "i", 11)).collect()}
    assert sorted(got) == list(range(600))  # the last shares ten items with either group
    assert set(got.values()) <= set(range(2)) | {300, 301} and all(got[u] < 2 for u in range(300)) and all(got[u] > 2 for u in range(300, 600))


def test_modularity_of_a_graph_by_blocks(spark, small_blocks):
    e = graph.overlap_graph(cliques(spark), "u", "i", 11).localCheckpoint()
    labels = spark.range(600).select("id", (F.col("id") >= 300).cast("int").alias("label"))
    k, edges = 300 * 299, 2 * 300 * 299
    assert graph.modularity(e, labels).first()[0] == pytest.approx(2 * (k - 0.5 * k * k / edges) / (2 * edges))


@pytest.mark.parametrize("weighting", ["parents", "paths"])
def test_betweenness_by_root_as_by_joins(spark, monkeypatch, weighting):
    rng = random.Random(8)
    ends = [(f"v{a}", f"v{b}") for a in range(60) for b in range(a + 1, 60) if a // 30 == b // 30 and rng.random() < 0.1]
    e = graph.both_directions(spark.createDataFrame(ends, "a string, b string"))
    got = lambda: {(r["a"], r["b"]): r["value"] for r in graph.betweenness(e, weighting).collect()}
    found = got()
    monkeypatch.setattr(graph, "SENT_EDGES", 0)
    assert found == pytest.approx(got()) and len(found) == len(ends)


def test_communities_of_a_graph_by_blocks(spark, small_blocks):
    e = graph.overlap_graph(cliques(spark), "u", "i", 10)
    found = graph.communities(e).collect()
    assert sorted(x for r in found for x in r["members"]) == list(range(601)) and sorted(len(r["members"]) for r in found) == [300, 301]


def rated(spark, rng):
    rows = [(f"u{u:03}", i, float(rng.randint(1, 5))) for u, s in held(rng, range(560), 25, 18).items() for i in s]
    return spark.createDataFrame(rows + [("u900", k, 3.0) for k in range(5)] + [(f"v{c}", k, float(1 + k % 5)) for c in range(40) for k in range(8)], "u string, i int, stars double")


def test_user_cf_by_blocks_as_by_join(spark, small_blocks, monkeypatch):
    rng = random.Random(2)
    train = rated(spark, rng).localCheckpoint()
    near = lambda: {(r["id"], r["other"]): r["s"] for r in recommend.neighbours(train, "u", "i", 3).collect()}
    assert "Join" not in plan(similarity.most_correlated(train, "u", "i", "stars", 3))
    found = near()
    monkeypatch.setattr(blocks, "LEAST_PAIRS", 1 << 60)
    assert found == near() and len(found) > 1700


def test_correlations_by_blocks_as_by_join(spark, small_blocks, monkeypatch):
    r = rated(spark, random.Random(6))
    r = r.union(r.limit(50)).localCheckpoint()  # repeated ratings count as often as they come
    got = lambda: sorted(map(tuple, similarity.correlations(r, "u", "i", "stars").collect()))
    assert "Join" not in plan(similarity.correlations(r, "u", "i", "stars"))
    found = got()
    odd = r.union(spark.createDataFrame([("u001", 99, None), ("u002", 99, float("nan"))], r.schema))
    assert similarity.rating_cells(odd.select(F.col("u").alias("o"), F.col("i").alias("b"), F.col("stars").alias("v")))[1] is None
    monkeypatch.setattr(blocks, "LEAST_PAIRS", 1 << 60)
    assert found == got()


def test_equal_users_are_correlated_once(spark, small_blocks, monkeypatch):
    """The kernel that goes through single users isn't needed."""
    monkeypatch.setattr(blocks, "pearson", None)
    r = spark.createDataFrame([(u + 4 * k, i, float(1 + (u * i) % 5)) for k in range(5) for u in range(4) for i in range(9)], "u long, i long, stars double")
    got = {(a, b): s for a, b, s in similarity.correlations(r, "u", "i", "stars").collect()}
    assert sorted(got) == list(itertools.combinations(range(20), 2)) and all(got[a, b] == got[min(a % 4, b % 4), max(a % 4, b % 4) + 4 * (a % 4 == b % 4)] for a, b in got)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_correlations_of_equal_rows(spark, small_blocks, monkeypatch, kind):
    """Those of equal users are counted once, and every pair of users comes out."""
    monkeypatch.setattr(blocks, "MEMBERS", 25, raising=False)
    rng = random.Random(5)
    base = [(u, i, float(rng.randint(1, 5))) for u in range(12) for i in range(15) if rng.random() < 0.4]
    name = (lambda u: u) if kind == "long" else (lambda u: f"é{u}")
    rows = [(name(u + 12 * k), i, v) for k in range(1, 6) for u, i, v in base]
    r = spark.createDataFrame(rows, f"u {kind}, i long, stars double")
    got = lambda: sorted(map(tuple, similarity.correlations(r, "u", "i", "stars", digits=6).collect()))
    by_class = got()
    monkeypatch.setattr(blocks, "LEAST_PAIRS", 1 << 60)
    assert by_class == got() and len(by_class) > 1000


def test_itemsets_by_item_as_by_basket(spark, small_blocks, monkeypatch):
    sets = held(random.Random(9), range(520), 40, 30)
    rows = [(b, u) for u, s in sets.items() for b in s] + [(b, 900 + k) for b in range(25) for k in range(5)]
    pairs = itemsets.baskets(spark.createDataFrame(rows, "b int, u long"), "b", "u").localCheckpoint()
    monkeypatch.setattr(itemsets, "by_basket", None)
    got = lambda: {tuple(r["items"]): r["n"] for r in itemsets.frequent(pairs, 20).collect()}
    found = got()
    monkeypatch.undo()
    assert found == got() and found[(900, 901, 902, 903, 904)] == 25


@pytest.mark.parametrize("most", [None, 1, 2, 4])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_frequent_sets_of_equal_items(spark, small_blocks, monkeypatch, kind, most):
    """Items of the same baskets are taken together; their sets come out all the same, by chunks of subsets too."""
    rng = random.Random(6)
    own = [sorted(rng.sample(range(40), 22)) for _ in range(8)]
    name = (lambda k: k * 3 - 20) if kind == "long" else (lambda k: f"i{k}")
    holds = {name(k): own[k % 8 if k < 16 else k % 2] for k in range(22)}  # classes of up to five
    pairs = spark.createDataFrame([(b, i) for i, bs in holds.items() for b in bs], f"basket int, item {kind}")
    want = sorted((tuple(r["items"]), r["n"]) for r in itemsets.by_basket(itemsets.weighed(pairs), 12, most).collect())
    size = (22, 40)
    seen = []
    spread = itemsets.spread_out
    monkeypatch.setattr(itemsets, "spread_out", lambda *a: seen.append(a[2]) or spread(*a))
    for chunk in (8, 2):
        monkeypatch.setattr(itemsets, "CHUNK", chunk)
        got = [(tuple(r["items"]), r["n"]) for r in itemsets.by_item(pairs, 12, most, size).collect()]
        assert sorted(got) == want and seen
    if most is None:
        assert max(len(x) for x, _ in want) > 6
