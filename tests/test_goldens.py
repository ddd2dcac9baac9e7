"""Results worked out by hand or by an independent model."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftmine.functions import scalar
from siftmine.operators import cluster, graph, itemsets, recommend, similarity, sketches

EDGES = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]


def both(spark, pairs):
    return graph.both_directions(spark.createDataFrame(pairs, "a string, b string"))


def test_betweenness(spark):
    got = {(r["a"], r["b"]): r["value"] for r in graph.betweenness(both(spark, EDGES)).collect()}
    assert got == pytest.approx({("c", "d"): 9, ("a", "c"): 4, ("b", "c"): 4, ("d", "e"): 4, ("d", "f"): 4, ("a", "b"): 1, ("e", "f"): 1})


@pytest.mark.parametrize("weighting, tip, side", [("parents", 4.8333, 4.0833), ("paths", 4.6667, 4.1667)])
def test_equal_split_or_paths(spark, weighting, tip, side):
    pairs = [("r", "a"), ("r", "b"), ("r", "c"), ("a", "p"), ("b", "p"), ("c", "q"), ("p", "t"), ("q", "t")]
    got = {(r["a"], r["b"]): r["value"] for r in graph.betweenness(both(spark, pairs), weighting).collect()}
    assert got[("c", "q")] == pytest.approx(tip, abs=1e-4) and got[("q", "t")] == pytest.approx(tip, abs=1e-4)
    assert all(got[e] == pytest.approx(side, abs=1e-4) for e in [("a", "r"), ("b", "r"), ("a", "p"), ("b", "p")])
    assert sum(got.values()) == pytest.approx(38)


def test_communities_and_modularity(spark):
    e = both(spark, EDGES)
    assert [r["members"] for r in graph.communities(e).collect()] == [["a", "b", "c"], ["d", "e", "f"]]
    q = lambda groups: graph.modularity(e, spark.createDataFrame([(x, k) for k, g in enumerate(groups) for x in g], "id string, label int")).first()[0]
    assert q(["abcdef"]) == pytest.approx(0.25)
    assert q(["abc", "def"]) == pytest.approx(0.3035714286)
    assert q(["a", "bc", "def"]) == pytest.approx(0.1862244898)


def test_girvan_newman_against_forward_model():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(3, 9)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.45]
        if not pairs:
            continue
        rng.shuffle(pairs)
        nodes = sorted({x for p in pairs for x in p})
        e, k = 2 * len(pairs), {v: sum(v in p for p in pairs) for v in nodes}
        full = {frozenset(p) for p in pairs}

        def parts(left):
            root = {v: v for v in nodes}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in left:
                root[find(a)] = find(b)
            out = {}
            for v in nodes:
                out.setdefault(find(v), []).append(v)
            return sorted((sorted(m) for m in out.values()), key=lambda m: (len(m), m))

        value = lambda ps: sum((frozenset((i, j)) in full) - 0.5 * k[i] * k[j] / e for m in ps for i in m for j in m) / (2 * e)  # noqa: B023, E731
        best, found, last = 0.25, parts(pairs), parts(pairs)
        for cut in range(1, len(pairs) + 1):
            now = parts(pairs[cut:])
            if now != last:
                last = now
                if value(now) > best + 1e-12:
                    best, found = value(now), now
        assert graph.girvan_newman(pairs) == (found, pytest.approx(best))


def test_components_and_labels(spark):
    e = both(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    assert {r["id"]: r["component"] for r in graph.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chain = graph.both_directions(spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}
    assert {r["id"] for r in graph.label_propagation(e).collect()} == set("abcxy")


def test_user_and_item_cf(spark):
    rows = [(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 2.0), (2, 3, 5.0), (3, 1, 1.0), (3, 2, 5.0), (3, 3, 2.0)]
    train = spark.createDataFrame(rows, "u long, i long, stars double")
    sims = {(r["id1"], r["id2"]): r["similarity"] for r in similarity.correlations(train, "u", "i", "stars").collect()}
    assert sims[(1, 2)] == pytest.approx(1) and sims[(1, 3)] == pytest.approx(-1)
    test = spark.createDataFrame([(1, 3), (9, 1), (1, 9)], "u long, i long")
    user = {(r["u"], r["i"]): r["prediction"] for r in recommend.user_cf(train, test).collect()}
    assert user[(1, 3)] == pytest.approx(5) and user[(9, 1)] == 3 and user[(1, 9)] == pytest.approx(4)
    item = {(r["u"], r["i"]): r["prediction"] for r in recommend.item_cf(train, test).collect()}
    assert item[(1, 3)] == pytest.approx(1) and item[(1, 9)] == 3
    als = {(r["u"], r["i"]): r["prediction"] for r in recommend.als(train, test).collect()}
    assert als[(9, 1)] == 3 and all(1 <= v <= 5 for v in als.values())


def test_trailing_zeros_and_big_numbers(spark):
    zeros = [r[0] for r in spark.createDataFrame([(x,) for x in (0, 1, 8, 12, 128)], "h long").select(scalar.trailing_zeros(F.col("h"))).collect()]
    assert zeros == [1, 0, 3, 2, 7]
    names = ["Las Vegas", "Montréal", "a", "São Paulo de Olivença", "東京"]
    got = {r["s"]: r["h"] for r in spark.createDataFrame([(s,) for s in names], "s string").select("s", scalar.big_affine_hash(F.col("s"), 1069, 457, 163, 200).alias("h")).collect()}
    assert got == {s: ((1069 * int(s.encode().hex(), 16) + 457) % 163) % 200 for s in names}
    assert spark.createDataFrame([("",)], "s string").select(scalar.bytes_mod(F.col("s"), 7)).first()[0] == 0


def test_itemsets(spark):
    pairs = itemsets.baskets(spark.createDataFrame([(b, i) for b, items in enumerate(["abc", "ab", "ac", "b"]) for i in items] + [(0, "a"), (None, "a"), (1, None)], "b int, i string"), "b", "i")
    want = {("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("a", "c"): 2}
    got = lambda df: {tuple(r["items"]): r["n"] for r in df.collect()}
    assert got(itemsets.frequent(pairs, 2)) == want == got(itemsets.fp_growth(pairs, 2)) == got(itemsets.son(pairs, 2)[1])
    assert {tuple(r["items"]) for r in itemsets.son(pairs, 2)[0].collect()} >= set(want)
    assert got(itemsets.frequent(itemsets.baskets(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "b int, i string"), "b", "i", larger_than=1), 1)) == {("a",): 1, ("b",): 1, ("a", "b"): 1}


def test_itemsets_of_any_size(spark):
    pairs = spark.createDataFrame([(b, i) for b in range(2) for i in range(9)], "basket int, item int")
    got = {tuple(r["items"]): r["n"] for r in itemsets.frequent(pairs, 2).collect()}
    assert got == {c: 2 for k in range(1, 10) for c in itertools.combinations(range(9), k)}


def test_bloom_against_sequence(spark):
    rng = random.Random(3)
    stream = [(k, f"city{rng.randint(0, 90)}", k // 50) for k in range(300)]
    bits, seen, fp, tn, want = set(), set(), 0, 0, {}
    for _, city, day in stream:
        x = int(city.encode().hex(), 16)
        mine = {((a * x + b) % p) % 200 for a, b, p in sketches.BLOOM}
        if city not in seen:
            fp, tn = (fp + 1, tn) if mine <= bits else (fp, tn + 1)
        bits |= mine
        seen.add(city)
        want[day] = (fp, tn)
    df = spark.createDataFrame(stream, "seq long, city string, day int")
    assert {r["batch"]: (r["fp"], r["tn"]) for r in sketches.bloom_fpr(df, "seq", "city", "day").collect()} == want


def test_reservoir_against_list(spark):
    sample = []
    for n in range(1, 3001):
        if n <= 100:
            sample.append(n)
        else:
            r = ((n * 1103515245 + 42 * 12345) % 2147483648) % n + 1
            if r < 100:
                sample.pop(r)
                sample.append(n)
    got = sketches.reservoir(spark.range(3000), "id").orderBy("place").collect()
    assert [r["n"] for r in got] == sample
    few = sketches.reservoir(spark.range(5), "id").collect()
    assert sorted(r["n"] for r in few) == [1, 2, 3, 4, 5]


def test_bfr(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(8 * (i % 3), 1), rng.gauss(5 * (i % 3), 1)]) for i in range(101)]
    points = spark.createDataFrame(data, "id long, features array<double>")
    for mode in ("batched", "sequential"):
        rounds, clusters = cluster.bfr(points, 3, mode=mode)
        rows = sorted(map(tuple, rounds.collect()))
        assert len(rows) == 6  # one more round for the single point left over
        assert [r[1] + r[3] + r[4] for r in rows] == [20, 40, 60, 80, 100, 101]
        assert clusters.count() == 101
    rounds, clusters = cluster.bfr(points.limit(0), 3)
    assert rounds.count() == clusters.count() == 0
    rounds, clusters = cluster.bfr(points.limit(2), 3)
    assert clusters.count() == 2


def test_bfr_with_two_points_set_aside(spark):
    """They make one compressed cluster."""
    data = [(i, [50.0 * (i % 5), 50.0 * (i % 5)]) for i in range(510)]
    data[3], data[7] = (3, [9000.0, 0.0]), (7, [0.0, 9000.0])
    rounds, clusters = cluster.bfr(spark.createDataFrame(data, "id long, features array<double>"), 2)
    first = min(map(tuple, rounds.collect()))
    assert first == (1, 100, 1, 2, 0) and clusters.count() == 510
    one = cluster._kmeans(spark.createDataFrame(data[:9], "id long, features array<double>"), 1)
    assert {r["cluster"] for r in one.collect()} == {0}


def test_minhash_candidates_hold_no_false_pairs(spark):
    rows = [(s, w) for s, words in (("x", "a b c d e f"), ("y", "a b c d e g"), ("z", "p q r")) for w in words.split()]
    df = spark.createDataFrame(rows, "s string, w string")
    got = {(r["id1"], r["id2"]): r["similarity"] for r in similarity.similar_pairs(df, "s", "w").collect()}
    assert got in ({("x", "y"): pytest.approx(5 / 7)}, {})


def test_bfr_clusters_with_two_points_set_aside(spark):
    data = [(i, [50.0 * (i % 5), 50.0 * (i % 5)]) for i in range(510)]
    data[3], data[7] = (3, [9000.0, 0.0]), (7, [0.0, 9000.0])
    found = {r["id"]: r["cluster"] for r in cluster.bfr(spark.createDataFrame(data, "id long, features array<double>"), 2)[1].collect()}
    assert found[3] == found[7] == -1 and len(found) == 510


def test_son_counts_equal_baskets_together(spark, monkeypatch):
    rng = random.Random(12)
    sets = [sorted(rng.sample(range(7), rng.randint(1, 5))) for _ in range(12)]
    rows = [(b, i) for b in range(300) for i in sets[b % 12]] + [(300 + k, i) for k in range(2) for i in range(6)]
    pairs = itemsets.baskets(spark.createDataFrame(rows, "b long, i int"), "b", "i").localCheckpoint()
    held = [sets[b % 12] for b in range(300)] + [list(range(6))] * 2
    want = {c: n for k in range(1, 7) for c in itertools.combinations(range(7), k) if (n := sum(set(c) <= set(h) for h in held)) >= 40}
    assert itemsets.weighed(pairs).select("basket").distinct().count() <= 13
    assert {tuple(r["items"]): r["n"] for r in itemsets.son(pairs, 40)[1].collect()} == want
    monkeypatch.setattr(itemsets, "LONG", 3)
    assert {tuple(r["items"]): r["n"] for r in itemsets.frequent(pairs, 40).collect()} == want


def test_candidate_pairs_need_no_distinct(spark):
    rng = random.Random(3)
    sigs = spark.createDataFrame([(s, *(rng.randint(0, 3) for _ in range(18))) for s in range(80)], ["set_id", *(f"h{k}" for k in range(18))])
    found = similarity.candidate_pairs(sigs)
    rows = {r[0]: r[1:] for r in sigs.collect()}
    want = {(a, b) for a in rows for b in rows if a < b and any(rows[a][k : k + 2] == rows[b][k : k + 2] for k in range(0, 18, 2))}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_bfr_with_vectors_that_cannot_be_compared(spark):
    """In the first share and later ones; they are retained, and the others fare as without them."""
    data = [(i, [50.0 * (i % 5), 50.0 * (i % 5)]) for i in range(510)]
    odd = {20: [float("nan"), 1.0], 21: [None, 1.0], 22: [float("inf"), 1.0], 23: [1.0], 200: [None, 0.0], 201: [1.0, 2.0, 3.0], 300: [float("-inf"), 0.0]}
    data = [(i, odd.get(i, x)) for i, x in data]
    rounds, clusters = cluster.bfr(spark.createDataFrame(data, "id long, features array<double>"), 2)
    found = {r["id"]: r["cluster"] for r in clusters.collect()}
    assert len(found) == clusters.count() == 510 and {i for i, c in found.items() if c == -1} == set(odd)
    assert [r["n_rs"] for r in rounds.orderBy("round").collect()] == [4, 6, 7, 7, 7]
    assert [r["n_ds"] + r["n_cs"] + r["n_rs"] for r in rounds.orderBy("round").collect()] == [102, 204, 306, 408, 510]
    none = spark.createDataFrame([(i, [float("nan")]) for i in range(12)], "id long, features array<double>")
    assert {tuple(r) for r in cluster.bfr(none, 2)[1].collect()} == {(i, -1) for i in range(12)}
