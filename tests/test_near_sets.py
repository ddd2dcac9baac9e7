"""Similar pairs by blocks of sets: those of a plain comparison, in blocks and tiles of any size."""

import random

import pytest

from siftmine.operators import near_sets, similarity


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs_of_many_blocks(spark, monkeypatch, kind, threshold):
    for name, value in (("BLOCK", (300, 300)), ("CELLS", 50), ("HITS", 30), ("ROWS", 7)):
        monkeypatch.setattr(near_sets, name, value)
    rng = random.Random(3)
    sets = {}
    for k in range(150):
        if k % 3 and sets:  # near another one, some larger, some equal
            base = set(rng.choice(list(sets.values())))
            base = {w for w in base if rng.random() > 0.15 * (k % 5)} | {f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, len(base)) * (k % 2))}
        else:
            base = {f"w{int(400 * rng.random() ** 2)}" for _ in range(rng.randint(1, 40))}
        if base:
            sets[k * 5 - 200 if kind == "long" else f"s{k}é"] = base
    rows = [(u, w) for u, s in sets.items() for w in s] + [(next(iter(sets)), None), (None, "w1")] + [(u, w) for u, s in list(sets.items())[:9] for w in s]
    df = spark.createDataFrame(rows, f"u {kind}, w string").repartition(3)
    e = {w: k for k, w in enumerate(sorted({w for s in sets.values() for w in s} | {"w1"}))}
    sig = {u: [min(((a * e[w] + b) % p) % len(e) for w in s) for a, b, p in similarity.MINHASHES] for u, s in sets.items()}
    want = {}
    for u in sets:
        for v in sets:
            s = len(sets[u] & sets[v]) / len(sets[u] | sets[v])
            if u < v and s >= threshold and any(sig[u][k : k + 2] == sig[v][k : k + 2] for k in range(0, 18, 2)):
                want[u, v] = s
    got = similarity.similar_pairs(df, "u", "w", threshold).collect()
    assert {(r["id1"], r["id2"]): r["similarity"] for r in got} == want and len(got) == len(want) > 30


def test_parts_of_sets_in_several_chunks_and_blocks_without_sets(spark, monkeypatch):
    """Rows of a set lie in chunks of their own, and of the blocks of sets of one size some are empty."""
    monkeypatch.setattr(near_sets, "CHUNK", 7, raising=False)
    monkeypatch.setattr(near_sets, "BLOCK", (10, 10))
    sets = {u: {f"w{u // 2}_{k}" for k in range(10)} | {"all"} for u in range(12)}
    rows = [(u, w) for k in range(3) for u, s in sets.items() for j, w in enumerate(sorted(s)) if j % 3 == k]
    got = similarity.similar_pairs(spark.createDataFrame(rows, "u long, w string").repartition(2), "u", "w").collect()
    assert sorted(map(tuple, got)) == [(u, u + 1, 1.0) for u in range(0, 12, 2)]
