"""Every query of the subpackage over whole tables, against plain versions of its contract."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from test_text_operators import plain_spans, whole_word_distance

from siftmine.llm import decontaminate, secrets, tokens
from siftmine.llm.queries import ORACLE_SQL, QUERIES

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(name, sf):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").to_df().to_dict("records")


def crc_mod(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


@pytest.fixture(scope="module")
def ids():
    tok = tokens.PieceEncoder(tokens.vocabulary()).tok
    return {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids for r in rows("documents", SMALL)}


def part_distance(p, t):
    """Least edit distance of p to any part of t, by rows of the whole table."""
    p, steps = np.array(list(p)), np.arange(len(p) + 1)
    row, best = steps, len(p)
    for c in t:
        new = np.concatenate([[0], np.minimum(row[1:] + 1, row[:-1] + (p != c))])
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(row[-1]))
    return best


def test_op1(spark):
    got = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    items = {r["item_id"]: decontaminate.folded(r["text"]) for r in rows("benchmark", SF)}
    docs = {r["doc_id"]: r["text"] for r in rows("documents", SF)}
    assert len(got) > 10
    for (d, i), r in got.items():
        passage = decontaminate.folded(docs[d][r["start"] : r["end"]])
        assert whole_word_distance(items[i], passage)[0] == r["distance"] <= r["budget"] == len(items[i]) // 10
    rng = np.random.default_rng(1)
    short = [d for d, t in docs.items() if t and len(t) < 4000]
    for d, i in zip(rng.choice(short, 200), rng.choice(list(items), 200)):
        if (d, i) not in got:
            assert part_distance(items[i], decontaminate.folded(docs[d])) > len(items[i]) // 10
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {decontaminate.folded(t)} "}
    assert exact and exact == {k for k, r in got.items() if r["distance"] == 0}


@pytest.mark.parametrize("name, m, rest, label", [("op4_toxicity", 3, 1, "toxic"), ("op8_quality_votes", 4, 2, "quality")])
def test_scores(spark, name, m, rest, label):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in rows("documents", SF)}
    assert all(r["held_out"] == (crc_mod(d, m) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    told = [(got[r["doc_id"]]["predicted"], r[label]) for r in rows("labels", SF) if got[r["doc_id"]]["held_out"] and r[label] == r[label]]
    assert np.mean([p == y for p, y in told]) > 0.9


def test_op2(spark):
    got = {r["doc_id"]: r for r in QUERIES["op2_language_mixture"](spark, SF).collect()}
    docs = rows("documents", SF)
    assert set(got) == {r["doc_id"] for r in docs} and all(r["held_out"] == (crc_mod(d, 4) == 2) for d, r in got.items())
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in docs}
    assert all((r["lang_pred"] == "und") == (not letters[d]) for d, r in got.items())
    held = [r for r in docs if got[r["doc_id"]]["held_out"] and letters[r["doc_id"]] and r["lang"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(abs(sum(x["share"] for x in r["languages"]) - 1) < 0.01 and r["score"] == r["languages"][0]["share"] for r in got.values() if r["languages"])


def test_op5(spark, ids):
    got = [r.asDict() for r in QUERIES["op5_mixture_packing"](spark, SMALL).collect()]
    by, where = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(ids)
    for d, pieces in by.items():
        whole, at = np.array(ids[d] + [1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : at].tobytes())
        assert at == len(whole)
    total = sum(len(x) + 1 for x in ids.values())
    assert sorted(where) == list(range(-(-total // 2048)))
    for k, spans in where.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == (2048 if k < len(where) - 1 else total - 2048 * k)
    source = {r["doc_id"]: r["source"] for r in rows("documents", SMALL)}
    share = {}
    for d, x in ids.items():
        share[source[d]] = share.get(source[d], 0) + (len(x) + 1) / total
    for k in range(len(where) - 1):
        for s, x in share.items():
            assert abs(sum(r["length"] for r in got if r["sequence_id"] == k and source[r["doc_id"]] == s) / 2048 - x) < 0.04


def test_op7(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_secret_scan"](spark, SF).collect()}
    for r in rows("documents", SF):
        base, mine = plain_spans(r["text"]), got.pop(r["doc_id"])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert mine["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert mine["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.spans(r["text"]))
    assert not got


def test_op10(spark, ids):
    at = 0
    got = {r["doc_id"]: r for r in QUERIES["op10_token_files"](spark, SMALL).collect()}
    for d in sorted(ids):
        raw = np.array(ids[d] + [0], "<u4").tobytes()
        r = got.pop(d)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert not got


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        rel = con.sql(sql)
        cols = sorted(rel.columns)
        df = QUERIES[name](spark, SF)
        assert sorted(df.columns) == cols
        want = sorted(str(tuple(r)) for r in rel.select(*cols).fetchall())
        assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want and len(want) > 100


def test_licences_of_each_kind(spark):
    assert {r["via"] for r in QUERIES["op6_license_scan"](spark, SF).select("via").distinct().collect()} == {"header", "file", "inherited", None}
