"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from siftmine.plans.oracle import BRANDS, LARGE, ORACLE_SQL, SWAPPED
from siftmine.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name, source, support", [("frequent_large_baskets", LARGE, 100), ("frequent_swapped", SWAPPED, 33), ("frequent_fp_growth", BRANDS, 350)])
def test_itemsets_of_all_sizes(spark, name, source, support):
    """On more rows than above, where sets of more than two items are frequent."""
    con, sf = duckdb.connect(), SF.replace("sf0.01", "sf0.1")
    for t in ("lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    con.execute(f"create table pairs as {source}")
    held, baskets = {}, {}
    for basket, item in con.sql("SELECT basket, item FROM pairs WHERE basket IS NOT NULL AND item IS NOT NULL").fetchall():
        held[item] = held.get(item, 0) | 1 << baskets.setdefault(basket, len(baskets))
    level = {(x,): m for x, m in held.items() if m.bit_count() >= support}
    singles, want = sorted(level.items()), []
    while level:
        want += [("|".join(map(str, x)), m.bit_count()) for x, m in level.items()]
        level = {(*x, *y): m & n for x, m in level.items() for y, n in singles if y > x[-1:] and (m & n).bit_count() >= support}
    got = [tuple(r) for r in QUERIES[name](spark, sf).select("items", "n").collect()]
    assert sorted(got) == sorted(want)
    assert any(x.count("|") == 2 for x, _ in got)
