"""The same queries in SQL."""

from __future__ import annotations

from siftmine.operators.similarity import MINHASHES
from siftmine.operators.sketches import BLOOM, FM

RATINGS = "ui AS (SELECT event_id, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS i, CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) AS stars FROM events)"
SPLIT = "train AS (SELECT u, i, max(stars) AS stars FROM ui WHERE event_id % 5 <> 0 GROUP BY u, i), test AS (SELECT u, i, max(stars) AS stars FROM ui WHERE event_id % 5 = 0 GROUP BY u, i)"
BRAND_RATINGS = """ui AS (SELECT u + i AS event_id, u, i, CAST(1 + CAST(floor(q) AS BIGINT) % 5 AS DOUBLE) AS stars FROM (
  SELECT o_custkey AS u, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS i, max(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""


def top_list(key: str) -> str:
    return f"""(SELECT '[' || string_agg('["' || k || '", ' || n || ']', ', ' ORDER BY n DESC, k) || ']' FROM (SELECT {key} AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 10))"""


def frequent(source: str, support: int, sizes: tuple[int, ...]) -> str:
    """source: SQL of distinct (basket, item)."""
    parts = []
    for n in sizes:
        names = [f"b{k}" for k in range(n)]
        joins = " ".join(f"JOIN b {names[k]} ON {names[k]}.basket = {names[0]}.basket AND {names[k]}.item > {names[k - 1]}.item" for k in range(1, n))
        said = " || '|' || ".join(f"CAST({x}.item AS VARCHAR)" for x in names)
        parts.append(f"SELECT {said} AS items, count(*) AS n FROM b {names[0]} {joins} GROUP BY 1 HAVING count(*) >= {support}")
    return f"WITH b AS ({source}) " + " UNION ALL ".join(parts)


BRANDS = "SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
LARGE = f"SELECT basket, item FROM ({BRANDS}) WHERE basket IN (SELECT basket FROM ({BRANDS}) GROUP BY basket HAVING count(*) > 5)"
SWAPPED = f"WITH {RATINGS} SELECT DISTINCT i AS basket, u AS item FROM ui"


def minhash(members: str, key: str = "set_id") -> str:
    """CTEs idx, m, e (set_id, e) and sig of members(set_id, element)."""
    hashes = ", ".join(f"min((({a} * e + {b}) % {p}) % (SELECT m FROM m)) AS h{k}" for k, (a, b, p) in enumerate(MINHASHES))
    return f"""mem AS ({members}), idx AS (SELECT element, row_number() OVER (ORDER BY element) - 1 AS e FROM (SELECT DISTINCT element FROM mem)),
    m AS (SELECT count(*) AS m FROM idx), e AS (SELECT set_id, e FROM mem JOIN idx USING (element)), sig AS (SELECT set_id, {hashes} FROM e GROUP BY set_id)"""


WORDS = "SELECT DISTINCT doc_id AS set_id, unnest(string_split(lower(text), ' ')) AS element FROM documents"
BANDS = "cand AS (" + " UNION ".join(f"SELECT a.set_id AS id1, b.set_id AS id2 FROM sig a JOIN sig b ON a.h{k} = b.h{k} AND a.h{k + 1} = b.h{k + 1} AND a.set_id < b.set_id" for k in range(0, len(MINHASHES), 2)) + ")"
SIMILAR = """sz AS (SELECT set_id, count(*) AS n FROM e GROUP BY 1), com AS (SELECT id1, id2, count(*) AS c FROM cand JOIN e x ON x.set_id = id1 JOIN e y ON y.set_id = id2 AND y.e = x.e GROUP BY 1, 2),
  sim AS (SELECT id1, id2, c / CAST(a.n + b.n - c AS DOUBLE) AS similarity FROM com JOIN sz a ON a.set_id = id1 JOIN sz b ON b.set_id = id2 WHERE c / CAST(a.n + b.n - c AS DOUBLE) >= 0.5)"""


def pearson(one: str, by: str, only: str = "") -> str:
    return f"""prs AS (SELECT id1, id2, CASE WHEN n * sxy - sx * sy = 0 THEN 0.0 ELSE (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) END AS similarity FROM (
  SELECT a.{one} AS id1, b.{one} AS id2, count(*) AS n, sum(a.stars) AS sx, sum(b.stars) AS sy, sum(a.stars * b.stars) AS sxy, sum(a.stars * a.stars) AS sxx, sum(b.stars * b.stars) AS syy
  FROM train a JOIN train b ON a.{by} = b.{by} AND a.{one} < b.{one} {only} GROUP BY 1, 2))"""


def near(k: int) -> str:
    return f"""nb AS (SELECT id, other, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, other) AS r FROM (
  SELECT id1 AS id, id2 AS other, similarity AS s FROM prs UNION ALL SELECT id2, id1, similarity FROM prs)) WHERE r <= {k})"""


USER_CF = """SELECT t.u, t.i, round(greatest(0.0, least(5.0, CASE WHEN mean IS NULL THEN 3.0 WHEN coalesce(down, 0) = 0 THEN mean ELSE mean + top / down END)), 5) AS prediction
FROM test t LEFT JOIN (SELECT u, avg(stars) AS mean FROM train GROUP BY u) m ON m.u = t.u
LEFT JOIN (SELECT x.u, x.i, sum(s * (r.stars - a.mean)) AS top, sum(abs(s)) AS down FROM test x JOIN nb ON nb.id = x.u JOIN train r ON r.u = nb.other AND r.i = x.i
  JOIN (SELECT u, avg(stars) AS mean FROM train GROUP BY u) a ON a.u = nb.other GROUP BY 1, 2) h ON h.u = t.u AND h.i = t.i"""
ITEM_CF = """SELECT t.u, t.i, greatest(0.0, least(5.0, CASE WHEN mean IS NULL THEN 3.0 WHEN coalesce(down, 0) = 0 THEN mean ELSE top / down END)) AS prediction, t.stars
FROM test t LEFT JOIN (SELECT i, avg(stars) AS mean FROM train GROUP BY i) m ON m.i = t.i
LEFT JOIN (SELECT x.u, x.i, sum(s * r.stars) AS top, sum(abs(s)) AS down FROM test x JOIN nb ON nb.id = x.i JOIN train r ON r.i = nb.other AND r.u = x.u GROUP BY 1, 2) h ON h.u = t.u AND h.i = t.i"""


def edges(t: int) -> str:
    return f"""{RATINGS}, p AS (SELECT DISTINCT u AS v, i FROM ui), pr AS (SELECT a.v AS a, b.v AS b FROM p a JOIN p b ON a.i = b.i AND a.v < b.v GROUP BY 1, 2 HAVING count(*) >= {t}),
  edges AS (SELECT a AS src, b AS dst FROM pr UNION ALL SELECT b, a FROM pr)"""


def labels(rounds: int = 5) -> str:
    out = "l0 AS (SELECT DISTINCT src AS id, src AS label FROM edges)"
    for k in range(rounds):
        out += f""", l{k + 1} AS (SELECT dst AS id, label FROM (SELECT dst, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS r FROM edges JOIN l{k} ON src = id GROUP BY dst, label) WHERE r = 1)"""
    return out


def betweenness(levels: int = 8) -> str:
    seen = "v0 AS (SELECT DISTINCT src AS root, src AS node, 0 AS level FROM edges)"
    for k in range(levels):
        seen += f", v{k + 1} AS (SELECT * FROM v{k} UNION ALL SELECT DISTINCT root, dst, {k + 1} FROM v{k} JOIN edges ON src = node WHERE level = {k} AND NOT EXISTS (SELECT 1 FROM v{k} w WHERE w.root = v{k}.root AND w.node = dst))"
    links = f", ln AS (SELECT c.root, c.level, c.node AS child, p.node AS parent, 1.0 / count(*) OVER (PARTITION BY c.root, c.node) AS share FROM v{levels} c JOIN edges ON dst = c.node JOIN v{levels} p ON p.root = c.root AND p.node = src AND p.level = c.level - 1)"
    flows = f", f{levels} AS (SELECT root, child, parent, share AS credit FROM ln WHERE level = {levels})"
    for k in range(levels - 1, 0, -1):
        flows += f", f{k} AS (SELECT ln.root, child, ln.parent, share * (1 + coalesce(s, 0)) AS credit FROM ln LEFT JOIN (SELECT root, parent AS node, sum(credit) AS s FROM f{k + 1} GROUP BY 1, 2) g ON g.root = ln.root AND g.node = child WHERE level = {k})"
    union = " UNION ALL ".join(f"SELECT child, parent, credit FROM f{k}" for k in range(1, levels + 1))
    return f"WITH {edges(35)}, {seen}{links}{flows} SELECT least(child, parent) AS a, greatest(child, parent) AS b, round(sum(credit) / 2, 6) AS value FROM ({union}) GROUP BY 1, 2"


CITY = "c AS (SELECT event_id, ts, event_type || '|' || CAST(user_id AS VARCHAR) AS city, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"


def folded(p: int) -> str:
    """The bytes of an ASCII city as a number modulo p."""
    return f"list_reduce(codes, lambda x, y: (x * 256 + y) % {p}) % {p}"


CODES = "k AS (SELECT city, list_transform(string_split(city, ''), lambda s: CAST(ascii(s) AS BIGINT)) AS codes FROM (SELECT DISTINCT city FROM c))"
BLOOM_SQL = f"""WITH {CITY}, {CODES}, fst AS (SELECT city, min(event_id) AS fst FROM c GROUP BY city),
bit AS ({" UNION ".join(f"SELECT city, (({a} * ({folded(p)}) + {b}) % {p}) % 200 AS bit FROM k" for a, b, p in BLOOM)}),
own AS (SELECT bit, min(fst) AS own FROM bit JOIN fst USING (city) GROUP BY bit),
ver AS (SELECT city, fst, bool_and(own < fst) AS fp FROM bit JOIN fst USING (city) JOIN own USING (bit) GROUP BY city, fst),
per AS (SELECT c.day, count(ver.fst) FILTER (ver.fp) AS fp, count(ver.fst) FILTER (NOT ver.fp) AS tn FROM c LEFT JOIN ver ON ver.fst = c.event_id GROUP BY c.day),
run AS (SELECT day AS batch, CAST(sum(fp) OVER (ORDER BY day) AS BIGINT) AS fp, CAST(sum(tn) OVER (ORDER BY day) AS BIGINT) AS tn FROM per)
SELECT batch, fp, tn, round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / CAST(fp + tn AS DOUBLE) END, 9) AS fpr FROM run"""


def fm_sql() -> str:
    hashes = [h for g in FM for h in g]
    # trailing zeros of h, 1 for 0
    zero = lambda h: f"(SELECT CASE WHEN x = 0 THEN 1 ELSE CAST(log2(x & -x) AS INTEGER) END FROM (SELECT {h} AS x))"
    cols = ", ".join(f"{zero(f'(({a} * f{p} + {b}) % {p}) % 200')} AS z{i}" for i, (a, b, p) in enumerate(hashes))
    folds = ", ".join(f"{folded(p)} AS f{p}" for p in sorted({p for _, _, p in hashes}))
    i, means = 0, []
    for g in FM:
        means.append("(" + " + ".join(f"pow(2.0, max(z{i + j}))" for j in range(len(g))) + f") / {len(g)}")
        i += len(g)
    return f"""WITH {CITY}, {CODES}, f AS (SELECT city, {folds} FROM k), z AS (SELECT city, {cols} FROM f),
w AS (SELECT DISTINCT CAST(CAST(ts AS DATE) - CAST(o AS INTEGER) AS VARCHAR) AS start, city FROM c, range(0, 3) r(o))
SELECT start, count(*) AS truth, list_sort([{", ".join(means)}])[6] AS estimate FROM w JOIN z USING (city) GROUP BY start"""


RESERVOIR = """n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events),
d AS (SELECT n, ((n * 1103515245 + 42 * 12345) % 2147483648) % n + 1 AS r FROM n WHERE n > 100),
t AS (SELECT row_number() OVER (ORDER BY n) AS i, n, r FROM d WHERE r < 100),
st(i, l) AS (SELECT CAST(0 AS BIGINT), (SELECT list(n ORDER BY n) FROM n WHERE n <= 100) UNION ALL SELECT t.i, list_concat(list_concat(l[1:CAST(r AS INTEGER)], l[CAST(r AS INTEGER) + 2:]), [t.n]) FROM st JOIN t ON t.i = st.i + 1),
fin AS (SELECT l FROM st ORDER BY i DESC LIMIT 1), smp AS (SELECT unnest(generate_series(1, len(l))) AS pos, l FROM fin)"""

ORACLE_SQL = {
    "review_stats": f"SELECT count(*) AS n_review, count(*) FILTER (CAST(ts AS VARCHAR) LIKE '%2024-01-1%') AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT event_type) AS n_business, {top_list('user_id')} AS top10_user, {top_list('event_type')} AS top10_business FROM events",
    "top10_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top10_items": f"WITH {RATINGS} SELECT i, count(*) AS n FROM ui GROUP BY 1 ORDER BY n DESC, i LIMIT 10",
    "grouped_mean_topk": "SELECT n_name, round(avg(o_totalprice), 4) AS stars FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY stars DESC, n_name LIMIT 10",
    "frequent_pairs": frequent(BRANDS, 350, (1, 2)),
    "frequent_triples": frequent(BRANDS, 60, (3,)),
    "frequent_large_baskets": frequent(LARGE, 100, (1, 2)),
    "frequent_swapped": frequent(SWAPPED, 33, (1, 2)),
    "frequent_fp_growth": frequent(BRANDS, 350, (1, 2)),
    "son_frequent": frequent(BRANDS, 350, (1, 2, 3)),
    "son_candidates": "SELECT items, count(*) AS parts FROM (" + " UNION ALL ".join(f"SELECT items FROM ({frequent(f'SELECT basket, item FROM ({BRANDS}) WHERE basket % 2 = {k}', 175, (1, 2, 3))})" for k in range(2)) + ") GROUP BY items",
    "sorted_baskets": f"SELECT basket, string_agg(item, '|' ORDER BY item) AS items FROM ({LARGE}) GROUP BY basket",
    "minhash_signatures": f"WITH {minhash(WORDS)} SELECT set_id AS doc_id, * EXCLUDE (set_id) FROM sig",
    "lsh_candidates": f"WITH {minhash(WORDS)}, {BANDS} SELECT * FROM cand",
    "lsh_similar_pairs": f"WITH {minhash(WORDS)}, {BANDS}, {SIMILAR} SELECT id1, id2, round(similarity, 6) AS similarity FROM sim",
    "user_pearson": f"WITH {RATINGS}, {SPLIT}, {pearson('u', 'i')} SELECT id1, id2, round(similarity, 6) AS similarity FROM prs",
    "user_cf": f"WITH {RATINGS}, {SPLIT}, {pearson('u', 'i')}, {near(5)} {USER_CF}",
    "item_cf": f"WITH {RATINGS}, {SPLIT}, {pearson('i', 'u')}, {near(2)} SELECT u, i, round(prediction, 5) AS prediction FROM ({ITEM_CF})",
    "lsh_item_cf": f"WITH {BRAND_RATINGS}, {SPLIT}, {minhash('SELECT i AS set_id, u AS element FROM train')}, {BANDS}, {SIMILAR}, {pearson('i', 'u', 'JOIN sim ON sim.id1 = a.i AND sim.id2 = b.i')}, {near(2)} SELECT u, i, round(prediction, 5) AS prediction FROM ({ITEM_CF})",
    "cf_rmse": f"WITH {RATINGS}, {SPLIT}, {pearson('i', 'u')}, {near(2)} SELECT count(*) AS n, round(sqrt(avg(pow(stars - prediction, 2))), 5) AS rmse FROM ({ITEM_CF})",
    "overlap_graph": f"WITH {edges(33)} SELECT src, dst FROM edges",
    "label_propagation": f"WITH {edges(33)}, {labels()} SELECT id, label FROM l5",
    "connected_components": f"WITH RECURSIVE {minhash(WORDS)}, {BANDS}, {SIMILAR}, g AS (SELECT id1 AS a, id2 AS b FROM sim UNION ALL SELECT id2, id1 FROM sim), r(id, other) AS (SELECT a, a FROM g UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.other) SELECT id, min(other) AS component FROM r GROUP BY id",
    "edge_betweenness": betweenness(),
    "modularity": f"WITH {edges(33)}, {labels()}, b AS (SELECT x.label AS l1, y.label AS l2 FROM edges JOIN l5 x ON x.id = src JOIN l5 y ON y.id = dst), c AS (SELECT l1, count(*) AS k, count(*) FILTER (l1 = l2) AS a FROM b GROUP BY l1), t AS (SELECT count(*) AS e FROM edges) SELECT round(sum((a - 0.5 * k * k / CAST(e AS DOUBLE)) / (2 * e)), 8) AS modularity FROM c, t",
    "mahalanobis_assign": """WITH x AS (SELECT vec_id AS id, label AS cluster, unnest(generate_series(1, len(embedding))) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
s AS (SELECT cluster, d, sum(x) / count(*) AS m, sqrt(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*))) AS v FROM x GROUP BY 1, 2),
q AS (SELECT x.id, s.cluster, sqrt(sum(CASE WHEN v = 0 THEN 0 ELSE ((x.x - m) / v) * ((x.x - m) / v) END)) AS distance FROM x JOIN s ON s.d = x.d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS k FROM q)
SELECT id, CASE WHEN distance < 16 THEN cluster ELSE -1 END AS cluster, round(distance, 6) AS distance FROM r WHERE k = 1""",
    "bloom_fpr": BLOOM_SQL,
    "fm_estimate": fm_sql(),
    "reservoir_sample": f"WITH RECURSIVE {RESERVOIR} SELECT CAST(pos - 1 AS INTEGER) AS place, l[pos] AS n FROM smp",
    "trending_tags": f"WITH RECURSIVE {RESERVOIR}, ent AS (SELECT n FROM n WHERE n <= 100 UNION ALL SELECT n FROM t), cnt AS (SELECT event_type AS tag, CAST(count(s.n) AS BIGINT) AS n FROM ent JOIN n USING (n) LEFT JOIN (SELECT l[pos] AS n FROM smp) s ON s.n = ent.n GROUP BY 1) SELECT tag, n FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS k FROM cnt) WHERE k <= 3",
}
ORACLE_SQL["stream_fm"] = ORACLE_SQL["fm_estimate"]
ORACLE_SQL["stream_bloom"] = ORACLE_SQL["bloom_fpr"]
ORACLE_SQL["stream_reservoir"] = ORACLE_SQL["reservoir_sample"]
ORACLE_SQL["stream_trending"] = ORACLE_SQL["trending_tags"]
