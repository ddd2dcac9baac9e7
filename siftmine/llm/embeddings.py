"""Embedding near-duplicates: an exact metric range join.

Vectors are points on the unit sphere and their distance is the angle between them. Every vector belongs to the cell
of its nearest pivot. One of a later cell can be within the angle of a vector only if, by the triangle inequality, the
vector's angle to that cell's pivot is at most the cell's radius and the angle, and at most its angle to its own pivot
and twice the angle; to those cells it is sent too. Cells are joined independently, in pairs of chunks of bounded size,
by blocked products in double precision; pairs within rounding of the threshold are decided by dot / sqrt(|a|^2 |b|^2)
of the vectors as they came. Equal vectors are one point with a weight, so no group of copies meets itself. There are
as many pivots as cells are wanted, in two levels: a pivot is looked at only if the ball of its group comes near enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, scratch, ship

SLACK = 1e-6  # for rounding, in angles; that of arccos near 1 is 2e-8
CLOSE = 1e-10  # for rounding, in cosines
BLOCK = 1024
ROWS = 2048  # vectors whose angles to pivots are computed at once
FARTHEST = 256  # pivots chosen farthest-first; the others are sampled
PIVOT_BYTES = 32 << 20  # that are sent to every task


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which rounds nothing, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    return np.ldexp(rows, 1 - np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample's point farthest from those before; beyond FARTHEST, the sample's next points."""
    chosen = [0]
    far = angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, FARTHEST, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(sample, sample[chosen[-1:]])[:, 0])
    more = np.setdiff1d(np.arange(len(sample)), chosen)[: max(0, k - len(chosen))]
    return sample[np.concatenate([chosen, more]).astype(np.int64)]


@dataclass
class Pivots:
    """Pivots in groups around some of them."""

    at: np.ndarray
    tops: np.ndarray
    members: list[np.ndarray]
    spread: list[np.ndarray]  # angles of the members to their top

    @classmethod
    def of(cls, at: np.ndarray) -> "Pivots":
        tops = at[: max(1, int(np.ceil(np.sqrt(len(at)))))] if len(at) > FARTHEST else at[:1]
        own = np.concatenate([angles(at[i : i + ROWS], tops).argmin(1) for i in range(0, len(at), ROWS)])
        members = [np.flatnonzero(own == g) for g in range(len(tops))]
        return cls(at, tops, members, [angles(at[m], tops[g : g + 1])[:, 0] for g, m in enumerate(members)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and its angle."""
        own, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        to_top = angles(x, self.tops)
        first = to_top.argmin(1)
        for own_group in (True, False):
            for g, m in enumerate(self.members):
                rows = np.flatnonzero(first == g if own_group else (first != g) & (to_top[:, g] - self.spread[g].max(initial=0) <= best + SLACK))
                if len(rows) and len(m):
                    a = angles(x[rows], self.at[m])
                    k = a.argmin(1)
                    a = a[np.arange(len(rows)), k]
                    won = (a < best[rows]) | ((a == best[rows]) & (m[k] < own[rows]))
                    own[rows[won]], best[rows[won]] = m[k][won], a[won]
        return own, best

    def visits(self, x: np.ndarray, own: np.ndarray, near: np.ndarray, radius: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
        """(place of the vector, later cell) that may hold one within the angle."""
        who, cell = [], []
        to_top = angles(x, self.tops)
        for g, m in enumerate(self.members):
            if not len(m):
                continue
            rows = np.flatnonzero(to_top[:, g] <= (self.spread[g] + radius[m]).max() + angle + SLACK)
            a = angles(x[rows], self.at[m])
            go = (a <= radius[m] + angle + SLACK) & (a <= near[rows, None] + 2 * angle + SLACK) & (m > own[rows, None])
            i, j = np.nonzero(go)
            who.append(rows[i])
            cell.append(m[j])
        return np.concatenate(who), np.concatenate(cell)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    pivots: Pivots = shared.value
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            b = batch.slice(i, ROWS)
            own, angle = pivots.nearest(unit(_matrix(b.column("v"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64()), pa.array(angle)], names=["id", "weight", "v", "cell", "angle"])


def _visits(batches: Iterator[pa.RecordBatch], shared, radius: np.ndarray, angle: float) -> Iterator[pa.RecordBatch]:
    """A row for each vector and later cell that it must be sent to."""
    pivots: Pivots = shared.value
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            b = batch.slice(k, ROWS)
            who, cell = pivots.visits(unit(_matrix(b.column("v"))), b.column("cell").to_numpy(), b.column("angle").to_numpy(), radius, angle)
            for i in range(0, len(who), 20_000):
                at = pa.array(who[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("id", "weight", "v")], pa.array(cell[i : i + 20_000], pa.int64())], names=["id", "weight", "v", "cell"])


def _pairs(group: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of chunks: for each vector the weight of those linked, and edges that connect what is linked."""
    left = np.asarray(group.column("side").to_numpy() == 0)
    same = bool(group.column("same")[0].as_py())
    ids, weight, raw = group.column("id").to_numpy(), group.column("weight").to_numpy().astype(np.float64), scaled(_matrix(group.column("v")))
    square = (raw * raw).sum(1)
    x = raw / np.sqrt(square)[:, None]
    a = np.flatnonzero(left)
    b = a if same else np.flatnonzero(~left)
    gain = np.zeros(len(ids))
    label = np.arange(len(ids))
    edges: list[tuple[int, int]] = []
    for i in range(0, len(a), BLOCK):
        rows = a[i : i + BLOCK]
        first = i if same else 0
        for j in range(first, len(b), BLOCK):
            cols = b[j : j + BLOCK]
            product = x[rows] @ x[cols].T
            hit = product >= threshold
            r, c = np.nonzero(np.abs(product - threshold) < CLOSE)
            for k in range(0, len(r), BLOCK):
                p, q = r[k : k + BLOCK], c[k : k + BLOCK]
                m, n = rows[p], cols[q]
                hit[p, q] = (raw[m] * raw[n]).sum(1) / np.sqrt(square[m] * square[n]) >= threshold
            if same and i == j:
                hit[np.arange(len(rows)), np.arange(len(rows))] = False
            linked = np.flatnonzero(hit.any(1))
            if not len(linked):
                continue
            gain[rows] += hit @ weight[cols]
            if not (same and i == j):
                gain[cols] += weight[rows] @ hit
            for r in linked:
                others = cols[hit[r]]
                labels, at = np.unique(label[others], return_index=True)
                mine = label[rows[r]]
                for other, k in zip(labels, at):
                    if other != mine:
                        edges.append((int(ids[rows[r]]), int(ids[others[k]])))
                        label[label == other] = mine
    found = np.flatnonzero(gain)
    n, m = len(found), len(edges)
    return pa.table({"id": pa.array(np.concatenate([ids[found], np.array([e[0] for e in edges], np.int64)]).astype(np.int64)), "gain": pa.array(np.concatenate([gain[found], np.zeros(m)]).round().astype(np.int64)), "other": pa.array([None] * n + [e[1] for e in edges], pa.int64())})


def range_join(points: DataFrame, threshold: float, cell_rows: int = 4096, sample_rows: int = 4096) -> DataFrame:
    """Links among points(id, weight, v) of one dimension, none null, zero or non-finite: rows (id, gain, null) whose
    gains sum to the weight of all others with cosine >= threshold, and rows (id, 0, other) whose edges connect them.

    A cell for every cell_rows points, as long as the pivots take PIVOT_BYTES at most; beyond that cells grow, and
    are joined in more chunks."""
    spark = points.sparkSession
    n, dims = points.count(), len(points.select("v").first()[0])
    k = max(1, min(PIVOT_BYTES // (8 * dims), -(-n // cell_rows)))
    chosen = points.orderBy(F.xxhash64("id")).limit(max(sample_rows, 2 * k) if k > FARTHEST else sample_rows).select("v").collect()
    shared = spark.sparkContext.broadcast(Pivots.of(choose_pivots(unit(np.array([r[0] for r in chosen], dtype=np.float64)), k)))
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    kind = "id long, weight long, v array<double>, cell long"
    cells = scratch(points.mapInArrow(lambda b: _assigned(b, shared), f"{kind}, angle double"))
    facts = cells.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # a row for each pivot
    radius = np.full(len(shared.value.at), -10.0)
    for f in facts:
        radius[f["cell"]] = f["r"]
    visitors = scratch(cells.mapInArrow(lambda b: _visits(b, shared, radius, angle), kind))
    guest_counts = {f["cell"]: f["n"] for f in visitors.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    chunks = lambda m: -(-m // cell_rows)
    sizes = F.broadcast(spark.createDataFrame([(f["cell"], chunks(f["n"]), chunks(guest_counts.get(f["cell"], 0))) for f in facts], "cell long, chunks int, guests int"))  # a row for each pivot
    in_chunk = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    own = cells.drop("angle").join(sizes, "cell").withColumn("chunk", in_chunk("chunks"))
    guests = visitors.join(sizes, "cell").withColumn("chunk", in_chunk("guests"))
    # own chunk i meets own chunks j >= i (right side -j - 1) and all guest chunks (right side j)
    meet = lambda l, r, side: F.struct(l.alias("l"), r.alias("r"), F.lit(side).alias("side"))
    as_left = F.transform(F.sequence("chunk", F.col("chunks") - 1), lambda j: meet(F.col("chunk"), -j - 1, 0))
    as_right = F.when(F.col("chunk") > 0, F.transform(F.sequence(F.lit(0), F.col("chunk") - 1), lambda i: meet(i, -F.col("chunk") - 1, 1))).otherwise(F.slice(as_left, 1, 0))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda j: meet(F.col("chunk"), j, 0))).otherwise(F.slice(as_left, 1, 0))
    first = own.select("cell", "id", "weight", "v", F.explode(F.concat(as_left, as_right, with_guests)).alias("g"))
    second = guests.select("cell", "id", "weight", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: meet(i, F.col("chunk"), 1))).alias("g"))
    both = first.unionByName(second).select("cell", F.col("g.l").alias("l"), F.col("g.r").alias("r"), "g.side", "id", "weight", "v")
    both = both.withColumn("same", F.col("r") == -F.col("l") - 1)
    out = scratch(both.groupBy("cell", "l", "r").applyInArrow(lambda t: _pairs(t, threshold), "id long, gain long, other long"))
    discard(cells, visitors)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding", cell_rows: int = 4096) -> DataFrame:
    """Classes of vectors linked by cosine >= threshold: vec_id, n_links, component_id, kept; one row for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, link with
    nothing and are their own component (null for a null id). Vectors of different lengths never link; each length is
    joined by itself. Components count as doubles, however small or large, and a cosine of exactly the threshold
    links. Rows with an equal vector link with each other, also where their ids are equal. Every link of different
    vectors counts. Further columns are left alone; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = F.col("id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = scratch(base.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), whole.alias("good")))
    # numbered in the table, as equal vectors may share their smallest id with others
    points = rows.where("good").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    points = scratch(points.withColumn("point", F.monotonically_increasing_id()))
    found = None
    for size in sorted(r[0] for r in points.select(F.size("v").alias("n")).distinct().collect()):
        links = range_join(points.where(F.size("v") == size).select(F.col("point").alias("id"), "weight", "v"), threshold, cell_rows)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "id long, gain long, other long")
    gains = found.where("other is null").groupBy("id").agg(F.sum("gain").alias("gain"))
    classes = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = points.select("point", "h1", "h2", "rep", "weight").join(classes.withColumnRenamed("node", "point"), "point", "left").withColumn("c", F.coalesce("component", "point"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    per_point = scratch(named.drop("component").join(smallest, "c").join(gains.withColumnRenamed("id", "point"), "point", "left").select("h1", "h2", (F.col("weight") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), "component_id"))
    discard(points)
    out = rows.where("good").join(per_point, ["h1", "h2"]).select("id", "n_links", "component_id").unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_embedding_range_join(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, at a cosine of 0.9."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """op3 in SQL, for vectors of one length."""
    return """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, other) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT id AS vec_id, min(other) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
