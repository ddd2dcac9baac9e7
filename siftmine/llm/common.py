"""What the operators of this subpackage share: scratch tables, shipping, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_kept: dict = {}
_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python workers can import it.

    Rows here hold whole texts, so unless someone has chosen another size, Arrow batches are made smaller.
    """
    if spark.conf.get(ROWS_PER_BATCH, "10000") == "10000":
        spark.conf.set(ROWS_PER_BATCH, "2000")
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc)


def trim() -> None:
    """Give memory that this process has freed back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def kept(name: object, make):
    """What a Python worker has learned and its next task can use; one thing at a time, so that stages don't add up."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Let go of what other stages have kept in this Python worker, and of what they have freed; for steps that keep nothing."""
    _kept.clear()
    trim()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/siftmine-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(spark: SparkSession) -> None:
    """Have the driver collect garbage, upon which Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Have the driver and the executors collect garbage, upon which their heaps shrink: a heap that a stage has let grow
    otherwise stays as large beside the Python workers of the next. Executors are reached by a task for each core."""
    free(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the value's decimal text, modulo m; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def named(column: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def unlike(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores before it as long as it is taken."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(docs: DataFrame, keep: Iterable[str], text: str, added: dict[str, str], step) -> DataFrame:
    """The kept columns and `added` (name -> type), which step makes of Arrow batches whose last column is the text.

    An added column whose name a kept one has gets the name that unlike() gives.
    """
    ship(docs.sparkSession)
    keep = list(keep)
    chosen = docs.select(*[named(k).alias(f"k{i}") for i, k in enumerate(keep)], named(text).cast("string").alias("t"))
    kind = T.StructType(chosen.schema.fields[:-1] + [T.StructField(f"a{i}", T._parse_datatype_string(x)) for i, x in enumerate(added.values())])
    names = kind.names
    out = chosen.mapInArrow(lambda batches: (b.rename_columns(names) for b in step(batches)), kind)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *[F.col(f"a{i}").alias(unlike(k, keep)) for i, k in enumerate(added)])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node reachable.

    Alternates joining every node's larger neighbours, then its smaller ones, to the smallest node of its
    neighbourhood; the number of rounds grows with the logarithm of the longest path, and the edges never
    outnumber the input. A hub that is a neighbour of most nodes is met by partial minima only: the minimum of
    each node is aggregated before the shuffle, and joined back by a join that Spark may split.
    Null ends are dropped; an empty input gives no rows.
    """
    spark = edges.sparkSession
    now = scratch(edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    nodes = scratch(now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        star = scratch(large)
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        nxt = scratch(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        discard(star)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = nxt
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
