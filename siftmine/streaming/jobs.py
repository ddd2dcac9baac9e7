"""The stream summaries on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmine.functions.scalar import dense_index
from siftmine.operators import sketches
from siftmine.sources.scratch import settled, shared_root
from siftmine.sources.writers import append_line


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with an event time that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("city"), F.concat(F.lit("seen #"), "event_type").alias("text"), F.to_date("ts").cast("string").alias("day"))


def drain(query) -> None:
    """Run what is available, then stop."""
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/siftmine-{uuid.uuid4().hex}"


def fm_windows(stream: DataFrame, window: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Distinct values (exact and estimated) of sliding windows as a stream; late rows are kept for `delay`.

    Repeats of a value within a window go before they are hashed; the exact count is the size of the window's set.
    """
    spread = stream.withWatermark("ts", delay).select(F.window("ts", window, slide).alias("w"), "ts", "city")
    moduli = sorted({p for g in sketches.FM for _, _, p in g})
    folded = spread.select("w", "city", *[sketches.bytes_mod(F.col("city"), p).alias(f"_{p}") for p in moduli])
    zeros = [sketches.trailing_zeros(((F.lit(a) * F.col(f"_{p}") + F.lit(b)) % p) % sketches.BITS) for g in sketches.FM for a, b, p in g]
    rows = folded.select("w", "city", F.array(*zeros).alias("zeros"))
    out = rows.groupBy("w").agg(F.size(F.collect_set("city")).cast("long").alias("truth"), *sketches.fm_columns())
    return out.select(F.col("w.start").alias("start"), "truth", sketches.fm_combine().alias("estimate"))


def run_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the available events."""
    out = Epochs(spark)
    rows = fm_windows(event_stream(spark, sf_dir), "3 days", "1 day")

    def step(batch: DataFrame, epoch: int) -> None:
        out.write(batch, epoch)  # complete mode: all windows

    drain(rows.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start())
    found = out.before(spark)
    last = found.join(F.broadcast(found.agg(F.max("epoch").alias("epoch"))), "epoch")
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "truth", "estimate")


class Epochs:
    """Tables by epoch in a shared folder. An epoch that is tried again takes the place of what it wrote before, and
    what came of earlier epochs is read back after a restart."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.folder = folder or _folder(spark)

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def before(self, spark: SparkSession, epoch: int | None = None) -> DataFrame | None:
        """Rows of all epochs before one, or of all; None if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        past = [n for n in names if n.startswith("epoch=") and (epoch is None or int(n[6:]) < epoch)]
        return spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/{n}" for n in past]) if past else None


class BloomMonitor:
    """foreachBatch state: the verdict of every value at its first arrival, as tables by epoch in a shared folder.

    Of a batch only values not seen before matter; their bits are compared with the least owner of each of the
    BITS bits so far, of which the driver holds one number each, read back from the tables after a restart.
    """

    def __init__(self, spark: SparkSession, seq: str = "event_id", value: str = "city", day: str = "day", folder: str | None = None):
        self.seq, self.value, self.day = seq, value, day
        self.epochs = Epochs(spark, folder)
        self.owners: dict[int, int] = {}
        self.last: int | None = None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        past = self.epochs.before(spark, epoch)
        if self.last is None or self.last != epoch - 1:
            least = past.select("first", F.explode("bits").alias("bit")).groupBy("bit").agg(F.min("first").alias("m")).collect() if past is not None else []
            self.owners = {r["bit"]: r["m"] for r in least}
        new = batch.where(F.col(self.value).isNotNull()).groupBy(self.value).agg(F.min(F.struct(self.seq, self.day)).alias("f")).select(self.value, F.col(f"f.{self.seq}").alias("first"), F.col(f"f.{self.day}").alias("batch"))
        if past is not None:
            new = new.join(past.select(self.value), self.value, "left_anti")
        bits = sketches.hash_bits(new.select(self.value), self.value, sketches.BLOOM)
        each = settled(new.join(bits, self.value).select(self.value, "first", "batch", F.array_distinct("bits").alias("bits")))
        for r in each.select("first", F.explode("bits").alias("bit")).groupBy("bit").agg(F.min("first").alias("m")).collect():
            self.owners[r["bit"]] = min(r["m"], self.owners.get(r["bit"], r["m"]))
        owner = spark.createDataFrame(list(self.owners.items()) or [(-1, 0)], "bit long, owner long")
        told = each.select("*", F.explode("bits").alias("bit")).join(F.broadcast(owner), "bit").groupBy(self.value, "first", "batch", "bits").agg(F.min(F.col("owner") < F.col("first")).alias("false_positive"))
        self.epochs.write(told, epoch)
        self.last = epoch

    def rates(self, spark: SparkSession, batches: DataFrame) -> DataFrame:
        """Cumulative rate after each of the batches (one column, batch)."""
        from pyspark.sql import Window as W

        per = self.epochs.before(spark).groupBy("batch").agg(F.count(F.when(F.col("false_positive"), 1)).alias("fp"), F.count(F.when(~F.col("false_positive"), 1)).alias("tn"))
        run = W.orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
        cumulated = batches.join(per, "batch", "left").select("batch", F.sum(F.coalesce("fp", F.lit(0))).over(run).alias("fp"), F.sum(F.coalesce("tn", F.lit(0))).over(run).alias("tn"))
        return cumulated.select("batch", "fp", "tn", F.when(F.col("fp") + F.col("tn") == 0, 0.0).otherwise(F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))


def run_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    monitor = BloomMonitor(spark)
    _through(spark, event_stream(spark, sf_dir), monitor)
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").cast("string").alias("batch")).distinct()
    return monitor.rates(spark, days).withColumn("fpr", F.round("fpr", 9))


class SampleMonitor:
    """foreachBatch state: a reservoir of texts and the count of every tag that was ever in it, as rows by epoch in a
    shared folder.

    A batch's rows are numbered by all executors, in an order without ties; rows whose draw doesn't take them never leave those, so the
    driver folds about size * ln(N / size) rows of the whole stream, one by one. A text that comes adds one to its tags,
    one that goes takes one away.
    """

    def __init__(self, spark: SparkSession, order: str = "event_id", text: str = "text", seed: int = 42, size: int = 100, levels: int = 3, folder: str | None = None):
        self.order, self.text, self.seed, self.size, self.levels = order, text, seed, size, levels
        self.epochs = Epochs(spark, folder)

    def state(self, spark: SparkSession, epoch: int | None = None) -> tuple[int, list[tuple[int, str]], dict[str, int], bool]:
        """Rows so far, the sample (number, text), the counts of tags, and whether the last batch replaced an element."""
        past = self.epochs.before(spark, epoch)
        last = past.orderBy(F.desc("epoch")).first() if past is not None else None  # a row for each epoch
        if last is None:
            return 0, [], {}, False
        return last["total"], [(r["n"], r["text"]) for r in last["sample"]], {r["tag"]: r["n"] for r in last["tags"]}, last["replaced"]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        total, sample, tags, _ = self.state(spark, epoch)
        rows = settled(batch.where(F.col(self.order).isNotNull()).select(F.col(self.order).alias("o"), F.col(self.text).alias("t")))
        more, replaced = rows.count(), False
        numbered = rows.join(dense_index(rows, "o", "i").withColumn("n", F.col("i") + 1 + total), "o")
        taken = numbered.where((F.col("n") <= self.size) | (sketches.draw(F.col("n"), self.seed) < self.size)).select("n", "t").collect()

        def change(text: str | None, by: int) -> None:
            for w in (text or "").split():
                if len(w) > 1 and w[0] == "#":
                    tags[w[1:]] = tags.get(w[1:], 0) + by

        for r in sorted(taken, key=lambda r: r["n"]):
            if r["n"] > self.size:
                place = (((r["n"] % 2147483648) * 1103515245 + self.seed * 12345) % 2147483648) % r["n"] + 1
                change(sample.pop(place)[1], -1)
                replaced = True
            sample.append((r["n"], r["t"]))
            change(r["t"], 1)
        kind = "total long, sample array<struct<n: long, text: string>>, tags array<struct<tag: string, n: long>>, replaced boolean"
        self.epochs.write(spark.createDataFrame([(total + more, sample, list(tags.items()), replaced)], kind), epoch)

    def sample(self, spark: SparkSession) -> DataFrame:
        """(place, n) after the last batch."""
        return spark.createDataFrame([(k, n) for k, (n, _) in enumerate(self.state(spark)[1])], "place int, n long")

    def trending(self, spark: SparkSession) -> DataFrame:
        """(tag, n) of the highest `levels` counts after the last batch, highest first."""
        tags = self.state(spark)[2]
        high = sorted(set(tags.values()), reverse=True)[: self.levels]
        return spark.createDataFrame(sorted(((k, n) for k, n in tags.items() if n in high), key=lambda x: (-x[1], x[0])), "tag string, n long")


def _through(spark: SparkSession, stream: DataFrame, step, folder: str | None = None) -> None:
    drain(stream.writeStream.foreachBatch(step).option("checkpointLocation", folder or _folder(spark)).trigger(availableNow=True).start())


def run_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    monitor = SampleMonitor(spark)
    _through(spark, event_stream(spark, sf_dir), monitor)
    return monitor.sample(spark)


def _now() -> str:
    import time

    return time.strftime("%Y-%m-%d %H:%M:%S", time.localtime())


def start_bloom_report(stream: DataFrame, path: str, every: str | None = "10 seconds", value: str = "city"):
    """Start a query that appends `Time,FPR` for each micro-batch of a stream with `value`, also for empty ones.

    Rows are numbered by batch and place, as they arrive. Without `every` it runs what is available and ends.
    """
    spark = stream.sparkSession
    monitor = BloomMonitor(spark, "seq", value, "day")

    def step(batch: DataFrame, epoch: int) -> None:
        rows = batch.where(F.col(value).isNotNull()).select(value, (F.lit(epoch) * (1 << 50) + F.monotonically_increasing_id()).alias("seq"), F.lit(str(epoch)).alias("day"))
        monitor(settled(rows), epoch)
        seen = monitor.epochs.before(spark).agg(F.count(F.when(F.col("false_positive"), 1)).alias("fp"), F.count("*").alias("n")).first()
        append_line(path, "Time,FPR", [_now(), seen["fp"] / seen["n"] if seen["n"] else 0])

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", _folder(spark))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_fm_report(stream: DataFrame, path: str, every: str | None = "5 seconds", window: str = "30 seconds", slide: str = "10 seconds"):
    """Start a query that appends `Time,Gound Truth,Estimation` (spelt so) with the latest window's counts of a stream
    (ts, city), for each micro-batch; a batch without a window writes 0 and the estimate of nothing, 0.5."""
    spark = stream.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        last = batch.orderBy(F.desc("start")).select("truth", "estimate").head()
        append_line(path, "Time,Gound Truth,Estimation", [_now(), *(last or (0, 0.5))])

    writer = fm_windows(stream, window, slide).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", _folder(spark))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_trending_report(stream: DataFrame, show, every: str | None = "1 second", order: str = "event_id", text: str = "text"):
    """Start a query that calls show(number of the text, [(tag, n), ...]) after each micro-batch that replaced an element of the sample."""
    spark = stream.sparkSession
    monitor = SampleMonitor(spark, order, text)

    def step(batch: DataFrame, epoch: int) -> None:
        monitor(batch, epoch)
        total, _, _, replaced = monitor.state(spark)
        if replaced:
            show(total, [tuple(r) for r in monitor.trending(spark).collect()])

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", _folder(spark))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags after the last batch."""
    monitor = SampleMonitor(spark)
    _through(spark, event_stream(spark, sf_dir), monitor)
    return monitor.trending(spark)
