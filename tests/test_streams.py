"""Streams that are tried again or restarted, sources and reports that other tests don't reach."""

import json
import random
import socket
import threading
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmine.functions.scalar import hashtags
from siftmine.operators import itemsets, relational, sketches
from siftmine.sources import readers, schemas, scratch, writers
from siftmine.streaming import jobs


def test_bloom_batches_that_are_tried_again(spark):
    rng = random.Random(1)
    rows = [(k, f"city{rng.randint(0, 60)}", f"d{k // 40}") for k in range(160)]
    df = spark.createDataFrame(rows, "event_id long, city string, day string")
    parts = [df.where(F.col("day") == f"d{k}") for k in range(4)]
    want = sorted(tuple(r) for r in sketches.bloom_fpr(df, "event_id", "city", "day").collect())
    monitor = jobs.BloomMonitor(spark)
    for k in (0, 1, 1):  # the second fails after it wrote, and comes again
        monitor(parts[k], k)
    again = jobs.BloomMonitor(spark, folder=monitor.epochs.folder)  # a new process
    for k in (1, 2, 3, 3):
        again(parts[k], k)
    assert sorted(tuple(r) for r in again.rates(spark, df.select(F.col("day").alias("batch")).distinct()).collect()) == want


def test_samples_that_are_tried_again(spark):
    rng = random.Random(2)
    rows = [(3 * k + 1, f"x #t{rng.randint(0, 9)} #u") for k in range(150)]
    df = spark.createDataFrame(rows, "event_id long, text string")
    parts = [df.where(f"event_id >= {a} and event_id < {b}") for a, b in ((0, 100), (100, 101), (101, 300), (300, 1000))]
    monitor = jobs.SampleMonitor(spark, size=20)
    for k in (0, 1, 2, 2):
        monitor(parts[k], k)
    again = jobs.SampleMonitor(spark, size=20, folder=monitor.epochs.folder)
    for k in (2, 3):
        again(parts[k], k)
    assert again.sample(spark).collect() == sketches.reservoir(df, "event_id", size=20).orderBy("place").collect()
    assert sorted(map(tuple, again.trending(spark).collect())) == sorted(map(tuple, sketches.trending(df, "event_id", "text", size=20).collect()))


def test_trending_report(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"in{i}.json").write_text("".join(json.dumps({"id": i * 100 + j, "city": f"#c{(i * 100 + j) % 7}"}) + "\n" for j in range(100)))
    stream = readers.file_json(spark, str(tmp_path), T._parse_datatype_string("id long, city string")).select(F.col("id").alias("event_id"), F.col("city").alias("text"))
    seen = []
    jobs.drain(jobs.start_trending_report(stream, lambda n, tags: seen.append((n, tags)), every=None))
    assert [n for n, _ in seen] == [200, 300] and all(t == sorted(t, key=lambda x: (-x[1], x[0])) and len({c for _, c in t}) <= 3 for _, t in seen)


def test_socket(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        with c:
            c.sendall(b'{"city": "Phoenix"}\nnot json\n{"city": "Mesa"}\n')
            time.sleep(20)

    threading.Thread(target=serve, daemon=True).start()
    stream = readers.socket_json(spark, "127.0.0.1", server.getsockname()[1], schemas.CITY)
    q = stream.writeStream.format("memory").queryName("cities").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while spark.table("cities").count() < 2 and time.time() < until:
            time.sleep(0.5)
        got = spark.table("cities").collect()
    finally:
        q.stop()
        server.close()
    assert {r["city"] for r in got if r["city"]} == {"Phoenix", "Mesa"} and all(r["timestamp"] for r in got)


def test_default_triggers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"city": "Phoenix"}\n')
    stream = readers.file_json(spark, str(tmp_path / "in"), schemas.CITY)
    q = jobs.start_bloom_report(stream, str(tmp_path / "fpr"), every="1 second")
    try:
        until = time.time() + 60
        while not (tmp_path / "fpr").exists() and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert (tmp_path / "fpr").read_text().splitlines()[0] == "Time,FPR"


def test_report_formats(spark, tmp_path):
    text = lambda: (tmp_path / "f").read_text()
    path = str(tmp_path / "f")
    writers.similarity_csv(spark.createDataFrame([("a", "b", 0.5)], "x string, y string, s double"), path)
    assert text() == "business_id_1, business_id_2, similarity\na, b, 0.5\n"
    writers.prediction_csv(spark.createDataFrame([("u", "b", 3.0)], "x string, y string, s double"), path)
    assert text() == "user_id, business_id, prediction\nu, b, 3.0\n"
    writers.betweenness_lines(spark.createDataFrame([("a", "b", 1.5)], "a string, b string, value double"), path)
    assert text() == "('a', 'b'), 1.5\n"
    writers.bfr_report(spark.createDataFrame([(1, 5, 2, 3, 4)], "round int, n_ds long, n_cs_clusters int, n_cs long, n_rs long"), spark.createDataFrame([(1, 0), (0, -1)], "id int, cluster int"), path)
    assert text() == "The intermediate results:\nRound 1: 5,2,3,4\n\nThe clustering results:\n0,-1\n1,0\n"
    assert writers.console("Duration", 1.5) == "Duration: 1.5" and writers.console("x", "y") == "x: y"


def test_both_ways_are_timed(spark):
    assert all(v > 0 for v in relational.both_ways(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "v").values())


def test_sorted_baskets_and_long_tags(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c"), ("x", "b"), (None, "d")], "k string, i string")
    assert {r["basket"]: r["items"] for r in itemsets.sorted_baskets(itemsets.baskets(df, "k", "i")).collect()} == {"x": ["a", "b"], "y": ["c"]}
    tag = "t" * 1_200_000
    assert spark.createDataFrame([(f"#{tag}",)], "t string").select(F.length(hashtags(F.col("t"))[0])).first()[0] == len(tag)


def test_draws_beyond_31_bits(spark):
    for n in (7, 2**31 + 5, 10**10 + 1, 2**40):
        assert spark.range(1).select(sketches.draw(F.lit(n).cast("long"), 42)).first()[0] == ((n * 1103515245 + 42 * 12345) % 2**31) % n + 1


def test_tables_are_cleared(spark, tmp_path):
    df = scratch.settled(spark.range(3))
    kept = list(scratch._written)
    try:
        scratch._written[:] = kept[-1:]
        scratch.clear(spark)
        assert not scratch._written and not __import__("os").path.exists(kept[-1].removeprefix("file://")) and df is not None
    finally:
        scratch._written[:] = kept[:-1]
