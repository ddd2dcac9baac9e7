import json

from siftmine.operators import relational, sketches
from siftmine.sources import readers, schemas, writers
from siftmine.streaming import jobs


def test_json_csv_and_matrix(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in [{"user_id": "u", "business_id": "b", "date": "2018-01-02", "stars": 4.0}, {"user_id": "v", "business_id": "b", "date": "x2018", "stars": 1}]))
    r = readers.json_lines(spark, str(tmp_path / "r.json"), schemas.REVIEW, 2)
    assert r.rdd.getNumPartitions() == 2
    got = relational.review_stats(r).first()
    assert (got["n_review"], got["n_review_year"], got["n_user"], got["n_business"], got["top10_business"]) == (2, 2, 2, 1, '[["b", 2]]')
    (tmp_path / "p.csv").write_text("user_id,business_id\nu,b\nv,c\n")
    assert readers.csv_rows(spark, str(tmp_path / "p.csv"), schemas.PAIR).count() == 2
    (tmp_path / "m.csv").write_text("0,3,1.5,2\n1,4,0,-1\n")
    assert [tuple(x) for x in readers.matrix(spark, str(tmp_path / "m.csv"), 2).orderBy("id").collect()] == [(0, 3, [1.5, 2.0]), (1, 4, [0.0, -1.0])]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1.5), ("c", 2.0)], "city string, stars double").orderBy("city")
    writers.city_csv(df, str(tmp_path / "c"))
    assert (tmp_path / "c").read_bytes() == b'city,stars\r\n"a, b",1.5\r\nc,2.0\r\n'
    writers.itemset_report([("a",), ("b", "a")], [("a",)], str(tmp_path / "i"))
    assert (tmp_path / "i").read_text() == "Candidates:\n('a')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a')"
    writers.community_lines(spark.createDataFrame([(["a", "b"],)], "members array<string>"), str(tmp_path / "m"))
    assert (tmp_path / "m").read_text() == "'a', 'b'\n"
    writers.append_line(str(tmp_path / "t"), "Time,FPR", ["now", 0.5])
    writers.append_line(str(tmp_path / "t"), "Time,FPR", ["then", 0.25])
    assert (tmp_path / "t").read_text() == "Time,FPR\nnow,0.5\nthen,0.25\n"
    assert json.loads(writers.json_report(df.limit(1)).first()[0])[0]["stars"] == 1.5


def test_partition_layout_counts_empty_parts(spark):
    got = relational.partition_layout(spark.range(3).repartition(8), 8).collect()
    assert len(got) == 8 and sum(r["n_items"] for r in got) == 3


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"city": "x"}\nnot json\n')
    q = readers.file_json(spark, str(tmp_path / "in"), schemas.CITY).select("city").writeStream.format("memory").queryName("cities").trigger(availableNow=True).start()
    jobs.drain(q)
    assert [r["city"] for r in spark.table("cities").collect() if r["city"]] == ["x"]


def test_stream_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, names in enumerate((["x", "y", "x"], ["z"], [])):
        (tmp_path / "in" / f"{k}.txt").write_text("".join(json.dumps({"city": c}) + "\n" for c in names))
    stream = readers.file_json(spark, str(tmp_path / "in"), schemas.CITY)
    jobs.drain(jobs.start_bloom_report(stream, str(tmp_path / "fpr"), every=None))
    lines = (tmp_path / "fpr").read_text().splitlines()
    assert lines[0] == "Time,FPR" and len(lines) >= 3 and all(0 <= float(x.split(",")[1]) <= 1 for x in lines[1:])
    stream = readers.file_json(spark, str(tmp_path / "in"), schemas.CITY).withColumnRenamed("timestamp", "ts")
    jobs.drain(jobs.start_fm_report(stream, str(tmp_path / "fm"), every=None))
    lines = (tmp_path / "fm").read_text().splitlines()
    assert lines[0] == "Time,Gound Truth,Estimation" and "3" in {x.split(",")[1] for x in lines[1:]}


def test_retracted_counts(spark):
    tags = lambda *t: spark.createDataFrame([(x,) for x in t], "tag string")
    got = sketches.retracted_counts(tags("a", "a", "b"), tags("b", "a")).collect()
    assert {r["tag"]: r["n"] for r in got} == {"a": 1, "b": 0}
