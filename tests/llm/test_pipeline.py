"""The pipeline's stages against plain versions, and on odd documents."""

import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import duckdb
import pytest

import corpus_pipeline
from siftmine.llm import common, decontaminate, packing, secrets, tokens, toxicity
from siftmine.llm.common import crc_mod, scratch, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(spark, outputs):
    assert [n for n, _, _ in outputs] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for _, before, after in outputs[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.dtypes == before.dtypes


def test_toxicity(spark, outputs):
    _, before, after = outputs[0]
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"), rule=crc_mod("doc_id", 3) != 1)
    words = toxicity.WordBuckets()
    plain = {d for d, r in rows(before).items() if model.score(model.responses(words.of(r["text"]))) < 0.7}
    assert set(rows(after)) == plain


def test_near_duplicates(outputs):
    _, before, after = outputs[1]
    b, sets = rows(before), {}
    for d, r in b.items():
        w = r["text"].encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {d: d for d in b}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    for p in {(x, y) for v in where.values() if len(v) < 300 for x in v for y in v if x < y}:
        i = len(sets[p[0]] & sets[p[1]])
        if 100 * i >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - i):
            x, y = sorted(map(find, p))
            root[y] = x
    assert set(rows(after)) == {d for d in b if find(d) == d}


def test_decontamination(outputs):
    _, before, after = outputs[2]
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    items = decontaminate.Items(bench, 0.1)
    assert set(rows(after)) == {d for d, r in rows(before).items() if not items.find(decontaminate.folded(r["text"]))}
    assert len(rows(after)) < len(rows(before))


def test_secrets(outputs):
    _, before, after = outputs[3]
    a, b, n = rows(after), rows(before), 0
    for d, r in b.items():
        found = secrets.spans(r["text"])
        n += bool(found)
        assert a[d]["text"] == secrets.redact(r["text"], found) and a[d]["n_chars"] == len(a[d]["text"])
    assert n and set(a) == set(b)


def test_packing(outputs):
    _, before, after = outputs[4]
    e = tokens.PieceEncoder(tokens.vocabulary())
    total = sum(len(e.tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows(before).values())
    got = after.collect()
    assert sum(r["length"] for r in got) == total and {r["doc_id"] for r in got} == set(rows(before))
    assert max(r["sequence_id"] for r in got) + 1 == -(-total // 2048)


def test_odd_documents(spark):
    text = "".join(chr(97 + i % 26) + " " for i in range(40))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (3, text, "en", "s", 80), (3, text, "en", "s", 80), (4, text, "en", "s", 80), (5, "word " * 30000, "en", None, 150000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch(stage(spark, docs, SF))
        left = [r["doc_id"] for r in docs.collect()]
        if name == "near_duplicates":
            assert sorted(map(str, left)) == ["1", "2", "3", "5", "None"]  # of copies without an id one stays, too
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), SF).count() == 0, name


def test_rows_are_told_apart_whatever_their_ids(spark):
    """And columns whose names the operators use themselves."""
    item = duckdb.sql(f"select text from '{SF}/benchmark.parquet' where text is not null order by length(text) limit 1").fetchall()[0][0]
    base, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [
        (None, " ".join(f"c{i}" for i in range(40)) + f" so: {item}", "en", "s"), (7, f"and {item}", "en", "s"), (7, base, "en", "s"), (7, other, "en", "s"), (None, base, "en", "s"), (9, other, "en", "s"), (9, "password: hunter2hunter2", "en", None), (None, None, None, None), (None, None, None, None),
    ]
    names = ["score", "spans", "redacted", "_text", "found", "name", "class", "place", "i", "p", "best", "copies", "a.b", "_score"]
    extra = list(range(len(names)))
    docs = spark.createDataFrame([(*r, 3, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)).repartition(2)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch(stage(spark, docs, SF))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        left[name] = sorted(str((r["doc_id"], (r["text"] or "")[:5])) for r in after.collect())
        assert all([r[n] for n in names] == extra for r in after.collect())
        docs = after
    assert left["near_duplicates"].count("(7, 'a0 a1')") == 1 and left["near_duplicates"].count("(None, 'a0 a1')") == 0
    assert left["near_duplicates"].count("(7, 'b0 b1')") == 1 and left["near_duplicates"].count("(9, 'b0 b1')") == 0
    assert "(None, 'c0 c1')" in left["near_duplicates"] and not any("c0 c1" in x or "and" in x for x in left["decontamination"]) and left["decontamination"].count("(None, '')") == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_the_rest_stands_alone():
    code = "import sys; sys.modules['siftmine.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'grouped_mean_topk' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(corpus_pipeline.__file__)))


def test_the_rest_runs_without_the_folders(tmp_path):
    """With both folders and the pipeline gone, a query and its tests still run."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_plans.py"], check=True, cwd=tmp_path / "r")


def test_stages_let_go_of_what_others_kept(spark):
    """Steps that keep nothing empty the Python worker's memory, and give_back() has executors collect garbage too."""
    steps = [lambda: toxicity._word_rows(iter([])), lambda: toxicity._score(iter([]), SimpleNamespace(value=SimpleNamespace(wide=2))), lambda: secrets._scan(iter([]), False), lambda: packing._pieces(iter([]), SimpleNamespace(value=None), 8, False)]
    for step in steps:
        assert common.kept("tokens of another stage", lambda: [1]) == [1]
        assert list(step()) == [] and not common._kept
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    before = count()
    common.give_back(spark)
    assert count() >= before + 2  # the driver's, and those of tasks
