"""A corpus pipeline of five stages, each calling one operator of siftmine.llm.

Toxic documents go; of each group of near duplicates one document stays; documents that hold a benchmark passage go;
secrets are masked in the text; what is left is packed into training sequences. All stages but the last decide row by
row and return the columns they are given, whatever further columns there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmine.llm import decontaminate, jaccard, packing, secrets, toxicity
from siftmine.llm.common import crc_mod, give_back, named, scratch, table, unlike


def _only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*map(named, columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from `documents` as the labels mark them, as op4 does.

    A null or empty text has the score of no words. Repeated rows share their fate, and rows without an id are judged
    like any other. An empty table stays empty.
    """
    give_back(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rule=crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    return _only(scored.where(F.col(unlike("score", docs.columns)) < toxicity.THRESHOLD), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id (documents without an id come last), of several with
    that id the one whose set and text have the least hash, and of repeated rows any one.

    Texts without a word, null ones too, are in no group and all stay. An empty table stays empty.
    """
    give_back(spark)
    rows = jaccard.jaccard_classes(docs).where("class is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "name", "place"))
    best = rows.groupBy("class").agg(first.alias("f")).select(F.col("f.doc_id").alias("i"), F.col("f.place").alias("p"))
    others = rows.select(F.col("doc_id").alias("i"), F.col("place").alias("p")).groupBy("i", "p").agg(F.count("*").alias("copies"))
    best = best.withColumn("best", F.lit(True))
    same = lambda a, b: (a["p"] == b["p"]) & a["i"].eqNullSafe(b["i"])
    told = others.join(best, same(others, best), "left").select(others["i"], others["p"], F.col("best").isNotNull().alias("best"), "copies")
    told = scratch(told.where("not best or copies > 1"))  # all other rows stay
    i, p, b, c = (unlike(x, docs.columns) for x in ("i", "p", "best", "copies"))
    told = told.toDF(i, p, b, c)
    place = F.xxhash64(named("text").cast("string"))
    told = jaccard.small(told)
    left = docs.join(told, (place == told[p]) & named("doc_id").cast("long").eqNullSafe(told[i]), "left")
    left = left.where(F.col(b).isNull() | F.col(b))
    once = _only(left.where(F.col(b).isNull()), docs.columns)
    repeated = left.where(F.col(b)).dropDuplicates([i, p])
    return once.unionByName(_only(repeated, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, whatever their ids. Null and empty texts hold none and stay, and
    so do repeated rows of clean texts. An empty table stays empty."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars as the text then is: null for a null text, 0
    for an empty one. Repeated rows stay as many as they are, and an empty table stays empty."""
    masked = secrets.find_secrets(docs, keep=tuple(docs.columns), with_text=True)
    text = F.col(unlike("redacted", docs.columns))
    return masked.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences. A null text is an end id alone, null sources are a source, repeated rows are
    packed as often as they come, and an empty table gives no piece."""
    give_back(spark)
    return packing.pack(docs, with_ids=False).drop("source")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Of the stages the second alone could be told in SQL; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch(out) if k < len(STAGES) - 1 else out
    return docs
