"""The corpus pipeline: documents to packed training sequences, in stages that are each written and read again.

Every stage works on all that the one before it kept:
toxicity drops documents that score as toxic; line dedup takes later copies of three-line windows out of texts; the n-gram
Jaccard join (five words, 0.8) keeps one document of each component; decontamination drops documents that hold a
benchmark window; packing lays the rest out as sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import decontam, fitpack, linededup, ratjoin, toxickn
from cardloom.llm.base import keep, new_path, table, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more; labels of the held-out quarter are not used."""
    labels = table(spark, sf_dir, "labels").where(~toxickn.held_out(F.col("doc_id")))
    return toxickn.score_toxicity(docs.select(*COLUMNS), labels).where(F.col("toxicity_") < toxickn.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated three-line windows cut out; n_chars follows."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("lines_removed_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of the least id."""
    return ratjoin.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = keep(found.where(F.col("at_").isNotNull()).select("id_", "key_").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= ratjoin.SMALL else bad
    d = docs.select(*COLUMNS).withColumn("text_key_", text_key(F.col("text")))
    return d.join(bad, d["doc_id"].eqNullSafe(bad["id_"]) & (d["text_key_"] == bad["key_"]), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return fitpack.pack(docs, fitpack.public("byte_bpe_50k.json"), added=True).drop("key_").withColumnRenamed("id_", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier, components and a packing plan are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
