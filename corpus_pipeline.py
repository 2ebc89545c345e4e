"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next one's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm import decontamination, language, neardup, packing, repeats
from learnlog.llm.common import materialize
from learnlog.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the centroids know; rejected ones (null, without letters, too far from
    every centroid) go. The model learns from the documents themselves, without fold 2 of 4."""
    model = language.train(docs.where(language.id_fold("doc_id", 4) != 2))
    return language.identify(docs, model, columns=list(COLUMNS)).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of rows
    repeated as a whole one stays. Rows without id are in no group."""
    kept = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    stay = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    return (stay.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))
            .dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document with a smaller doc_id has too; n_chars
    is that of the remaining text, which may be empty."""
    left = repeats.remove_repeats(docs, kept_col="text", columns=("lang", "source"))
    kind = docs.schema["n_chars"].dataType
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast(kind).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark text."""
    return decontamination.without_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed into sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Trained centroids and a byte-level BPE are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
