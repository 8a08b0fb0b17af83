"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each around one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, jaccard, packing, suffixes, toxicity
from clickloom.llm.common import read, small_batches, written

#: Words of a shingle and the Jaccard similarity in percent from which documents link; op4's own defaults are its query's.
SHINGLE, PERCENT = 5, 80


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingle sets link, directly or through others, the one with the least id."""
    small_batches(spark)
    groups = jaccard.near_copies(docs.select("doc_id", "text"), n=SHINGLE, percent=PERCENT)
    gone = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "stage-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat an earlier one; n_chars is that of the rest."""
    small_batches(spark)
    return suffixes.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.join(written(found.select("doc_id").distinct(), "stage-leaks"), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    small_batches(spark)
    return packing.pack(written(packing.pieces(docs.select("doc_id", "text"), with_ids=False), "pieces"))
