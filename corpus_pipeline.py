"""A corpus from raw documents to packed sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import stages
from clickloom.llm.common import read, written

#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.not_toxic),
    ("ngram_jaccard_join", stages.first_of_near_copies),
    ("suffix_array_dedup", stages.deduplicated),
    ("benchmark_decontamination", stages.decontaminated),
    ("best_fit_packing", stages.packed),
]

#: SQL cannot express the classifier, the index and the packing; tests hold the near-copy stage against brute force and the
#: others to their columns and row counts, as the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
