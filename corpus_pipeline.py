"""A training corpus from raw documents: quality classifier, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with all columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import line_crf, minhash, packing, weak_quality
from trawl.llm.common import Scratch, read_table, tune


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier keeps."""
    tune(spark)
    return weak_quality.keep(docs, weak_quality.train(docs)[1])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    tune(spark)
    return line_crf.keep(docs, line_crf.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, in one row."""
    tune(spark)
    return minhash.survivors(docs, Scratch(spark, "pipeline-near-dedup"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    tune(spark)
    return packing.pack_documents(docs, Scratch(spark, "pipeline-packing"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("packing", best_fit_packing),
]

#: The classifier's and the line model's fits can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = scratch.table(docs, f"stage-{number}")
    return docs
