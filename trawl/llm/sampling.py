"""A bounded sample of documents to fit a model on, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of the documents with the ``size`` smallest hashes of their ids, one row each; the first pass reads ids alone.

    Of several rows of a document it takes the smallest text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    chosen = docs.filter(F.col("doc_id").isin([row[0] for row in ids.collect()]))
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"))
