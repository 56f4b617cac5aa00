"""The same searches on streams: a search keeps no state, so that its conditions run unchanged on what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import matches, text_tokens
from ..operators.signatures import signature


def stream_matches(stream: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    return matches(stream, pattern, text)


def stream_indexed(stream: DataFrame, mapping: dict[str, int], text: str = "text") -> DataFrame:
    """Signature and token columns for rows as they arrive."""
    return stream.withColumn("sig", signature(F.col(text), mapping)).withColumn("tokens", text_tokens(F.col(text)))


def windowed_matches(stream: DataFrame, pattern: str, time: str = "ts", text: str = "text", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Matches in each window of event time."""
    found = matches(stream.withWatermark(time, late), pattern, text)
    return found.groupBy(F.window(time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
