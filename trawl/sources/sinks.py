"""Sinks: result files, pattern lists, samples, text-ordered and token tables, replaced partitions."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import text_tokens


def write_json(rows: list[dict], path: str) -> None:
    """A small result list; the file appears whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(rows, ensure_ascii=False, indent=1, default=str))
    os.replace(part, target)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_patterns(workload: DataFrame, path: str, pattern: str = "regex") -> None:
    """One pattern a line."""
    workload.select(F.col(pattern).alias("value")).filter("value is not null").write.mode("overwrite").text(path)


def write_sample(df: DataFrame, column: str, path: str, k: int = 10_000, seed: int = 42) -> None:
    """k random values of one column as CSV."""
    df.select(column).orderBy(F.rand(seed)).limit(k).write.mode("overwrite").option("header", True).csv(path)


def write_prefix_table(df: DataFrame, path: str, text: str = "text") -> None:
    """The table in the order of its text, so that a prefix search reads few row groups."""
    df.repartitionByRange(F.col(text)).sortWithinPartitions(text).write.mode("overwrite").parquet(path)


def write_token_table(df: DataFrame, path: str, text: str = "text") -> None:
    df.withColumn("tokens", text_tokens(F.col(text))).write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str = "index_id") -> None:
    """Write rows by key; keys that occur replace what is there, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
