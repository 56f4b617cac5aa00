"""Bit signatures: one bit for each of the k grams that queries ask for most, a mask test before the pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex_analysis import mask_of, required_grams, signed64
from .search import pg_rlike, where


def query_gram_frequency(spark: SparkSession, patterns: list[str], n: int = 2) -> DataFrame:
    """In how many patterns each gram is required."""
    rows = [(i, g) for i, p in enumerate(patterns) for g in required_grams(p, n)]
    return spark.createDataFrame(rows, "query int, gram string").groupBy("gram").agg(F.count_distinct("query").alias("n_queries"))


def top_grams(frequency: DataFrame, k: int = 64) -> DataFrame:
    """The k most frequent, ties by gram, with bit positions from 0."""
    from pyspark.sql import Window

    ranked = frequency.orderBy(F.desc("n_queries"), "gram").limit(k)  # k rows from here on
    return ranked.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("n_queries"), "gram")) - 1).cast("int"))


def mapping_of(top: DataFrame) -> dict[str, int]:
    return {r["gram"]: r["pos"] for r in top.select("gram", "pos").collect()}


def signature(column: Column, mapping: dict[str, int]) -> Column:
    """Up to 64 bits, set for the grams that the text holds; bit 63 is the sign."""
    if any(pos > 63 for pos in mapping.values()):
        raise ValueError("more than 64 bits: use signature_words")
    bits = [F.when(F.contains(column, F.lit(g)), F.lit(signed64(1 << pos)).cast("long")).otherwise(F.lit(0).cast("long")) for g, pos in sorted(mapping.items(), key=lambda x: x[1])]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def signature_words(column: Column, mapping: dict[str, int]) -> Column:
    """Any number of bits as an array of longs."""
    words = max(mapping.values(), default=0) // 64 + 1
    return F.array(*[signature(column, {g: p - 64 * w for g, p in mapping.items() if p // 64 == w}) for w in range(words)])


def pattern_mask(pattern: str, mapping: dict[str, int], n: int = 2) -> int:
    return mask_of(required_grams(pattern, n), mapping)


def mask_test(sig: Column, mask: int) -> Column:
    """``(sig & mask) = mask``."""
    wanted = F.lit(signed64(mask)).cast("long")
    return sig.bitwiseAND(wanted) == wanted


def signature_search(signed: DataFrame, pattern: str, mapping: dict[str, int], n: int = 2, text: str = "text", sig: str = "sig") -> DataFrame:
    """Rows whose signature holds the pattern's mask, then the pattern."""
    mask = pattern_mask(pattern, mapping, n)
    return where(signed, mask_test(F.col(sig), mask) if mask else None, pg_rlike(F.col(text), pattern))


def compare_mappings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two maps hold the same grams, in the same order, and what is only in one."""
    both = a.select("gram", F.col("pos").alias("a")).join(b.select("gram", F.col("pos").alias("b")), "gram", "full_outer")
    return both.agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_different"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"),
        F.count_if(F.col("a") == F.col("b")).alias("n_same_pos"),
    ).withColumn("same_set", F.col("n_different") == 0).withColumn("same_order", (F.col("n_different") == 0) & (F.col("n_common") == F.col("n_same_pos")))


def mapping_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (gram, a, b, kind) where two maps differ: only_in_a, only_in_b, or moved to another position."""
    both = a.select("gram", F.col("pos").alias("a")).join(b.select("gram", F.col("pos").alias("b")), "gram", "full_outer")
    kind = F.when(F.col("b").isNull(), "only_in_a").when(F.col("a").isNull(), "only_in_b").when(F.col("a") != F.col("b"), "moved")
    return both.withColumn("kind", kind).filter("kind is not null")


def signature_table(df: DataFrame, mappings: dict[str, dict[str, int]], text: str = "text") -> DataFrame:
    """The table with one column ``sig_<name>_<bits>`` for each mapping, from one scan."""
    return df.withColumns({f"sig_{name}_{max(m.values()) + 1}": signature(F.col(text), m) for name, m in mappings.items()})


def write_mapping(top: DataFrame, k: int, path: str) -> None:
    import json
    from pathlib import Path

    Path(path).write_text(json.dumps({"k": k, "mapping": mapping_of(top), "stats": {"n": top.count()}}, ensure_ascii=False, indent=1))


def read_mapping(path: str) -> dict[str, int]:
    import json
    from pathlib import Path

    return {g: int(p) for g, p in json.loads(Path(path).read_text())["mapping"].items()}
