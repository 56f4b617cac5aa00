"""Many patterns in one job instead of many clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex_dialect import to_java
from .grams import candidates, gram_plan
from .search import pg_rlike, prefilter

#: Patterns that one projection counts; more go through the postings.
PROJECTED = 50


def pattern_counts(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Rows (pid, n): matches of every pattern, from one scan."""
    column, tests = F.col(text), []
    for pid, pattern in patterns.items():
        before = prefilter(column, pattern)
        test = pg_rlike(column, pattern)
        tests.append(F.count_if(test if before is None else before & test).alias(pid))
    counted = df.agg(*tests)
    pairs = F.explode(F.array(*[F.struct(F.lit(pid).alias("pid"), F.col(f"`{pid}`").alias("n")) for pid in patterns]))
    return counted.select(pairs.alias("p")).select("p.pid", "p.n")


def scan_ids(df: DataFrame, patterns: dict[str, str], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (pid, doc_id) from one scan, each pattern behind its own prefilter."""
    column, found = F.col(text), []
    for pid, pattern in patterns.items():
        before, test = prefilter(column, pattern), pg_rlike(column, pattern)
        found.append(F.when(test if before is None else before & test, F.lit(pid)))
    rows = df.select(F.col(id_col).alias("doc_id"), F.explode(F.array_compact(F.array(*found))).alias("pid"))
    return rows.select("pid", "doc_id")


def pattern_ids(df: DataFrame, patterns: dict[str, str], rows: DataFrame, n: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (pid, doc_id): postings give all patterns' candidates at once; patterns without grams are checked on every row."""
    plans = {pid: gram_plan(p, n) for pid, p in patterns.items()}
    java = {pid: to_java(p) for pid, p in patterns.items()}
    docs, out = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), None
    pruned = {pid: plan for pid, plan in plans.items() if plan.kind != "TRUE"}
    if pruned:
        table = df.sparkSession.createDataFrame([(pid, java[pid]) for pid in pruned], "pid string, pattern string")
        found = candidates(rows, pruned).join(F.broadcast(table), "pid").join(docs, "doc_id")
        out = found.filter(F.expr("rlike(_text, pattern)")).select("pid", "doc_id")
    rest = {pid: p for pid, p in patterns.items() if pid not in pruned}
    if rest:
        scanned = scan_ids(df, rest, text, id_col)
        out = scanned if out is None else out.unionByName(scanned)
    return out


def self_check(seeds: DataFrame, pattern: str = "pattern", text: str = "seed") -> DataFrame:
    """Whether each row's own pattern finds its own text; the pattern is Java's."""
    return seeds.withColumn("matches_seed", F.expr(f"rlike({text}, {pattern})"))


def patterns_table(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(pid, p, to_java(p)) for pid, p in patterns.items()], "pid string, pattern string, java string")
