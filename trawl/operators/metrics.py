"""Measures of searches and of generated patterns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def nearest_ranks(rows: DataFrame, value: str, ps: dict[str, float], *keys: str) -> DataFrame:
    """For each key the values ``sorted(values)[int(p * (n - 1))]``; equal values are counted together before they are ordered."""
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counted.withColumn("_upto", upto).withColumn("_total", total)
    reached = {name: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_total") - 1)), F.col("_v"))).alias(name) for name, p in ps.items()}
    return placed.groupBy(*keys).agg(*reached.values())


def latency_summary(runs: DataFrame, time: str = "duration_ms", ok: str = "ok", *keys: str) -> DataFrame:
    """n, average and nearest-rank p50 and p90 of the runs that went well."""
    good = runs.filter(F.col(ok))
    rows = good.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(time), 6).alias("avg"))
    ranks = nearest_ranks(good, time, {"p50": 0.5, "p90": 0.9}, *keys)
    return rows.join(ranks, list(keys)) if keys else rows.crossJoin(ranks)  # one row each


def linear_percentiles(runs: DataFrame, time: str, *keys: str) -> DataFrame:
    """Average, maximum and interpolated p90 and p99."""
    ranks = F.percentile(time, F.array(F.lit(0.9), F.lit(0.99)))
    out = runs.groupBy(*keys).agg(F.round(F.avg(time), 6).alias("avg"), F.max(time).alias("max"), ranks.alias("_p"))
    return out.withColumn("p90", F.round(F.col("_p")[0], 6)).withColumn("p99", F.round(F.col("_p")[1], 6)).drop("_p")


def recall_of_arrays(got: Column, gold: Column) -> Column:
    """Share of the gold set that was found; 1 for an empty gold set."""
    gold_set = F.array_distinct(gold)
    return F.when(F.size(gold_set) == 0, 1.0).otherwise(F.size(F.array_intersect(got, gold_set)) / F.size(gold_set))


def recall(gold: DataFrame, got: DataFrame, keys: list[str], value: str, queries: DataFrame | None = None) -> DataFrame:
    """Recall of every query from rows (query, value), by a join; queries without gold rows have recall 1."""
    both = gold.select(*keys, value).distinct().join(got.select(*keys, value).distinct().withColumn("_hit", F.lit(1)), [*keys, value], "left")
    each = both.groupBy(*keys).agg(F.count("*").alias("n_gold"), F.count("_hit").alias("n_hit"))
    if queries is not None:
        each = queries.select(*keys).distinct().join(each, keys, "left").fillna(0, ["n_gold", "n_hit"])
    return each.withColumn("recall", F.round(F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_gold")), 6))


def recall_summary(each: DataFrame) -> DataFrame:
    """Macro: mean over queries; micro: all hits over all gold rows."""
    total = F.sum("n_gold")
    return each.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("macro"), F.round(F.when(total == 0, 1.0).otherwise(F.sum("n_hit") / total), 6).alias("micro"))


def method_table(queries: DataFrame) -> DataFrame:
    """From rows (qid, kind, execution_time_ms, count, error): time and recall of each kind against the kind ``base``.

    Queries whose base failed or found nothing are left out.
    """
    good = queries.filter("error is null")
    base = good.filter("kind = 'base' and count > 0").select("qid", F.col("count").alias("base_count"))
    rows = good.join(base, "qid")
    share = F.least(F.lit(1.0), F.col("count") / F.col("base_count"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("execution_time_ms"), 6).alias("avg_ms"), F.round(F.avg(share), 6).alias("avg_recall"))


def pass_at_k(results: DataFrame, k: int, item: str = "id", passed: str = "passed") -> DataFrame:
    """Unbiased pass@k of every item: 1 minus the probability that k drawn completions all fail."""
    each = results.groupBy(item).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("c"))
    product = F.aggregate(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(float(k)) / i))
    return each.withColumn("score", F.round(F.when(F.col("n") - F.col("c") < k, 1.0).when(F.col("c") == 0, 0.0).otherwise(1 - product), 6))


def mean_pass_at(results: DataFrame, ks: tuple[int, ...] = (1, 3, 10), item: str = "id", passed: str = "passed") -> DataFrame:
    """Rows (k, score): the mean over items, null where some item has fewer than k completions. Serves vul@k as well."""
    out = []
    for k in ks:
        each = pass_at_k(results, k, item, passed)
        out.append(each.agg(F.lit(k).alias("k"), F.when(F.min("n") >= k, F.round(F.avg("score"), 6)).alias("score")))
    return reduce(DataFrame.unionByName, out)


def any_in_first_k(results: DataFrame, k: int, item: str = "id", order: str = "seq", passed: str = "passed") -> DataFrame:
    """Percentage of items with a success among their first k completions."""
    first = results.withColumn("_rank", F.row_number().over(Window.partitionBy(item).orderBy(order))).filter(F.col("_rank") <= k)
    each = first.groupBy(item).agg(F.max(F.col(passed).cast("int")).alias("hit"))
    return each.agg(F.lit(k).alias("k"), F.round(100 * F.avg("hit"), 6).alias("percent"))


def exact_match(results: DataFrame, predicted: str = "completion", gold: str = "expression", item: str = "id") -> DataFrame:
    """Hits over all completions, in percent of the items."""
    return results.agg(F.count_if(F.col(predicted) == F.col(gold)).alias("hits"), F.count_distinct(item).alias("items")).withColumn("percent", F.round(100 * F.col("hits") / F.col("items"), 6))


def reason_histogram(reasons: DataFrame, column: str = "reason") -> DataFrame:
    return reasons.groupBy(column).agg(F.count("*").alias("n"))


def compile_and_match(items: DataFrame) -> DataFrame:
    """From rows (id, completion, matches, non_matches): does the completion compile, and accept and refuse what it should.

    Patterns run in Python with a bound on the texts' length; catastrophic ones are stopped by the time limit of the task.
    """
    @pandas_udf("struct<compiled:boolean,passed:boolean>")
    def check(completion: pd.Series, good: pd.Series, bad: pd.Series) -> pd.DataFrame:
        import regex

        rows = []
        for pattern, yes, no in zip(completion, good, bad, strict=True):
            try:
                compiled = regex.compile(pattern or "(")
                accepts = lambda x: compiled.fullmatch(x, timeout=60) is not None  # noqa: E731, B023
                rows.append((True, all(map(accepts, yes if yes is not None else ())) and not any(map(accepts, no if no is not None else ()))))
            except regex.error:
                rows.append((False, False))
            except TimeoutError:
                rows.append((True, False))
        return pd.DataFrame(rows, columns=["compiled", "passed"])

    return items.withColumn("_r", check("completion", "matches", "non_matches")).select("*", "_r.compiled", "_r.passed").drop("_r")


def equivalence(items: DataFrame, a: str = "completion", b: str = "expression") -> DataFrame:
    """Adds ``equivalent``: do both patterns match the same strings; null where that can't be decided."""
    @pandas_udf("boolean")
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        from ..functions.automata import equivalent

        return pd.Series([None if x is None or y is None else equivalent(x, y) for x, y in zip(left, right, strict=True)], dtype=object)

    return items.withColumn("equivalent", same(a, b))


def parse_vulnerability_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows (id, vulnerable) from log lines ``id: verdict``; lines without a verdict are skipped."""
    found = lines.select(F.regexp_extract(column, r"^\s*([0-9]+)\s*[:,\t]", 1).alias("id"), F.upper(F.regexp_extract(column, r"(?i)\b(not[ _-]?vulnerable|vulnerable|safe|true|false)\b", 1)).alias("verdict"))
    found = found.filter("id <> '' and verdict <> ''")
    return found.select(F.col("id").cast("long"), F.col("verdict").isin("VULNERABLE", "TRUE").alias("vulnerable"))


def parse_status_log(lines: DataFrame, column: str = "value", per_item: int = 10) -> DataFrame:
    """Rows (id, vulnerable) from lines ``n: status`` or ``n failed: ...``; n counts the completions of all items, from 1."""
    found = lines.select(F.regexp_extract(column, r"^\s*([0-9]+)( failed)?", 1).alias("n"), F.col(column).rlike(r"^\s*[0-9]+ failed").alias("failed"), F.trim(F.split(column, ":")[1]).alias("status"))
    number = F.expr(f"(cast(n as bigint) - 1) div {per_item}")
    return found.filter("n <> ''").select(number.alias("id"), F.coalesce(~F.col("failed") & (F.col("status") == "success"), F.lit(False)).alias("vulnerable"))


#: What separates the sections of the other log; readers take it as the separator of lines.
SECTION = "-------------------------"


def parse_section_log(sections: DataFrame, column: str = "value", offset: int = 0, per_item: int = 10) -> DataFrame:
    """Rows (id, pattern, vulnerable) from sections of three lines: ``id: n``, the pattern, the result; shorter ones are skipped."""
    lines = F.split(F.regexp_replace(column, r"\A\n", ""), "\n")
    found = sections.select(lines.alias("l")).filter(F.size("l") >= 3)
    number = F.trim(F.element_at(F.split(F.col("l")[0], ":"), -1)).cast("long")
    return found.select(number.alias("n"), F.trim(F.col("l")[1]).alias("pattern"), (F.trim(F.col("l")[2]) == "RESULT-TRUE").alias("vulnerable")).select(F.expr(f"(n + {offset} - 1) div {per_item}").alias("id"), "pattern", "vulnerable")
