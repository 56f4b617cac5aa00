"""Samples of rows: exact, Bernoulli, by jumps over ids, by strata, weighted, and by strides."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of ids and probes that are looked through apart, a power of two.
RANGES = 256


def exact_sample(df: DataFrame, k: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """k random rows; with ``key``, those with the smallest values, which repeats on any engine."""
    return df.orderBy(F.rand(seed) if key is None else key).limit(k)


def uniform(id_col: str) -> Column:
    """A number from 0 on and below 1 that follows from an integer id alone, the same on any engine."""
    return F.pmod(F.col(id_col) * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296.0)


def bernoulli(df: DataFrame, percent: float, limit: int | None = None, seed: int = 42, key: Column | None = None) -> DataFrame:
    """Each row with the same probability (block sampling of other engines keeps whole pages instead); with ``key`` where that is low."""
    out = df.sample(fraction=min(1.0, percent / 100), seed=seed) if key is None else df.filter(key < percent / 100)
    return out if limit is None else out.limit(limit)


def id_bounds(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.agg(F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"))


def _in_ranges(df: DataFrame, bounds: Column) -> DataFrame:
    """With ``slot``, the number of the array's bounds that are not above ``at``, found by bisection; -1 for null.

    It is never null, as the optimiser would else test that before a join, on all steps put into one expression.
    """
    df = df.withColumn("slot", F.when(F.col("at").isNotNull(), 0))
    step = RANGES // 2
    while step:
        df = df.withColumn("slot", F.col("slot") + F.when(F.col("at") >= F.get(bounds, F.col("slot") + (step - 1)), step).otherwise(0))
        step //= 2
    return df.withColumn("slot", F.coalesce("slot", F.lit(-1)))


def next_ids(df: DataFrame, probes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each distinct probe the smallest id that is not below it; null after the last, and for null.

    Ids and probes are cut into ranges that hold about as many of both, wherever they lie. Each range is one window, which runs from
    its end backwards so that a row is added once to what is behind it; the next range's first id fills its end.
    """
    ids = df.select(F.col(id_col).alias("at")).filter("at is not null")
    rows = ids.withColumn("held", F.lit(True)).unionByName(probes.select(F.col("probe").alias("at"), F.lit(False).alias("held")))
    bounds = F.lit(rows.agg(F.percentile_approx("at", [i / RANGES for i in range(1, RANGES)])).first()[0] or [])
    firsts = _in_ranges(ids, bounds).groupBy("slot").agg(F.min("at").alias("first"))  # at most RANGES rows
    ends = probes.sparkSession.range(RANGES).select(F.col("id").alias("slot")).join(firsts, "slot", "left")
    after = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("slot", F.min("first").over(after).alias("later"))
    values = rows.groupBy("at").agg(F.bool_or("held").alias("held"), F.bool_or(~F.col("held")).alias("asked"))
    onward = Window.partitionBy("slot").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    found = _in_ranges(values, bounds).withColumn("next", F.min(F.when(F.col("held"), F.col("at"))).over(onward)).filter("asked")
    return found.join(F.broadcast(ends), "slot", "left").select(F.col("at").alias("probe"), F.coalesce("next", "later", F.lit(None).cast("long")).alias("id"))


def jump_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id", attempts: int = 5, key: Column | None = None) -> DataFrame:
    """Rows next to uniform ids, without repeats, from at most ``attempts`` times n probes; ``key`` draws from the probe's number ``id``."""
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return df.limit(0)
    probes = df.sparkSession.range(n * attempts).select((F.floor((F.rand(seed) if key is None else key) * F.lit(high - low + 1)) + F.lit(low)).cast("long").alias("probe"), "id")
    first = probes.groupBy("probe").agg(F.min("id").alias("order"))
    ids = next_ids(df, first, id_col).join(first, "probe").groupBy("id").agg(F.min("order").alias("order")).orderBy("order").limit(n)
    return df.join(F.broadcast(ids.select(F.col("id").alias(id_col))), id_col, "left_semi")  # n ids


def bucket_sample(df: DataFrame, n: int, buckets: int = 20, id_col: str = "doc_id", key: Column | None = None) -> DataFrame:
    """About n / buckets rows from each of equal ranges of ids, by smallest key."""
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return df.limit(0)
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col(id_col) - F.lit(low)) * F.lit(buckets) / F.lit(high - low + 1))).cast("int")
    order = (F.col(id_col) * F.lit(2654435761)) % F.lit(4294967296) if key is None else key
    ranked = df.withColumn("bucket", bucket).withColumn("_rank", F.row_number().over(Window.partitionBy("bucket").orderBy(order, id_col)))
    return ranked.filter(F.col("_rank") <= F.ceil(F.lit(n / buckets))).drop("_rank")


def sample_docs(df: DataFrame, method: str, n: int, least: int = 1, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Sample by name; an error if fewer than ``least`` rows come out."""
    methods = {
        "exact": lambda: exact_sample(df, n, seed),
        "bernoulli": lambda: bernoulli(df, 100.0 * n / max(1, df.count()), n, seed),
        "jump": lambda: jump_sample(df, n, seed, id_col),
        "bucket": lambda: bucket_sample(df, n, id_col=id_col),
    }
    out = methods[method]()
    if out.limit(least).count() < least:
        raise ValueError(f"{method} found fewer than {least} rows")
    return out


def stride(start: int, step: int, span: int) -> int:
    """The given step or the next one that visits every place of the span."""
    step = max(1, step % span) if span > 1 else 1
    while gcd(step, span) != 1:
        step += 1
    return step


def stride_ids(spark: SparkSession, low: int, high: int, n: int, start: int = 0, step: int = 7919) -> DataFrame:
    """n ids of a walk through low..high with a step that is coprime to their number."""
    span = high - low + 1
    walk = stride(start, step, span)
    return spark.range(n).select((F.pmod(F.lit(start) + F.col("id") * F.lit(walk), F.lit(span)) + F.lit(low)).cast("long").alias("id"))


def weighted_sample(df: DataFrame, weight: str, k: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """k rows without replacement, likelier with a larger weight (Efraimidis and Spirakis)."""
    return df.filter(F.col(weight) > 0).orderBy(F.pow(F.rand(seed) if key is None else key, 1 / F.col(weight)).desc()).limit(k)


def random_ids(spark: SparkSession, low: int, high: int, n: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """n ids drawn from low..high with replacement; ``key`` draws from the row's number ``id``."""
    return spark.range(n).select((F.floor((F.rand(seed) if key is None else key) * F.lit(high - low + 1)) + F.lit(low)).cast("long").alias("id"))


def worker_ranges(spark: SparkSession, low: int, high: int, workers: int) -> DataFrame:
    """Rows (worker, first, last): the ids low..high in ranges that differ by one at most."""
    span = high - low + 1
    cut = lambda c: F.expr(f"cast(({c}) * {span} div {workers} + {low} as bigint)")
    return spark.range(workers).select(F.col("id").alias("worker"), cut("id").alias("first"), (cut("id + 1") - 1).alias("last")).filter("first <= last")


class EstimateCache:
    """Estimates that are made once for each condition."""

    def __init__(self, df: DataFrame, percent: float, rounds: int = 3, seed: int = 42):
        self.df, self.options, self.known = df, (percent, rounds, seed), {}

    def matches(self, name: str, condition: Column) -> float:
        if name not in self.known:
            self.known[name] = estimate_matches(self.df, condition, *self.options)
        return self.known[name]


def estimate_matches(df: DataFrame, condition: Column, percent: float, rounds: int = 3, seed: int = 42) -> float:
    """Median over sampled rounds of the scaled count."""
    counts = sorted(df.sample(fraction=percent / 100, seed=seed + i).filter(condition).count() * 100 / percent for i in range(rounds))
    return counts[len(counts) // 2] if len(counts) % 2 else (counts[len(counts) // 2 - 1] + counts[len(counts) // 2]) / 2
