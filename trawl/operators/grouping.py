"""Group patterns by shape and find prefixes that serve a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_TOKEN = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"


def normalized(pattern: Column, spaces: str = "plus", drop_counts: bool = True) -> Column:
    """A pattern's shape: runs of (escaped) spaces as one sign, counts without their numbers."""
    out = F.trim(pattern)
    if spaces != "none":
        out = F.regexp_replace(out, r"(?:\\ | |\\s[+*]?)+", r"\\s" + ("+" if spaces == "plus" else "*"))
    return F.regexp_replace(out, r"\{[0-9]+(?:,[0-9]*)?\}", "{n}") if drop_counts else out


def groups(workload: DataFrame, pattern: str = "regex", seed: str = "seed_id", sampled: int = 50) -> DataFrame:
    """One row per shape: its size, its commonest pattern (ties: the smallest), how common that is, and some seeds."""
    shaped = workload.withColumn("regex_norm", normalized(F.col(pattern)))
    each = shaped.groupBy("regex_norm", pattern).agg(F.count("*").alias("n"))
    best = each.groupBy("regex_norm").agg(F.min_by(F.struct(F.col(pattern).alias("regex_canon"), F.col("n").alias("canon_freq")), F.struct(-F.col("n"), F.col(pattern))).alias("b"), F.sum("n").alias("group_size"))
    ranked = shaped.select("regex_norm", seed).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("regex_norm").orderBy(seed)))
    seeds = ranked.filter(F.col("_rank") <= sampled).groupBy("regex_norm").agg(F.sort_array(F.collect_list(seed)).alias("seed_ids_sampled"))  # bounded lists
    return best.join(seeds, "regex_norm").select("regex_norm", "b.regex_canon", "b.canon_freq", "group_size", "seed_ids_sampled")


def shape_stats(workload: DataFrame, pattern: str = "regex") -> DataFrame:
    """Distinct patterns and shapes, and rows per shape."""
    shape = normalized(F.col(pattern))
    return workload.agg(F.count("*").alias("n_rows"), F.count_distinct(F.col(pattern)).alias("n_raw"), F.count_distinct(shape).alias("n_norm")).withColumn("norm_ratio", F.round(F.col("n_norm") / F.col("n_rows"), 6))


def key_stats(workload: DataFrame, pattern: str = "regex", anchors: str = "anchors", middle: str = "middle_blocks") -> DataFrame:
    """Rows, distinct patterns, shapes, (shape, anchors) and (shape, anchors, sorted middle), each with its share of the rows."""
    shape = normalized(F.col(pattern)).alias("shape")
    rows = workload.select(F.col(pattern).alias("raw"), shape, F.coalesce(F.col(anchors), F.array().cast("array<string>")).alias("a"), F.array_sort(F.coalesce(F.col(middle), F.array().cast("array<string>"))).alias("m"))
    keys = {"n_raw": F.col("raw"), "n_norm": F.col("shape"), "n_norm_anchors": F.struct("shape", "a"), "n_norm_anchors_mid": F.struct("shape", "a", "m")}
    out = rows.agg(F.count("*").alias("n_rows"), *[F.count_distinct(key).alias(name) for name, key in keys.items()])
    return out.select("*", *[F.round(F.when(F.col("n_rows") > 0, F.col(name) / F.col("n_rows")).otherwise(0.0), 6).alias(name.replace("n_", "ratio_", 1)) for name in keys])


def top_shapes(workload: DataFrame, k: int, pattern: str = "regex") -> DataFrame:
    """The k commonest shapes with their number of rows and share, ties by shape."""
    counted = workload.groupBy(normalized(F.col(pattern)).alias("regex_norm")).agg(F.count("*").alias("n"))
    total = workload.agg(F.count("*").alias("total"))
    top = counted.orderBy(F.desc("n"), "regex_norm").limit(k).crossJoin(F.broadcast(total))  # one row
    return top.select("regex_norm", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def group_estimates(workload: DataFrame, key: str, candidates: str, hits: str) -> DataFrame:
    """Size of each group, the exact median of its candidate estimates and the sum of its hits."""
    return workload.groupBy(key).agg(F.count("*").alias("group_size"), F.round(F.percentile(candidates, 0.5), 6).alias("cand_est_median"), F.round(F.sum(hits), 6).alias("hits_est_sum"))


def size_quantiles(sizes: DataFrame, size: str, ps: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Nearest-rank quantiles of group sizes, the rank rounded: rows (p, size). Equal sizes are counted together."""
    counted = sizes.groupBy(F.col(size).alias("size")).agg(F.count("*").alias("n"))  # few rows: distinct sizes
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)))
    total = counted.agg(F.sum("n").alias("total"))
    ranks = sizes.sparkSession.createDataFrame([(p,) for p in ps], "p double").crossJoin(F.broadcast(total))
    ranks = ranks.withColumn("rank", F.bround(F.col("p") * (F.col("total") - 1)) + 1)
    return upto.join(F.broadcast(ranks), F.col("upto") >= F.col("rank")).groupBy("p").agg(F.min("size").alias("size"))


def char_prefix(column: Column, k: int) -> Column:
    """The first k characters."""
    return F.left(column, F.lit(k))


def token_prefix(column: Column, k: int, punctuation: bool = False) -> Column:
    """The text up to the end of its k-th token, with the punctuation that follows it at once if wanted; all if it has fewer."""
    found = F.regexp_extract(column, rf"(?s)\A(?:.*?(?:{PREFIX_TOKEN})){{{k}}}" + (r"[^\w\s]*" if punctuation else ""), 0)
    return F.when(found == "", column).otherwise(found)


def prefix_candidates(rows: DataFrame, group: str, text: str, most: int = 6) -> DataFrame:
    """Rows (group, prefix, tokens) of the first 1 to ``most`` tokens of every text."""
    longest = F.array(*[F.struct(F.lit(k).alias("tokens"), F.lower(token_prefix(F.col(text), k)).alias("prefix")) for k in range(1, most + 1)])
    return rows.select(F.col(group).alias("grp"), F.col(text).alias("_text"), F.explode(longest).alias("c")).select("grp", "_text", "c.prefix", "c.tokens").filter(F.length("prefix") > 0)


def prefix_support(rows: DataFrame, group: str, text: str, most: int = 6, least: int = 1, share: float = 0.0) -> DataFrame:
    """How many texts of a group begin with each prefix (whatever the case), and their share; at least so many and such a share."""
    found = prefix_candidates(rows, group, text, most)
    support = found.groupBy("grp", "prefix").agg(F.count_distinct("_text").alias("support"), F.min("tokens").alias("len_tokens"))
    size = rows.groupBy(F.col(group).alias("grp")).agg(F.count_distinct(text).alias("size"))
    out = support.filter(F.col("support") >= least).join(size, "grp").filter(F.col("support") >= share * F.col("size"))
    return out.select("grp", "prefix", "support", F.round(F.col("support") / F.col("size"), 6).alias("support_ratio"), F.length("prefix").alias("len_chars"), "len_tokens")


def best_prefixes(support: DataFrame) -> DataFrame:
    """The best prefix of each group and length bucket: most support, then longest, then smallest."""
    bucket = F.when(F.col("len_tokens") <= 1, 0).when(F.col("len_tokens") <= 3, 1).otherwise(2)
    order = Window.partitionBy("grp", "bucket").orderBy(F.desc("support"), F.desc("len_chars"), "prefix")
    return support.withColumn("bucket", bucket).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


class PrefixProvider:
    """Prefixes for a pattern: those of its shape's group. A model can take its place with the same method."""

    def __init__(self, grouped: DataFrame, best: DataFrame):
        self.table = grouped.join(best, grouped["regex_norm"] == best["grp"])

    def prefixes(self, patterns: DataFrame, pattern: str = "regex") -> DataFrame:
        return patterns.withColumn("regex_norm", normalized(F.col(pattern))).join(self.table.select("regex_norm", "prefix", "support", "bucket"), "regex_norm", "left")


def training_rows(grouped_prefixes: DataFrame) -> DataFrame:
    """Rows (regex, prefix, weight) to train a prefix model on: more weight for more support."""
    return grouped_prefixes.select(F.col("regex_canon").alias("regex"), "prefix", F.round(F.col("support_ratio") * F.log2(F.lit(1.0) + F.col("support")), 6).alias("weight"))


def prefix_evaluation(predictions: DataFrame) -> DataFrame:
    """Shares of predictions that equal a target, begin one or are begun by one; columns (predicted, targets array<string>)."""
    exact = F.array_contains("targets", F.col("predicted"))
    begins = F.exists("targets", lambda t: t.startswith(F.col("predicted")) | F.col("predicted").startswith(t))
    return predictions.agg(F.round(F.avg(exact.cast("int")), 6).alias("exact"), F.round(F.avg(begins.cast("int")), 6).alias("startswith_any"), F.round(F.avg(F.length("predicted")), 6).alias("avg_len"))


def beam_evaluation(predictions: DataFrame) -> DataFrame:
    """Share of rows whose beam holds a target, and the mean ratio of the estimates of the first prediction and of the targets' best.

    Columns (beam array<string>, targets array<string>, estimate, best_estimate); ratios only where both are positive.
    """
    ratio = F.when((F.col("estimate") > 0) & (F.col("best_estimate") > 0), F.col("estimate") / F.col("best_estimate"))
    return predictions.agg(F.round(F.avg(F.arrays_overlap("beam", "targets").cast("int")), 6).alias("beam_hit"), F.round(F.avg(ratio), 6).alias("estimate_ratio"))
