"""Make search workloads from seed texts: patterns that find their seed and show a given share of its characters.

A seed's tokens offer islands: structured tokens (with digits or hyphens) as classes, and n-grams of a pool with some slack around
them. Islands are chosen by rarity and place until the budget of shown characters is used, and joined by gaps. Every pattern is
checked against its own seed. Choices depend on the seed alone, so that a workload is the same however its rows are spread.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import gram_df

# The token pattern, the gaps and the defaults of `Policy` are those of the workload files.
TOKEN = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*|[^\w\s]"
GAPS = {"anychar": r"(?:.|\n)", "space": "[[:space:]]", "nonword": "[^A-Za-z0-9_]"}


@dataclass(frozen=True)
class Policy:
    """How patterns are made."""

    n: int = 3
    expose: float = 0.3
    struct_ratio: float = 0.5
    gap: str = "anychar"
    gap_base: int = 90
    gap_per_token: int = 20
    gap_cap: int = 260
    slack: int = 2
    k_max: int = 6
    max_per_seed: int = 1
    digits: str = "generalize"  # digits of structured tokens: generalize, literal, or mixed with the probability below
    generalize_prob: float = 0.7
    alternative: str = "light"  # whether the last character of a gram may be any word character: light or off
    cap_side: int = 10
    ignore_case: bool = False


def tokens(column: Column) -> Column:
    """Tokens and punctuation marks; letters of any alphabet count as word characters."""
    return F.regexp_extract_all(column, F.lit("(?U)" + TOKEN), F.lit(0))


def word_chars(column: Column) -> Column:
    return F.regexp_count(column, F.lit("[A-Za-z0-9_]"))


def is_structured(token: str) -> bool:
    return any(c.isdigit() for c in token) or "-" in token


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def render_structured(token: str, general: bool) -> str:
    """The token with its runs of digits as classes with counts, or the token itself."""
    if not general:
        return _escaped(token)
    return "".join(f"[0-9]{{{len(run)}}}" if run[0].isdigit() else _escaped(run) for run in re.findall(r"[0-9]+|[^0-9]+", token))


def _side(low: int, high: int) -> str:
    """Between ``low`` and ``high`` word characters."""
    if high <= 0:
        return ""
    count = "" if low == high == 1 else f"{{{low}}}" if low == high else f"{{{low},{high}}}"
    return "[A-Za-z0-9_]" + count


def render_gram(token: str, gram: str, slack: int, cap: int = 10, alternative: str = "light") -> str:
    """A token around its gram: as many word characters before and after as it has, give or take the slack, at most ``cap`` a side."""
    at = token.index(gram)
    sides = []
    for count in (at, len(token) - at - len(gram)):
        high = min(count + max(0, slack), cap)
        sides.append(_side(min(max(0, count - max(0, slack)), high), high))
    core = f"(?:{gram}|{gram[:-1]}[A-Za-z0-9_])" if alternative == "light" and len(gram) in (2, 3) else gram
    return sides[0] + core + sides[1]


def usable_grams(token: str, pool: dict[str, int], policy: Policy) -> list[tuple[int, str]]:
    """The pool's grams of a token with their frequencies, rarest first; a side longer than the cap wouldn't match the token itself."""
    grams = {token[a : a + policy.n] for a in range(len(token) - policy.n + 1)}
    return sorted((pool[g], g) for g in grams if g in pool and max(token.index(g), len(token) - token.index(g) - len(g)) <= policy.cap_side)


def gap(policy: Policy, distance: int) -> str:
    """A lazy gap, wider for more tokens between."""
    return f"{GAPS[policy.gap]}{{0,{min(policy.gap_cap, policy.gap_base + policy.gap_per_token * max(0, distance))}}}?"


def make_pattern(seed: str, pool: dict[str, int], policy: Policy, number: int = 0) -> dict | None:
    """A pattern for the seed with its islands and exposure; None if nothing can be shown."""
    spans = [(m.start(), m.end()) for m in re.finditer(TOKEN, seed, re.ASCII)]
    found = [seed[a:b] for a, b in spans]
    words = [(i, t) for i, t in enumerate(found) if re.match(r"[A-Za-z0-9]", t)]
    total = sum(len(t) for _, t in words)
    budget = math.ceil(policy.expose * total)
    found_grams = {t: usable_grams(t, pool, policy) for _, t in words if not is_structured(t)}
    most = sum(len(t) if is_structured(t) else policy.n * bool(found_grams[t]) for _, t in words)
    raw, budget = budget, min(budget, most)
    rng = random.Random(zlib.crc32(seed.encode()) * 1009 + number)
    struct = [(i, t) for i, t in words if is_structured(t)]
    rng.shuffle(struct)
    grams = []
    for i, t in words:
        if not is_structured(t):
            best = found_grams[t][:12]
            grams += [((1 + 0.03 * min(len(t), 30)) / (df + 1), i, t, g) for df, g in best]
    grams.sort(key=lambda x: (-x[0], x[1], x[3]))
    islands, shown = [], 0
    for i, t in struct:
        if len(islands) >= policy.k_max or shown >= budget * policy.struct_ratio:
            break
        general = policy.digits == "generalize" or policy.digits == "mixed" and rng.random() < policy.generalize_prob
        islands.append({"kind": "struct", "pos": i, "tok": t, "expose_len": len(t), "text": render_structured(t, general)})
        shown += len(t)
    used = {x["pos"] for x in islands}
    for _, i, t, g in grams:
        if len(islands) >= policy.k_max or shown >= budget:
            break
        if i not in used:
            used.add(i)
            islands.append({"kind": "ngram", "pos": i, "tok": t, "expose_len": len(g), "text": render_gram(t, g, policy.slack, policy.cap_side, policy.alternative)})
            shown += len(g)
    if not islands:
        return None
    islands.sort(key=lambda x: x["pos"])
    kept, pattern = [], ""
    for x in islands:  # an island that the gap after the last one can't reach is left out
        between = gap(policy, x["pos"] - kept[-1]["pos"] - 1) if kept else ""
        if kept and spans[x["pos"]][0] - spans[kept[-1]["pos"]][1] > int(between[between.rindex(",") + 1 : -2]):
            continue
        kept.append(x)
        pattern += between + r"\y" + x["text"] + r"\y"
    islands, shown = kept, sum(x["expose_len"] for x in kept)
    n_struct = sum(x["kind"] == "struct" for x in islands)
    by_struct = sum(x["expose_len"] for x in islands if x["kind"] == "struct")
    exposure = (total, raw, budget, most, shown, policy.expose, shown / max(1, total), len(islands), n_struct, len(islands) - n_struct, policy.struct_ratio, by_struct / max(1, shown), policy.digits, policy.generalize_prob, policy.alternative)
    return {"exposure": exposure, "regex": ("(?i)" if policy.ignore_case else "") + pattern, "n_islands": len(islands), "exposed_len": shown, "word_chars": total, "kept_positions": [x["pos"] for x in islands], "kinds": [x["kind"] for x in islands]}


def gram_pool(docs: DataFrame, n: int, low: int, share: float, text: str = "text", id_col: str = "doc_id", most: int = 62**3) -> DataFrame:
    """Grams of word characters that at least ``low`` texts and at most this share of the texts hold, the rarest ``most``.

    The upper bound grows with the table and the lower one doesn't, so that no gram leaves the pool as the same kind of text goes
    on; ``most`` is the number of all grams of three word characters.
    """
    total = docs.count()
    found = gram_df(docs, n, text, id_col).filter(F.col("df").between(low, max(low, share * total)) & F.col("gram").rlike(r"\A[A-Za-z0-9]+\z"))
    return found.orderBy("df", "gram").limit(most)


#: Grams of a pool at most, as it goes to every task.
POOL = 300_000
EXPOSURE = (
    "struct<word_chars_total:int,budget_raw:int,budget_capped:int,max_possible:int,exposed_len:int,expose_ratio_target:double,expose_ratio_actual:double,n_islands:int,n_struct:int,n_ngram:int,"
    "struct_ratio_target:double,struct_ratio_actual:double,struct_digit_mode:string,struct_generalize_prob:double,ngram_alt_mode:string>"
)


def best_grams(tokens_of: DataFrame, pool: DataFrame, n: int = 3, most: int = 12, token: str = "token") -> DataFrame:
    """Rows (token, gram, df, rank): the rarest grams of the pool in each distinct token, ties by gram."""
    grams = tokens_of.select(F.col(token).alias("token")).distinct().select("token", F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))).alias("gram"))
    ranked = grams.join(pool.select("gram", "df"), "gram").withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("df", "gram")))
    return ranked.filter(F.col("rank") <= most).select("token", "gram", "df", "rank")


def generate(seeds: DataFrame, pool: DataFrame, policy: Policy | None = None, text: str = "text", id_col: str = "doc_id", max_per_regex: int | None = None) -> DataFrame:
    """Rows (seed_id, seed_string, regex, exposure...) without repeated patterns of a seed, and at most so many rows of one pattern.

    The pool goes to every task; one of more than ``POOL`` grams is refused.
    """
    policy = policy or Policy()
    grams = pool.select("gram", "df").limit(POOL + 1).collect()
    if len(grams) > POOL:
        raise ValueError(f"a pool has at most {POOL} grams")
    known = seeds.sparkSession.sparkContext.broadcast({r["gram"]: r["df"] for r in grams})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seed_id, seed in zip(batch["id"], batch["text"], strict=True):
                for number in range(policy.max_per_seed if seed else 0):
                    made = make_pattern(seed, known.value, policy, number)
                    if made:
                        rows.append((seed_id, seed, made["regex"], made["n_islands"], made["exposed_len"], made["word_chars"], made["exposed_len"] / max(1, made["word_chars"]), made["kept_positions"], made["kinds"], made["exposure"]))
            yield pd.DataFrame(rows, columns=["seed_id", "seed_string", "regex", "n_islands", "exposed_len", "word_chars", "expose_ratio", "kept_positions", "kinds", "exposure"])

    schema = "seed_id long, seed_string string, regex string, n_islands int, exposed_len int, word_chars int, expose_ratio double, kept_positions array<int>, kinds array<string>, exposure " + EXPOSURE
    made = seeds.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema)
    made = made.withColumn("regex_hash", F.xxhash64("regex")).dropDuplicates(["seed_id", "regex_hash"])
    return made if max_per_regex is None else cap_per_key(made, "regex", max_per_regex, "seed_id")


def dedup_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def cap_per_key(df: DataFrame, key: str, cap: int, *order: str) -> DataFrame:
    """At most ``cap`` rows of each key, the first in the order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= cap).drop("_rank")


def struct_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Tokens, structured tokens, their share, its bin, purely alphabetic tokens, and a diversity score per row."""
    found = tokens(F.col(text))
    rows = df.withColumn("_words", F.filter(found, lambda t: t.rlike("^[A-Za-z0-9]")))
    n, s = F.size("_words"), F.size(F.filter("_words", lambda t: t.rlike("[0-9-]")))
    rows = rows.withColumn("n_tokens", n).withColumn("n_struct", s).withColumn("n_alpha", F.size(F.filter("_words", lambda t: t.rlike(r"\A[A-Za-z]+\z"))))
    rows = rows.withColumn("struct_ratio", F.round(F.when(n > 0, s / n).otherwise(0.0), 6)).drop("_words")
    ratio = F.col("struct_ratio")
    return rows.withColumn("bin", F.when(ratio == 0, 0).when(ratio < 0.25, 1).when(ratio < 0.5, 2).otherwise(3)).withColumn("diversity", F.when(ratio >= 0.5, 1.0).when(ratio >= 0.25, 0.9).when(ratio > 0, 0.65).otherwise(0.35))


def positive_pairs(items: DataFrame, cap: int = 5) -> DataFrame:
    """Rows (id, regex, positive_example), at most ``cap`` of an item."""
    rows = items.select("id", F.col("expression").alias("regex"), F.posexplode("matches").alias("pos", "positive_example"))
    return rows.filter((F.col("pos") < cap) & (F.length("positive_example") > 0)).select("id", "regex", "positive_example")


def expand_digits(items: DataFrame) -> DataFrame:
    """Ten examples for single-digit patterns and for fixed runs of digits."""
    run = F.regexp_extract("expression", r"^\^\\d(?:\{([0-9]+)\})?\$$", 1)
    wide = F.when(F.col("expression") == r"^\d$", F.lit(1)).when(run != "", F.expr("try_cast(regexp_extract(expression, '^\\\\^\\\\\\\\d\\\\{([0-9]+)\\\\}\\\\$$', 1) AS INT)"))
    rows = items.withColumn("_n", wide).filter("_n is not null").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return rows.select("id", F.col("expression").alias("regex"), F.expr("repeat(cast(_d AS STRING), _n)").alias("positive_example"))
