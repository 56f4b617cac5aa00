"""Search a text column with a pattern: cheap necessary conditions first, the pattern itself last.

Every search is a scan with pushed-down ``contains`` conditions and one ``rlike``; Spark keeps the order of conjuncts, so that the
cheap ones run first. Results are counts, ids, the first k ids or the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex_analysis import analyze, select_literals, tokens_of_pattern
from ..functions.regex_ast import RegexError
from ..functions.regex_dialect import to_java
from ..plans.prefilter import to_column

#: Usual names of text columns, the likeliest first.
TEXT_COLUMNS = ("text_content", "content", "body", "comment", "name", "text", "title", "primaryname")


def text_column_of(df: DataFrame) -> str:
    """The text column: one with a usual name, else the first that is neither an id nor anything but a string."""
    by_name = {c.lower(): c for c in df.columns}
    for name in TEXT_COLUMNS:
        if name in by_name:
            return by_name[name]
    strings = [c for c, kind in df.dtypes if kind == "string" and not c.lower().endswith("id")]
    if not strings:
        raise ValueError("no text column")
    return strings[0]


def pg_rlike(column: Column, pattern: str, ignore_case: bool = False, unicode: bool = False) -> Column:
    """``column ~ pattern`` (or ``~*``): an unanchored search, null for null."""
    java = to_java(pattern, unicode=unicode)
    return column.rlike("(?i)" + java if ignore_case and not java.startswith("(?i)") else java)


def prefilter(column: Column, pattern: str, ignore_case: bool = False, lengths: bool = False) -> Column | None:
    """Conditions that every match meets; None if there are none."""
    found = analyze(pattern)
    folded = ignore_case or found.case_mode == "insensitive"
    plan = analyze("(?i)" + pattern).plan if ignore_case and found.case_mode != "insensitive" else found.plan
    out = to_column(plan, column, folded)
    if lengths and found.min_length > 0:
        enough = F.length(column) >= found.min_length
        out = enough if out is None else out & enough
    return out


def literal_prefilter(column: Column, pattern: str, mode: str = "3way") -> Column | None:
    """The longest required literals alone: two for ``3way``, three for ``multiway``."""
    found = analyze(pattern)
    out = None
    for literal in select_literals(found.literals, mode):
        test = F.contains(F.lower(column) if found.case_mode != "sensitive" else column, F.lit(literal))
        out = test if out is None else out & test
    return out


def ilike_prefilter(column: Column, pattern: str, k: int = 2) -> Column | None:
    """``ILIKE`` on the k longest literals."""
    out = None
    for literal in analyze(pattern).literals[:k]:
        escaped = literal.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        test = column.ilike(f"%{escaped}%")
        out = test if out is None else out & test
    return out


def where(df: DataFrame, *conditions: Column | str | None) -> DataFrame:
    """Conjunction of conditions; a caller's own SQL text is one of them."""
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def matches(df: DataFrame, pattern: str, text: str = "text", ignore_case: bool = False, filtered: bool = True, lengths: bool = False, user_where: Column | str | None = None) -> DataFrame:
    """Rows whose text matches."""
    column = F.col(text)
    return where(df, user_where, prefilter(column, pattern, ignore_case, lengths) if filtered else None, pg_rlike(column, pattern, ignore_case))


def search(df: DataFrame, pattern: str, mode: str = "count", text: str = "text", id_col: str = "doc_id", k: int = 100, **options) -> DataFrame:
    """``count``, ``ids``, ``topk`` (the k smallest ids) or ``texts`` of the matching rows."""
    found = matches(df, pattern, text, **options)
    if mode == "count":
        return found.agg(F.count("*").alias("n"))
    if mode == "ids":
        return found.select(id_col)
    if mode == "topk":
        return found.select(id_col).orderBy(id_col).limit(k)
    if mode == "texts":
        return found.select(id_col, text)
    raise ValueError(mode)


def candidate_counts(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows, candidates and matches in one pass, and the share of candidates."""
    condition = prefilter(F.col(text), pattern)
    condition = F.lit(True) if condition is None else condition
    out = df.agg(F.count("*").alias("n_rows"), F.count_if(condition).alias("n_candidates"), F.count_if(pg_rlike(F.col(text), pattern)).alias("n_matches"))
    return out.withColumn("candidate_ratio", F.round(F.col("n_candidates") / F.col("n_rows"), 6))


def starts_with(df: DataFrame, prefix: str, pattern: str | None = None, text: str = "text", ignore_case: bool = False) -> DataFrame:
    """Approximate search by prefix, then the pattern. On a table in the order of the text, row groups are skipped."""
    column = F.col(text)
    test = F.startswith(F.lower(column), F.lit(prefix.lower())) if ignore_case else F.startswith(column, F.lit(prefix))
    return where(df, test, pg_rlike(column, pattern) if pattern else None)


def text_tokens(column: Column) -> Column:
    """Lower-case tokens ``[a-z0-9_-]+`` as an array without empty ones."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(column), "[^a-z0-9_-]+", " "), r"\s+"), "")


def has_tokens(tokens: Column, wanted: list[str]) -> Column:
    """``tokens @> wanted``."""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), tokens)) == 0


def holds_tokens(column: Column, wanted: list[str]) -> Column:
    """The same test on the text itself, without an array of its tokens."""
    low, out = F.lower(column), F.lit(True)
    for w in wanted:
        out = out & F.contains(low, F.lit(w))
    for w in wanted:
        out = out & low.rlike(f"(?<![a-z0-9_-]){w}(?![a-z0-9_-])")
    return out


def token_search(df: DataFrame, pattern: str, text: str = "text", most: int = 3) -> DataFrame:
    """Rows that hold the pattern's whole tokens, then the pattern."""
    wanted = tokens_of_pattern(pattern, most)
    return where(df, holds_tokens(F.col(text), wanted) if wanted else None, pg_rlike(F.col(text), pattern))


def explain_arms(df: DataFrame, pattern: str, text: str = "text") -> dict[str, str]:
    """The condition that each arm would run, as Spark writes it."""
    out = {}
    for arm in ("direct", "3way", "multiway"):
        rows = where(df, literal_prefilter(F.col(text), pattern, arm), pg_rlike(F.col(text), pattern))
        out[arm] = rows._jdf.queryExecution().optimizedPlan().toString()
    return out


def refusal(pattern: str) -> str:
    """Why the pattern has no usable literals, or OK."""
    try:
        return analyze(pattern).reason
    except RegexError as error:
        return error.reason


def cross_check(df: DataFrame, pattern: str, text: str = "text") -> bool:
    """Whether every arm counts what the pattern alone counts."""
    column = F.col(text)
    tests = [F.lit(True) if (c := literal_prefilter(column, pattern, arm)) is None else c for arm in ("direct", "3way", "multiway")]
    row = df.agg(*[F.count_if(t & pg_rlike(column, pattern)).alias(f"n{i}") for i, t in enumerate(tests)]).first()
    return len(set(row)) == 1
