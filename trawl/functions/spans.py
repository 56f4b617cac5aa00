"""Spans of matches: 1-based places of characters, the end included. Null in, null out; places outside the text match nothing.

Patterns are translated for Python's ``re``, whose search from a place keeps the context to its left. Alternatives are tried in
their order; ``longest`` puts longer literals first. The tests ask whether some match ends where it should, not only the one that
the engine prefers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .regex_analysis import max_length, min_length
from .regex_ast import Alt, Cat, Edge, Group, Look, Node, Rep, parse
from .regex_dialect import to_java, to_python


def _source(pattern: str) -> tuple[str, int]:
    """The pattern for Python without its flag, and the flag."""
    source = to_python(pattern)
    return (source[4:], re.IGNORECASE) if source.startswith("(?i)") else (source, 0)


@lru_cache(maxsize=512)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(*_source(pattern))


@lru_cache(maxsize=2048)
def _pinned(pattern: str, context: int) -> re.Pattern:
    """The pattern where just so many characters follow it in the part that is searched."""
    source, flags = _source(pattern)
    return re.compile(f"(?:{source})(?=[\\s\\S]{{{context}}}\\Z)", flags)


def _ahead(node: Node) -> int | None:
    """How many characters behind its end a match may look at; None without a bound."""
    if isinstance(node, Edge):
        return 1
    if isinstance(node, Look):
        sizes = [max_length(node.child) if node.ahead else 0, _ahead(node.child)]
        return None if None in sizes else sum(sizes) + 1
    parts = node.parts if isinstance(node, Cat | Alt) else (node.child,) if isinstance(node, Group | Rep) else ()
    sizes = [_ahead(part) for part in parts]
    return None if None in sizes else max(sizes, default=0)


@lru_cache(maxsize=512)
def _bounds(pattern: str) -> tuple[int | None, int, int | None]:
    """How far the pattern looks ahead, and the lengths of its shortest and longest match."""
    tree = parse(pattern).tree
    return _ahead(tree), min_length(tree), max_length(tree)


def match_span(text: str, pattern: str, s: int, e: int) -> bool:
    """Does some match begin at s and end at e?"""
    if s < 1 or e < s - 1 or e > len(text):
        return False
    return _matches_to(text, pattern, s, e)


def _matches_to(text: str, pattern: str, s: int, e: int) -> bool:
    # the searched part ends a few characters behind e, as far as the pattern can look, and the match must leave just those
    ahead, shortest, longest = _bounds(pattern)
    if e - s + 1 < shortest or longest is not None and e - s + 1 > longest:
        return False
    rest = len(text) - e
    context = rest if ahead is None else min(rest, ahead)
    return _pinned(pattern, context).match(text, s - 1, e + context) is not None


def match_from_upto(text: str, pattern: str, s: int, e: int) -> bool:
    """Does some match begin at s and end at e or before?"""
    return find_at_upto(text, pattern, s, e, True) is not None


def find_from(text: str, pattern: str, s: int = 1, allow_empty: bool = False) -> tuple[int, int] | None:
    """First match at or after s."""
    if s < 1 or s > len(text) + 1:
        return None
    for m in compiled(pattern).finditer(text, s - 1):
        if allow_empty or m.end() > m.start():
            return m.start() + 1, m.end()
    return None


def find_at_upto(text: str, pattern: str, s: int, e: int, allow_empty: bool = False) -> tuple[int, int] | None:
    """The match that begins at s and ends at e or before: the preferred one, else the longest."""
    if s < 1 or s > len(text) + 1 or e > len(text):
        return None
    m = compiled(pattern).match(text, s - 1)
    if m is None:
        return None
    if m.end() <= e and (allow_empty or m.end() > m.start()):
        return s, m.end()
    _, shortest, longest = _bounds(pattern)
    most = e if longest is None else min(e, s - 1 + longest)
    for end in range(most, s - 2 + max(shortest, 0 if allow_empty else 1), -1):
        if _matches_to(text, pattern, s, end):
            return s, end
    return None


def find_all(text: str, pattern: str, s: int = 1, overlap: bool = True, allow_empty: bool = False) -> Iterator[tuple[int, int]]:
    """All matches from s on; with ``overlap`` the next search begins one after a match's start, else after its end."""
    at, regex = s - 1, compiled(pattern)
    while 0 <= at <= len(text):
        m = regex.search(text, at)
        if m is None:
            return
        if m.end() > m.start() or allow_empty:
            yield m.start() + 1, m.end()
        at = max(m.start() + 1, at + 1) if overlap else max(m.end(), m.start() + 1)


def verify_windows(text: str, pattern: str, windows: list[int], allow_empty: bool = False) -> int:
    """Index of the first window (s1, e1, s2, e2, ...) with a match that begins at s and ends at e or before; -1 for none."""
    if len(windows) % 2 or None in windows:
        raise ValueError("windows must be pairs of places")
    for i in range(0, len(windows), 2):
        if find_at_upto(text, pattern, windows[i], min(windows[i + 1], len(text)), allow_empty) is not None:
            return i // 2
    return -1


def find_literal(text: str, literal: str, overlap: bool = True) -> list[int]:
    """1-based starts of a literal."""
    out, at = [], text.find(literal) if literal else -1
    while at >= 0:
        out.append(at + 1)
        at = text.find(literal, at + (1 if overlap else len(literal)))
    return out


def _each(function: Callable, *columns: pd.Series) -> pd.Series:
    """The function's value for each row; null where any argument is null."""
    rows = zip(*columns, strict=True)
    return pd.Series([None if any(x is None or x is pd.NA or isinstance(x, float) and x != x for x in row) else function(*row) for row in rows], dtype=object)


def _listed(found: tuple[int, int] | None) -> list[int] | None:
    return None if found is None else list(found)


@pandas_udf(BooleanType())
def regex_match_span(text: pd.Series, pattern: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
    return _each(lambda t, p, a, b: match_span(t, p, int(a), int(b)), text, pattern, s, e)


@pandas_udf(BooleanType())
def regex_match_from_upto(text: pd.Series, pattern: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
    return _each(lambda t, p, a, b: match_from_upto(t, p, int(a), int(b)), text, pattern, s, e)


@pandas_udf(BooleanType())
def regex_matches(text: pd.Series, pattern: pd.Series) -> pd.Series:
    return _each(lambda t, p: compiled(p).search(t) is not None, text, pattern)


@pandas_udf(ArrayType(IntegerType()))
def regex_find_from(text: pd.Series, pattern: pd.Series, s: pd.Series) -> pd.Series:
    return _each(lambda t, p, a: _listed(find_from(t, p, int(a))), text, pattern, s)


@pandas_udf(ArrayType(IntegerType()))
def regex_find_from_or_empty(text: pd.Series, pattern: pd.Series, s: pd.Series, allow_empty: pd.Series) -> pd.Series:
    return _each(lambda t, p, a, empty: _listed(find_from(t, p, int(a), bool(empty))), text, pattern, s, allow_empty)


@pandas_udf(ArrayType(IntegerType()))
def regex_find_at_upto(text: pd.Series, pattern: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
    return _each(lambda t, p, a, b: _listed(find_at_upto(t, p, int(a), int(b))), text, pattern, s, e)


@pandas_udf(ArrayType(IntegerType()))
def regex_find_at_upto_or_empty(text: pd.Series, pattern: pd.Series, s: pd.Series, e: pd.Series, allow_empty: pd.Series) -> pd.Series:
    return _each(lambda t, p, a, b, empty: _listed(find_at_upto(t, p, int(a), int(b), bool(empty))), text, pattern, s, e, allow_empty)


@pandas_udf(ArrayType(ArrayType(IntegerType())))
def regex_find_all_array(text: pd.Series, pattern: pd.Series, overlap: pd.Series) -> pd.Series:
    return _each(lambda t, p, o: [list(x) for x in find_all(t, p, overlap=bool(o))], text, pattern, overlap)


@pandas_udf(IntegerType())
def regex_verify_windows(text: pd.Series, pattern: pd.Series, windows: pd.Series) -> pd.Series:
    return _each(lambda t, p, w: verify_windows(t, p, list(w)), text, pattern, windows)


@pandas_udf(IntegerType())
def regex_verify_windows_or_empty(text: pd.Series, pattern: pd.Series, windows: pd.Series, allow_empty: pd.Series) -> pd.Series:
    return _each(lambda t, p, w, empty: verify_windows(t, p, list(w), bool(empty)), text, pattern, windows, allow_empty)


@udtf(returnType=StructType([StructField("s", IntegerType()), StructField("e", IntegerType())]))
class RegexFindAll:
    """``regex_find_all(text, pattern, overlap, s, allow_empty)`` as a table; the last two may be left out."""

    def eval(self, text: str, pattern: str, overlap: bool = True, s: int = 1, allow_empty: bool = False):
        if text is not None and pattern is not None:
            yield from find_all(text, pattern, int(s), bool(overlap), bool(allow_empty))


def like(column: Column, pattern: str) -> Column:
    """``column ~ pattern`` in the dialect, without Python."""
    return column.rlike(to_java(pattern))


def register(spark: SparkSession) -> None:
    """Give SQL the dialect's match and all span functions; those that end in ``_or_empty`` also say whether matches may be empty."""
    functions = [regex_matches, regex_match_span, regex_match_from_upto, regex_find_from, regex_find_from_or_empty, regex_find_at_upto, regex_find_at_upto_or_empty, regex_find_all_array, regex_verify_windows, regex_verify_windows_or_empty]
    names = "regex_matches regex_match_span regex_match_from_upto regex_find_from regex_find_from_or_empty regex_find_at_upto regex_find_at_upto_or_empty regex_find_all_array regex_verify_windows regex_verify_windows_or_empty"
    for name, function in zip(names.split(), functions, strict=True):
        spark.udf.register(name, function)
    spark.udtf.register("regex_find_all", RegexFindAll)


def first_span(column: Column, java: str) -> Column:
    """The first match's span without Python; null if there is none."""
    found = F.regexp_substr(column, F.lit(java))
    start = F.regexp_instr(column, F.lit(java))
    return F.when(start > 0, F.struct(start.alias("s"), (start + F.length(found) - 1).alias("e")))


def span_count(column: Column, java: str, overlap: bool = False) -> Column:
    """Number of matches without Python; overlapping ones by places where a match begins."""
    return F.regexp_count(column, F.lit(f"(?={java})" if overlap else java))


def in_window(places: Column, s: Column, e: Column, size: int) -> Column:
    """Does a literal of this size with these starts lie inside s..e?"""
    return F.exists(places, lambda p: (p >= s) & (p <= e - size + 1))


def merged_places(places: Column) -> Column:
    """The union of several sorted lists of places, sorted and without repeats."""
    return F.array_sort(F.array_distinct(F.flatten(places)))


def literal_places(df: DataFrame, literal: str, text: str = "text", overlap: bool = True) -> DataFrame:
    """Adds ``places``: the 1-based starts of a literal."""

    @pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else find_literal(t, literal, overlap) for t in texts], dtype=object)

    return df.withColumn("places", places(F.col(text)))
