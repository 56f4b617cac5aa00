"""Candidate windows of a pattern in each text, pruned by literals and by negative grams before the pattern is run.

A match lies between an occurrence of the pattern's first literal and one of its last. Windows from there are bounded by the
lengths of matches; a window without all required literals goes (M), and so does one whose mandatory beginning holds a gram that
no match holds (N). What remains is verified in place. The boolean answer is always that of the pattern; windows only say where.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automata import negative_grams
from ..functions.regex_analysis import Analysis, analyze
from ..functions.spans import find_from, find_literal, verify_windows
from .search import prefilter, where

#: Windows of one text beyond which the text is verified as a whole, grams tried as negative, negative grams used.
EXPLOSION, TRIED, NEGATIVES = 20_000, 64, 4


@dataclass
class Pruning:
    """Counts of what happened to one text's windows."""

    windows: int = 0
    after_m: int = 0
    after_n: int = 0
    fallback: bool = False


def _starts(found: Analysis, text: str) -> list[int] | None:
    """Places where a match may begin, from the first island's literal; None for any place."""
    first = found.islands[0] if found.islands else None
    if first is None or first.literal is None or not first.literal or first.gap_before != 0:
        return None
    return find_literal(text, first.literal)


def _ends(found: Analysis, text: str) -> list[int] | None:
    """Places where a match may end, from the last island's literal; None for any place."""
    last = found.islands[-1] if found.islands else None
    if last is None or not last.literal or found.regex is None or _open_end(found):
        return None
    return [p + len(last.literal) - 1 for p in find_literal(text, last.literal)]


def _open_end(found: Analysis) -> bool:
    from ..functions.regex_analysis import _is_gap
    from ..functions.regex_ast import Cat

    tree = found.regex.tree
    return _is_gap(tree.parts[-1] if isinstance(tree, Cat) and tree.parts else tree)


def windows(found: Analysis, text: str) -> tuple[list[tuple[int, int]], bool]:
    """Windows (s, e) that hold every match, and whether they are just the whole text.

    Every start goes on to the last end that the longest match allows, not to the first end found.
    """
    size = len(text)
    if found.case_mode != "sensitive":
        return [(1, size)] if size else [], True
    starts, ends = _starts(found, text), _ends(found, text)
    if starts is None:
        return [(s, size) for s in ()] or ([(1, size)] if size else []), True
    out = []
    for s in starts:
        low, high = s + max(1, found.min_length) - 1, size if found.max_length is None else min(size, s + found.max_length - 1)
        if low > size:
            continue
        if ends is None:
            out.append((s, high))
            continue
        first, last = bisect_left(ends, low), bisect_right(ends, high)
        if first < last:
            out.append((s, ends[last - 1]))
    if len(out) > EXPLOSION:
        return [(1, size)], True
    return out, False


def prune_m(found: Analysis, text: str, some: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows that hold all required literals."""
    for literal in found.literals:
        places = find_literal(text, literal)
        some = [(s, e) for s, e in some if (i := bisect_left(places, s)) < len(places) and places[i] <= e - len(literal) + 1]
    return some


def prune_n(pattern: str, found: Analysis, text: str, some: list[tuple[int, int]], size: int = 3) -> list[tuple[int, int]]:
    """Windows whose mandatory beginning, as long as the shortest match, holds no negative gram."""
    if found.min_length < size or not some:
        return some
    grams = list(dict.fromkeys(text[i : i + size] for s, _ in some[:16] for i in range(s - 1, s - 1 + found.min_length - size + 1)))[:TRIED]
    for gram in negative_grams(pattern, grams, NEGATIVES):
        places = find_literal(text, gram)
        some = [(s, e) for s, e in some if not ((i := bisect_left(places, s)) < len(places) and places[i] <= s + found.min_length - size)]
    return some


def verify(pattern: str, text: str) -> tuple[bool, Pruning]:
    """Does the text match, and how far the windows were pruned."""
    found = analyze(pattern)
    some, whole = windows(found, text)
    stats = Pruning(len(some), len(some), len(some), whole)
    if whole:
        return find_from(text, pattern, 1, True) is not None, stats
    some = prune_m(found, text, some)
    stats.after_m = len(some)
    some = prune_n(pattern, found, text, some)
    stats.after_n = len(some)
    return bool(some) and verify_windows(text, pattern, [x for w in some for x in w], True) >= 0, stats


def window_search(df: DataFrame, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, matched, n_windows, n_after_m, n_after_n) of the rows that meet the prefilter, verified window by window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *_flat(verify(pattern, t))) for i, t in zip(batch["id"], batch["text"], strict=True) if t is not None]
            yield pd.DataFrame(rows, columns=["id", "matched", "n_windows", "n_after_m", "n_after_n"])

    column = F.col(text)
    rows = where(df, prefilter(column, pattern)).select(F.col(id_col).alias("id"), column.alias("text"))
    return rows.mapInPandas(run, "id long, matched boolean, n_windows long, n_after_m long, n_after_n long")


def _flat(result: tuple[bool, Pruning]) -> tuple[bool, int, int, int]:
    matched, stats = result
    return matched, stats.windows, stats.after_m, stats.after_n
