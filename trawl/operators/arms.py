"""Choose how to run a pattern by measuring on a sample: the pattern alone, or behind two or three literals."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex_analysis import analyze
from .search import literal_prefilter, pg_rlike, where

ARMS = ("direct", "3way", "multiway")


@dataclass
class Choice:
    """The arm chosen, the medians it was chosen by, and why."""

    pattern: str
    arm: str
    reason: str
    times: dict[str, float] = field(default_factory=dict)
    literals: list[str] = field(default_factory=list)


def arm_filter(pattern: str, arm: str, text: str = "text") -> Column | None:
    return literal_prefilter(F.col(text), pattern, arm)


def run_arm(df: DataFrame, pattern: str, arm: str, text: str = "text") -> int:
    return where(df, arm_filter(pattern, arm, text), pg_rlike(F.col(text), pattern)).count()


def measure(sample: DataFrame, pattern: str, arm: str, warm: int = 1, rounds: int = 5, text: str = "text") -> float:
    """Median seconds after warming up."""
    times = []
    for number in range(warm + rounds):
        began = time.perf_counter()
        run_arm(sample, pattern, arm, text)
        if number >= warm:
            times.append(time.perf_counter() - began)
    return median(times)


def choose_arm(pattern: str, cost: Callable[[str], float], preference: float = 0.03) -> Choice:
    """The cheapest arm, but ``direct`` unless another saves more than ``preference``."""
    found = analyze(pattern)
    if not found.literals:
        return Choice(pattern, "direct", found.reason if found.reason != "OK" else "CHARCLASS_ONLY")
    times = {arm: cost(arm) for arm in ARMS if arm != "multiway" or len(found.literals) > 2}
    best = min(times, key=lambda a: (times[a], ARMS.index(a)))
    if times[best] >= (1 - preference) * times["direct"]:
        best = "direct"
    return Choice(pattern, best, found.reason, times, list(found.literals))


def policy_key(table: str, column: str, pattern: str, mode: str = "count") -> str:
    return hashlib.sha256("\x1f".join((table, column, pattern, mode)).encode()).hexdigest()


class PolicyCache:
    """Choices kept in a JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.known = json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, key: str) -> Choice | None:
        return Choice(**self.known[key]) if key in self.known else None

    def put(self, key: str, choice: Choice) -> None:
        self.known[key] = asdict(choice)
        self.path.write_text(json.dumps(self.known, indent=1))


def adaptive_count(df: DataFrame, pattern: str, sample: DataFrame, cache: PolicyCache | None = None, table: str = "", text: str = "text", cost: Callable[[str], float] | None = None) -> tuple[int, Choice]:
    """Count with the arm that measures best on the sample; a known choice is not measured again."""
    key = policy_key(table, text, pattern)
    choice = cache.get(key) if cache else None
    if choice is None:
        choice = choose_arm(pattern, cost or (lambda arm: measure(sample, pattern, arm, text=text)))
        if cache:
            cache.put(key, choice)
    return run_arm(df, pattern, choice.arm, text), choice
