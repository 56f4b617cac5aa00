"""Boolean conditions on literals that every match of a pattern must meet, and Spark columns made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """``kind`` is AND, OR, LEAF or TRUE; a leaf holds a literal that must occur."""

    kind: str
    literal: str = ""
    parts: tuple[Plan, ...] = ()

    def __str__(self) -> str:
        if self.kind in ("LEAF", "TRUE"):
            return repr(self.literal) if self.kind == "LEAF" else "TRUE"
        return f"{self.kind}({', '.join(map(str, self.parts))})"


TRUE = Plan("TRUE")


def leaf(literal: str) -> Plan:
    return Plan("LEAF", literal) if literal else TRUE


def all_of(*parts: Plan) -> Plan:
    return simplify(Plan("AND", parts=parts))


def any_of(*parts: Plan) -> Plan:
    return simplify(Plan("OR", parts=parts))


def simplify(plan: Plan) -> Plan:
    """Flatten, drop TRUE from AND, let TRUE absorb OR, and drop literals that others imply."""
    if plan.kind not in ("AND", "OR"):
        return plan
    parts: list[Plan] = []
    for part in map(simplify, plan.parts):
        parts += part.parts if part.kind == plan.kind else [part]
    if plan.kind == "OR" and any(p.kind == "TRUE" for p in parts):
        return TRUE
    parts = list(dict.fromkeys(p for p in parts if p.kind != "TRUE"))
    leaves = [p.literal for p in parts if p.kind == "LEAF"]
    implied = (lambda a, b: a in b) if plan.kind == "AND" else (lambda a, b: b in a)
    parts = [p for p in parts if p.kind != "LEAF" or not any(p.literal != x and implied(p.literal, x) for x in leaves)]
    if not parts:
        return TRUE
    return parts[0] if len(parts) == 1 else replace(plan, parts=tuple(parts), literal="")


def leaves(plan: Plan) -> Iterator[str]:
    if plan.kind == "LEAF":
        yield plan.literal
    for part in plan.parts:
        yield from leaves(part)


def substitute(plan: Plan, change: Callable[[str], Plan]) -> Plan:
    """Put a plan in the place of each literal."""
    if plan.kind == "LEAF":
        return change(plan.literal)
    return simplify(replace(plan, parts=tuple(substitute(p, change) for p in plan.parts)))


def conjuncts(plan: Plan) -> list[list[str]]:
    """The plan as a conjunction of disjunctions of literals; no conjunct at all for TRUE.

    A disjunction with a conjunction inside is weakened to one literal of each, the longest, which keeps it necessary.
    """
    if plan.kind == "TRUE":
        return []
    if plan.kind == "LEAF":
        return [[plan.literal]]
    if plan.kind == "AND":
        return [c for part in plan.parts for c in conjuncts(part)]
    out: list[str] = []
    for part in plan.parts:
        best = max(conjuncts(part), key=lambda c: min(map(len, c)), default=None)
        if best is None:
            return []
        out += best
    return [list(dict.fromkeys(out))]


def holds(plan: Plan, text: str, ignore_case: bool = False) -> bool:
    text = text.lower() if ignore_case else text
    if plan.kind == "LEAF":
        return plan.literal in text
    if plan.kind == "AND":
        return all(holds(p, text) for p in plan.parts)
    return plan.kind == "TRUE" or any(holds(p, text) for p in plan.parts)


def to_column(plan: Plan, column: Column, ignore_case: bool = False) -> Column | None:
    """The plan as ``contains`` conditions, which Spark pushes to the scan; None for TRUE."""
    if ignore_case:
        return to_column(plan, F.lower(column))
    if plan.kind == "TRUE":
        return None
    if plan.kind == "LEAF":
        return F.contains(column, F.lit(plan.literal))
    parts = [to_column(p, column) for p in plan.parts]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if plan.kind == "AND" else out | part
    return out


def tokens_plan_holds(plan: Plan, tokens: set[str]) -> bool:
    """The plan against a set of grams or tokens."""
    if plan.kind == "LEAF":
        return plan.literal in tokens
    if plan.kind == "AND":
        return all(tokens_plan_holds(p, tokens) for p in plan.parts)
    return plan.kind == "TRUE" or any(tokens_plan_holds(p, tokens) for p in plan.parts)
