"""Write a parsed pattern for Java (Spark's ``rlike``), RE2 (DuckDB) or Python's ``re``.

Boundaries and classes are those of ASCII by default, which all three engines agree on; ``unicode=True`` uses Java's and Python's
own ``\\b``. Every class is written as a bracket of ranges, so that a gap like ``(?:.|\\n){0,90}`` is a repeated class: Java runs
the alternation recursively and can end the whole JVM on long texts.
"""

from __future__ import annotations

from functools import lru_cache

from .regex_ast import ANY, Alt, Back, Cat, Chars, Edge, Group, Look, Node, Regex, RegexError, Rep, parse

_W = "[A-Za-z0-9_]"
_EDGES = {
    "start": r"\A",
    "end": r"\z",
    "boundary": f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))",
    "inside": f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))",
    "word_start": f"(?:(?<!{_W})(?={_W}))",
    "word_end": f"(?:(?<={_W})(?!{_W}))",
}
_SPECIAL = set(r"\^$.|?*+()[]{}-&~#/ ")


def _code(target: str, code: int) -> str:
    sign = chr(code)
    if code > 126 or code < 32:
        if target == "python":
            return f"\\x{code:02x}" if code < 256 else f"\\u{code:04x}" if code < 65536 else f"\\U{code:08x}"
        return f"\\x{{{code:x}}}"
    return "\\" + sign if sign in _SPECIAL and not (target == "re2" and sign in "&~#/ ") else sign


def _chars(target: str, node: Chars) -> str:
    if node.ranges == ANY:
        return r"[\s\S]"
    if not node.ranges:
        return r"[^\s\S]"
    if node.single is not None:
        return _code(target, ord(node.single))
    ranges = node.ranges
    return "[" + "".join(_code(target, lo) + ("" if lo == hi else ("-" if hi > lo + 1 else "") + _code(target, hi)) for lo, hi in ranges) + "]"


def _write(target: str, node: Node, unicode: bool, longest: bool) -> str:
    go = lambda n: _write(target, n, unicode, longest)
    if isinstance(node, Chars):
        return _chars(target, node)
    if isinstance(node, Cat):
        return "".join(go(p) for p in node.parts)
    if isinstance(node, Alt):
        parts = node.parts
        if longest and all(_literal(p) is not None for p in parts):
            parts = sorted(parts, key=lambda p: -len(_literal(p) or ""))
        return "(?:" + "|".join(go(p) for p in parts) + ")"
    if isinstance(node, Group):
        return f"({go(node.child)})"
    if isinstance(node, Rep):
        low, high = node.low, node.high
        sign = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or ("{%d}" % low if high == low else "{%d,%s}" % (low, "" if high is None else high))
        return f"(?:{go(node.child)}){sign}{'?' * node.lazy}" if not isinstance(node.child, Chars | Group) else f"{go(node.child)}{sign}{'?' * node.lazy}"
    if isinstance(node, Edge):
        if target == "re2":
            if node.kind in ("word_start", "word_end"):
                raise RegexError("ESCAPE_UNSUPPORTED", f"{node.kind} can't be written for RE2")
            return {"start": r"\A", "end": r"\z", "boundary": r"\b", "inside": r"\B"}[node.kind]
        if unicode and node.kind in ("boundary", "inside"):
            return r"\b" if node.kind == "boundary" else r"\B"
        return r"\Z" if target == "python" and node.kind == "end" else _EDGES[node.kind]
    if isinstance(node, Look):
        if target == "re2":
            raise RegexError("ESCAPE_UNSUPPORTED", "RE2 has no lookaround")
        return f"(?{'' if node.ahead else '<'}{'!' if node.negative else '='}{go(node.child)})"
    if isinstance(node, Back):
        if target == "re2":
            raise RegexError("UNSUPPORTED_BACKREFERENCE", "RE2 has no backreference")
        return f"\\{node.number}"
    raise TypeError(node)


def _literal(node: Node) -> str | None:
    if isinstance(node, Chars):
        return node.single
    if isinstance(node, Cat):
        parts = [_literal(p) for p in node.parts]
        return None if None in parts else "".join(parts)
    return None


@lru_cache(maxsize=4096)
def _translated(target: str, source: str, dialect: str, unicode: bool, longest: bool) -> str:
    regex = parse(source, dialect)
    return ("(?i)" if regex.ignore_case else "") + _write(target, regex.tree, unicode, longest)


def to_java(source: str | Regex, dialect: str = "are", unicode: bool = False, longest: bool = False) -> str:
    return _translated("java", source.source if isinstance(source, Regex) else source, dialect, unicode, longest)


def to_re2(source: str | Regex, dialect: str = "are") -> str:
    return _translated("re2", source.source if isinstance(source, Regex) else source, dialect, False, False)


def to_python(source: str | Regex, dialect: str = "are", unicode: bool = False, longest: bool = False) -> str:
    return _translated("python", source.source if isinstance(source, Regex) else source, dialect, unicode, longest)


def unescape_pattern(pattern: str) -> str:
    """Undo doubled backslashes, as often as they were doubled."""
    while "\\\\" in pattern:
        pattern = pattern.replace("\\\\", "\\")
    return pattern
