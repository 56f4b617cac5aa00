"""The parser, its translations and the analyses, by cases and by random patterns."""

import random
import re

import pytest

# Patterns and expected values of the published cases are fixed values, from FIXTURES.md 1.7 to 1.10.

from trawl.functions import automata, spans
from trawl.functions.regex_analysis import analyze, explain_mask, select_literals, signed64, tokens_of_pattern
from trawl.functions.regex_ast import RegexError, parse
from trawl.functions.regex_dialect import to_java, to_python, to_re2, unescape_pattern
from trawl.operators.windows import verify
from trawl.plans.prefilter import Plan, conjuncts, holds, leaf, simplify


@pytest.mark.parametrize(
    ("pattern", "plan"),
    [
        (r"\yCA\-274\y", "'CA-274'"),
        ("(?:foo|bar)", "OR('foo', 'bar')"),
        (r"(?:.|\n){0,3}?abc", "'abc'"),
        (r"(foo)\1", "'foo'"),
        ("(?=foo)bar", "'bar'"),
        ("[A-Za-z0-9_]{2,2}ego[A-Za-z0-9_]{0,0}", "'ego'"),
        (r"\yI\-5\y", "'I-5'"),
        ("^foo", "'foo'"),
        (r"\d{3}x", "'x'"),
        (r"\y[0-9]{10}\y", "TRUE"),
        ("x(?:abc|de)y", "AND(OR('abc', 'de'), 'x', 'y')"),
        ("(?:vi|v[a-z])", "'v'"),
        ("(?i)FOO", "'foo'"),
        ("ab?c", "AND('a', 'c')"),
        ("(?:ab[A-Z]{2}|abCD)", "'ab'"),
        ("(?:ab){3}c", "'abababc'"),
    ],
)
def test_required_literals(pattern, plan):
    found = analyze(pattern).plan
    if pattern.startswith("x("):
        assert holds(found, "xabcy") and holds(found, "xdey") and not holds(found, "xy")
    else:
        assert str(found) == plan


@pytest.mark.parametrize(
    ("pattern", "text"),
    [("^foo", "foobar"), (r"\d{3}x", "123x"), ("(?:foo|b)ar", "bar"), (r"\y(foo)\y", "a foo b"), (r"\y[0-9]{10}\y", "9876543298"), ("x(?:abc|de)y", "xdey"), ("(?:vi|v[a-z])", "vx"), (r"\yfoo\y(?:.|\n){0,9}?\ybar\y", "foo barx bar"), ("(?i)FOO", "foo"), ("ab?c", "ac")],
)
def test_nothing_is_lost(pattern, text):
    assert re.search(to_python(pattern), text)
    assert holds(analyze(pattern).plan, text, analyze(pattern).case_mode == "insensitive")
    assert verify(pattern, text)[0]


@pytest.mark.parametrize(("pattern", "low", "high"), [(r"\yAB\y(?:.|\n){0,3}?\yCD\y", 4, 7), (r"\y[A-Za-z0-9_]{1,3}AB\y(?:.|\n){0,2}?\yCD[0-9]{2,4}\y", 7, 13), ("a+", 1, None)])
def test_lengths(pattern, low, high):
    assert (analyze(pattern).min_length, analyze(pattern).max_length) == (low, high)


@pytest.mark.parametrize(("pattern", "reason"), [("a\\", "UNTERMINATED_ESCAPE"), ("[ab", "UNTERMINATED_CLASS"), ("a{3", "UNTERMINATED_QUANTIFIER"), ("(a", "UNBALANCED"), ("a)", "UNBALANCED"), ("***x", "UNKNOWN_FLAG_NESTING"), (r"\1", "UNSUPPORTED_BACKREFERENCE"), ("[[.a.]]", "ESCAPE_UNSUPPORTED"), (r"\q", "ESCAPE_UNSUPPORTED")])
def test_refusals(pattern, reason):
    with pytest.raises(RegexError) as error:
        parse(pattern)
    assert error.value.reason == reason
    assert analyze(pattern).plan.kind == "TRUE"


def test_dialects():
    assert to_re2(r"\yab\y$") == r"\bab\b\z"
    assert to_java(r"(?:.|\n){0,90}?x") == r"[\s\S]{0,90}?x"
    assert "[:" not in to_java("[[:space:]]+")
    assert to_java("foo|foobar", longest=True) == "(?:foobar|foo)"
    with pytest.raises(RegexError):
        to_re2("(?=a)b")
    with pytest.raises(RegexError):
        to_re2(r"\mab")
    assert unescape_pattern("\\\\\\\\y") == "\\y"


def test_java_boundaries_and_newlines(spark):
    from pyspark.sql import functions as F

    cases = [(r"\yle\y", "é le x", True), (r"ab$", "ab\n", False), ("bar.baz", "bar\nbaz", True), ("[[:space:]]", "a:b", False), (r"\mab\M", "x ab.", True), (r"a(?:.|\n){0,2900}?b", "a" + "x" * 2800 + "b", True), (r"x\Yy", "xy", True), (None, "x", None)]
    for pattern, text, expected in cases:
        if pattern is None:
            continue
        row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(to_java(pattern)).alias("m")).first()
        assert row["m"] is expected, pattern


def _random_pattern(rng, depth=0):
    r = rng.random()
    if depth > 2 or r < 0.35:
        return rng.choice(["a", "b", "c", "1", "[ab]", "[^a]", r"\d", ".", r"\ ", "ab", "é"])
    if r < 0.6:
        return _random_pattern(rng, depth + 1) + _random_pattern(rng, depth + 1)
    if r < 0.75:
        return "(?:" + _random_pattern(rng, depth + 1) + "|" + _random_pattern(rng, depth + 1) + ")"
    if r < 0.9:
        return "(?:" + _random_pattern(rng, depth + 1) + ")" + rng.choice(["*", "+", "?", "{1,2}", "{2}", "{0,3}?"])
    return r"\y" + _random_pattern(rng, depth + 1)


def test_random_patterns_lose_no_match():
    rng = random.Random(42)
    for _ in range(3000):
        pattern, text = _random_pattern(rng), "".join(rng.choice("ab c1é\n") for _ in range(rng.randint(0, 14)))
        found, match = analyze(pattern), re.search(to_python(pattern), text)
        assert bool(match) == verify(pattern, text)[0], (pattern, text)
        if match:
            assert holds(found.plan, text), (pattern, text)
            assert all(any(literal in text for literal in group) for group in conjuncts(found.plan))
            assert found.min_length <= len(match.group())
            assert found.max_length is None or len(match.group()) <= found.max_length
            assert all(automata.may_hold(pattern, match.group()[i : i + 2]) for i in range(len(match.group()) - 1))


def test_plans():
    assert simplify(Plan("OR", parts=(leaf("a"), leaf("")))).kind == "TRUE"
    assert str(simplify(Plan("AND", parts=(leaf("ab"), Plan("AND", parts=(leaf("b"), leaf("c"))))))) == "AND('ab', 'c')"
    assert str(simplify(Plan("OR", parts=(leaf("ab"), leaf("b"))))) == "'b'"


def test_masks_and_tokens():
    mapping = {"th": 0, "he": 1, "zz": 63}
    assert explain_mask("the|the", mapping)["mask"] == 3
    assert explain_mask("(?:vi|v[a-z])", {"vi": 0, ":v": 1})["mask"] == 0
    assert signed64(1 << 63) == -(1 << 63)
    assert tokens_of_pattern(" for the (?:a|b)") == ["for", "the"]
    assert select_literals(("abc", "ab", "a"), "3way") == ["abc", "ab"]


@pytest.mark.parametrize(("a", "b", "same"), [("a|b", "[ab]", True), ("a+", "aa*", True), ("a*", "a+", False), ("(?:ab){2}", "abab", True), (r"a\y", "a", None), ("[a-c]", "[abc]", True)])
def test_equivalence(a, b, same):
    assert automata.equivalent(a, b) is same


def test_negative_grams():
    assert automata.negative_grams("ab+c", ["abb", "xyz", "bbc", "ca"]) == ["xyz", "ca"]


def test_spans():
    assert spans.match_span("abc def", r"\ydef\y", 5, 7)
    assert spans.match_from_upto("abcde", "bc", 2, 4) and not spans.match_from_upto("abcde", "bcde", 2, 4)
    assert spans.find_at_upto("abcde", "bcd", 2, 4) == (2, 4) and spans.find_at_upto("abcde", "bcd", 3, 4) is None
    assert spans.find_from("a\n\nb", r"a(?:.|\n){0,3}?b") == (1, 4) and spans.find_from("abc", "a", 0) is None
    assert list(spans.find_all("foo and bar", "(?:foo|bar)")) == [(1, 3), (9, 11)]
    assert spans.match_span("汉字abc", "字a", 2, 3)
    assert list(spans.find_all("ababa", "aba")) == [(1, 3), (3, 5)] and list(spans.find_all("ababa", "aba", overlap=False)) == [(1, 3)]
    assert not spans.match_span("abc", "a", 0, 1) and not spans.match_span("abc", "abc", 1, 5)
    assert spans.verify_windows("foo bar baz", r"\ybar\y", [1, 3, 5, 7, 5, 8]) == 1
    assert spans.find_at_upto("aaaa", "a+", 1, 2) == (1, 2)  # a shorter match than the preferred one
    assert spans.verify_windows("barx", r"\ybar\y", [1, 3]) == -1  # what follows the window still counts
    with pytest.raises(ValueError):
        spans.verify_windows("a", "a", [1])


def test_span_functions_in_sql(spark):
    spans.register(spark)
    row = spark.sql("SELECT regex_match_span('abc def', '\\\\ydef\\\\y', 5, 7) a, regex_find_from('xab', 'ab', 1) b, regex_verify_windows('foo bar', 'bar', array(1, 3, 5, 7)) c, regex_match_span(NULL, 'a', 1, 1) d").first()
    assert (row["a"], list(row["b"]), row["c"], row["d"]) == (True, [2, 3], 1, None)
    assert [tuple(r) for r in spark.sql("SELECT * FROM regex_find_all('ababa', 'aba', true)").collect()] == [(1, 3), (3, 5)]


@pytest.mark.parametrize("rest", [0, 1, 65_535, 65_536, 70_000])
def test_spans_of_long_texts(rest):
    """An end is tested alike whatever follows, with alternations whose preferred match ends elsewhere."""
    text = "ab" + "x" * rest
    assert spans.match_span(text, "a|ab", 1, 2) and spans.match_span(text, "a|ab", 1, 1) and not spans.match_span(text, "a|ab", 1, 3)
    assert spans.find_at_upto(text, "abx+|ab|a", 1, 2) == (1, 2)
    assert spans.match_span(text, r"ab\y", 1, 2) is (rest == 0)
    assert spans.match_span(text, "ab$", 1, 2) is (rest == 0)
    assert spans.match_span(text, "ab(?=x)", 1, 2) is (rest > 0)
    assert spans.match_span(text, "ab(?!x*$)", 1, 2) is False
    assert spans.match_span(text, "ab(?=x{3}$)", 1, 2) is (rest == 3)
    assert spans.verify_windows(text, "a[b-z]*|ab", [2, 5, 1, 2]) == 1
    assert spans.match_span(text.upper(), "(?i)a|ab", 1, 2)


def test_window_ends_share_their_patterns():
    before = spans._pinned.cache_info().misses
    assert spans.find_at_upto("a" * 3000 + "c", "(?:aa)*b?c|a{5}", 2, 2000) == (2, 6)
    assert spans._pinned.cache_info().misses - before <= 2


def test_random_spans_against_all_ends():
    rng = random.Random(5)
    for _ in range(1500):
        pattern, text = _random_pattern(rng), "".join(rng.choice("ab c1") for _ in range(rng.randint(0, 9)))
        s, e = rng.randint(1, len(text) + 1), rng.randint(0, len(text))
        if e >= s - 1:
            expected = re.compile(f"(?:{to_python(pattern)})(?=[\\s\\S]{{{len(text) - e}}}\\Z)").match(text, s - 1) is not None
            assert spans.match_span(text, pattern, s, e) == expected, (pattern, text, s, e)


def test_empty_matches_and_starts_in_sql(spark):
    spans.register(spark)
    row = spark.sql("SELECT regex_find_from_or_empty('ab', 'x*', 2, true) a, regex_find_from('ab', 'x*', 2) b, regex_find_at_upto_or_empty('ab', 'x*', 1, 2, true) c, regex_verify_windows_or_empty('ab', 'x*', array(1, 1), true) d, regex_verify_windows('ab', 'x*', array(1, 1)) e, regex_matches('a-b', '\\\\ya\\\\y') f, regex_matches(NULL, 'a') g").first()
    assert (list(row["a"]), row["b"], list(row["c"]), row["d"], row["e"], row["f"], row["g"]) == ([2, 1], None, [1, 0], 0, -1, True, None)
    assert [tuple(r) for r in spark.sql("SELECT * FROM regex_find_all('ababa', 'aba', true, 2)").collect()] == [(3, 5)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM regex_find_all('ab', 'x*', false, 1, true)").collect()] == [(1, 0), (2, 1), (3, 2)]
