"""The same pattern in Java, RE2 and Python finds the same rows."""

import random
import re

import duckdb
import pytest

from tests.oracle import SMALL
from trawl.functions.regex_ast import RegexError
from trawl.functions.regex_dialect import to_python, to_re2
from trawl.operators.batch import pattern_counts

FIXED = [r"\yle\y", r"\ythe\y(?:.|\n){0,30}?\yand\y", r"[[:space:]]{2}", r"\yq[a-z]{1,4}\y", r"(?i)THE [a-z]+ AND", r"[A-Z][a-z]+\.\n", r"^(?:The|Le|El|Der) ", r"[^[:alnum:][:space:]]{3}", r"\d{3}-\d{4}$", "é[a-z]é|ñ", r"a.\n.", "(?:on|an){3}"]


def random_patterns(texts, n=25):
    """Pieces of the texts joined by gaps, classes and alternatives."""
    rng, out = random.Random(11), []
    while len(out) < n:
        text = rng.choice(texts)
        words = re.findall(r"[A-Za-z]{3,}", text)
        if len(words) > 4:
            at = rng.randrange(len(words) - 3)
            a, b, c = words[at : at + 3]
            out.append(rng.choice([rf"\y{a}\y(?:.|\n){{0,40}}?\y{c}\y", f"(?:{a}|{b})[ ,.]", f"{a[:2]}[a-z]{{1,5}} {b}", rf"{a}[^a-z]+{b[:3]}", rf"\y[A-Za-z0-9_]{{1,4}}{a[-2:]}\y{'.' * 3}{c[:2]}"]))
    return out


def test_engines_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    patterns = {f"p{i}": p for i, p in enumerate(FIXED + random_patterns(texts))}
    counts = {r["pid"]: r["n"] for r in pattern_counts(docs, patterns).collect()}
    for pid, pattern in patterns.items():
        assert counts[pid] == sum(re.search(to_python(pattern), t) is not None for t in texts), pattern
        found = duckdb.execute(f"SELECT count(*) FROM read_parquet('{SMALL}/documents.parquet') WHERE regexp_matches(text, ?)", [to_re2(pattern)]).fetchall()
        assert counts[pid] == found[0][0], pattern


@pytest.mark.parametrize("pattern", ["(?=a)b", "(?<!a)b", r"(a)\1", r"\mab"])
def test_what_re2_lacks_is_refused(pattern):
    with pytest.raises(RegexError):
        to_re2(pattern)
