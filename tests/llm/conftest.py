import random

import pytest
from pyspark.sql import functions as F

from trawl.llm.common import Scratch

VOCABULARY = [f"{a}{b}{c}" for a in ("th", "on", "an", "re") for b in ("e", "a", "io") for c in ("r", "n", "s", "ç")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies in chains, shared passages, short, empty, odd and very long texts."""
    rng = random.Random(5)
    out = {i: prose(rng, rng.choice([3, 8, 40, 90])) for i in range(60)}
    base = prose(rng, 120).split(" ")
    for i in range(60, 100):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
        out[i] = " ".join(copy)
    passage = prose(rng, 80)
    for i in range(100, 130):
        out[i] = prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)
    out |= dict.fromkeys(range(130, 150), out[3])
    out |= {150: None, 151: "", 152: " \n\t ", 153: "one", 154: "ONE", 155: "a b c d", 156: "A b C d", 157: "a\x0bb\x1cc d e 中文 \U0001f600 x", 158: prose(rng, 30_000), 159: "same " * 500, 160: "line one here\nline one here\nline one here\n\n\n", 161: "don't I'll we've  double  spaces\n\nx", 162: "<|endoftext|> <|startoftext|> ok", 163: "İstanbul ΣΑΣ é ﬁ ½"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)


@pytest.fixture(scope="session")
def odd(docs):
    """The same with columns of clashing names and a row without an id."""
    more = ["part", "key", "rank", "u", "v", "block", "bucket", "size", "component", "kind", "score", "kept", "length", "piece"]
    rows = docs.select("*", *[F.lit("x").alias(c) for c in more])
    return rows.unionByName(rows.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture
def scratch(spark, request):
    made = Scratch(spark, request.node.name.split("[")[0])
    yield made
    made.drop("")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
