"""Every query against its SQL, on whole small tables."""

import pytest

from tests.oracle import SMALL, connect, spark_rows, sql_rows
from trawl.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, connection, name):
    df = QUERIES[name](spark, SMALL)
    names, expected = sql_rows(connection, SQL[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected


def test_whole_tables(spark):
    count = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").count()
    assert QUERIES["trigram_table"](spark, SMALL).count() == count("part")
    assert QUERIES["next_id_probe"](spark, SMALL).count() == count("orders")
    for name in ("trigram_table", "next_id_probe", "candidate_semi_join"):
        assert "%" not in SQL[name]
    for name in ("token_table", "span_count_overlap", "struct_token_stats", "literal_positions"):
        assert QUERIES[name](spark, SMALL).count() == count("documents")
        assert "lang" not in SQL[name]


def test_random_samples(spark):
    from trawl.operators import sampling

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "n_chars")
    assert 0 < sampling.bernoulli(docs, 10).count() < 100
    ids = [r["doc_id"] for r in sampling.jump_sample(docs, 50).collect()]
    assert len(ids) == len(set(ids)) == 50
    assert sampling.weighted_sample(docs, "n_chars", 50).count() == 50


def test_workload_finds_its_seeds(spark):
    from trawl.functions.regex_dialect import to_python
    import re

    rows = QUERIES["workload_generate"](spark, SMALL).collect()
    assert len(rows) > 40
    for row in rows:
        assert re.search(to_python(row["regex"]), row["seed_string"]), row["regex"]
        assert 0 < row["exposed_len"] <= row["word_chars"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_are_pushed_down(spark):
    from trawl.operators.search import search

    plan = search(spark.read.parquet(f"{SMALL}/documents.parquet"), "thing [a-z]+ the")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,thing )" in plan
    assert "ReadSchema: struct<text:string>" in plan


def test_candidates_by_semi_join(spark):
    from trawl.operators import grams

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = grams.index_search(docs, grams.postings(docs), "thing [a-z]+ the")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
