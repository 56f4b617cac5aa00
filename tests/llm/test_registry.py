"""What is registered for the driver."""

import pytest

import corpus_pipeline
from tests.oracle import SMALL, connect, spark_rows, sql_rows
from trawl.llm import registry


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in registry.queries() if name.startswith("op")] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    df = registry.queries()[name](spark, SMALL)
    names, expected = sql_rows(connect(), registry.oracle_sql()[name])
    assert sorted(df.columns) == names and spark_rows(df) == expected


def test_entry_has_them():
    import __spark_entry__

    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near dedup", "packing"]
