"""Load the tables once, run the headline queries warmed up, and print one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local threads. Loading spreads each table over files, as any store
would hold it, and builds a trigram index, an index of keys and a signature table; its time is reported apart. Every query is executed whole into a
sink without output; a first run compiles the code, the second is timed.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import grams, search, signatures
from trawl.plans import catalog
from trawl.session import local_session

HEADLINE = [
    "regex_count", "regex_ids", "regex_topk", "literal_prefilter_count", "literal_or_prefilter", "prefilter_candidates", "prefix_like_ids",
    "token_contains", "signature_build", "signature_search", "bigram_df", "postings_and", "index_query_ids", "multi_regex_matrix", "multi_pattern_index",
    "span_count", "find_all_spans", "window_search_ids", "struct_token_stats", "pages_regex", "lineitem_part_regex", "recall_macro_micro", "pass_at_k",
]
TABLES = ["documents", "pages", "part", "lineitem", "events", "conversations", "benchmark"]


def load(spark: SparkSession, sf_dir: str, target: str, files: int) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{target}/{name}.parquet")
    docs = spark.read.parquet(f"{target}/documents.parquet")
    docs.withColumn("sig", signatures.signature(F.col("text"), catalog.MAPPING)).write.parquet(f"{target}/signed")
    grams.postings(docs).repartitionByRange(files, "gram").sortWithinPartitions("gram", "doc_id").write.parquet(f"{target}/postings")
    grams.build_index(docs, f"{target}/index", longest=4)


def stored(spark: SparkSession, target: str) -> dict[str, Callable[[], DataFrame]]:
    """Queries on what loading has built."""
    docs, rows, signed = (spark.read.parquet(f"{target}/{x}") for x in ("documents.parquet", "postings", "signed"))
    return {
        "stored_index_ids": lambda: grams.index_search(docs, rows, catalog.WORDS),
        "stored_index_count": lambda: grams.index_search(docs, rows, catalog.LITERAL).agg(F.count("*")),
        "stored_key_ids": lambda: grams.key_search(docs, f"{target}/index", grams.index_id(longest=4), catalog.EITHER),
        "scan_ids": lambda: search.search(docs, catalog.EITHER, "ids", filtered=False),
        "stored_signature_ids": lambda: signatures.signature_search(signed, catalog.LITERAL, catalog.MAPPING).select("doc_id"),
    }


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, os.environ.get("BENCH_MEMORY", "8g"))
    target = tempfile.mkdtemp(prefix="trawl-bench-")
    try:
        began = time.perf_counter()
        load(spark, sf_dir, target, int(cpus) if cpus.isdigit() else 8)
        loaded = time.perf_counter() - began
        found = catalog.queries()
        queries = {name: (lambda q=found[name]: q(spark, target)) for name in HEADLINE} | stored(spark, target)
        times = {}
        for name, make in queries.items():
            run(make())
            began = time.perf_counter()
            run(make())
            times[name] = round(time.perf_counter() - began, 3)
        print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "load_sec": round(loaded, 3), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    finally:
        spark.stop()
        shutil.rmtree(target, ignore_errors=True)


if __name__ == "__main__":
    main()
