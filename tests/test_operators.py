"""Indexes, samples, arms, sources, sinks and streams on small made-up tables."""

import pytest
from pyspark.sql import functions as F

from trawl.operators import arms, batch, grams, grouping, metrics, sampling, search, signatures, windows, workload
from trawl.plans.prefilter import leaf
from trawl.sources import readers, sinks

DOCS = [(1, "hello world"), (2, "I-5 NB closed"), (3, "CA-274 reopened quickly"), (4, "ego sum"), (5, None), (6, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def ids(df, column="doc_id"):
    return sorted(r[column] for r in df.collect())


def test_demo_search(docs):
    assert ids(search.search(docs, r"\yCA\-274\y", "ids")) == [3]
    assert ids(search.search(docs, "(?i)HELLO", "ids")) == [1]
    assert ids(search.search(docs, "HELLO", "ids", ignore_case=True)) == [1]
    assert search.cross_check(docs, "reopened [a-z]+")
    assert search.text_column_of(docs) == "text"
    assert set(search.explain_arms(docs, "reopened [a-z]+ly")) == {"direct", "3way", "multiway"}
    with pytest.raises(ValueError):
        search.search(docs, "a", "nothing")


def test_index_round_trip(spark, docs, tmp_path):
    keys = grams.useful_keys(docs.filter("text is not null"), 0.3, 4)
    shell = grams.presuf_shell(keys)
    assert set(ids(shell, "gram")) <= set(ids(keys, "gram"))
    stored = docs.filter("text is not null")
    rows = grams.postings(stored, lengths=(3,))
    frequency = {r["gram"]: r["df"] for r in rows.groupBy("gram").agg(F.count("*").alias("df")).collect()}
    assert ids(grams.index_search(docs, rows, "CA-[0-9]+ re", df=frequency, total=6)) == [3]
    assert ids(grams.index_search(docs, rows, "[a-z]+ sum")) == [4]
    assert ids(grams.index_search(docs, rows, "[a-z]{5}")) == [1, 2, 3]
    for options in ({}, {"shell": False}, {"sample": 2}):
        name = grams.build_index(stored, str(tmp_path), 0.3, 4, **options)
        assert grams.latest_index(spark, str(tmp_path)) == name
        kept, bitmaps = grams.load_index(spark, str(tmp_path), name)
        counted = {r["gram"]: r["df"] for r in grams.bitmap_cardinality(bitmaps).collect()}
        assert counted == {r["gram"]: r["df"] for r in kept.collect()}
        assert all(stored.filter(F.contains("text", F.lit(g))).count() == n for g, n in sorted(counted.items())[:4])
        for pattern in ("CA-[0-9]+ re", "[a-z]+ sum", "[a-z]{5}", "(?:hello|ego) [a-z]", "(?i)HELLO", "zzzz"):
            assert ids(grams.key_search(docs, str(tmp_path), name, pattern)) == ids(search.search(docs, pattern, "ids")), pattern
    grams.drop_index(spark, str(tmp_path), name)
    assert not (tmp_path / name).exists()


def test_key_plan_and_bounds():
    df = {"ab": 5, "bc": 1, "cd": 2, "de": 9}
    assert str(grams.key_plan(leaf("abcde"), df)) == "AND('bc', 'de')"
    assert grams.bounds(grams.key_plan(leaf("abcde"), df), df, 100) == 1
    assert grams.key_plan(leaf("xyz"), df).kind == "TRUE"


def test_bitmaps(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 40_000), ("b", 1), ("b", 40_000), ("b", 7)], "gram string, doc_id long")
    bitmaps = grams.bitmap_postings(rows)
    assert grams.bitmap_and(bitmaps, ["a", "b"]).first()["n"] == 2
    assert grams.bitmap_or(bitmaps, ["a", "b"]).first()["n"] == 4
    assert grams.bitmap_and(bitmaps, ["a", "zz"]).first()["n"] == 0


def test_signatures_hold_all_matches(docs, tmp_path):
    mapping = {"CA": 0, "27": 1, "he": 63}
    signed = docs.withColumn("sig", signatures.signature(F.col("text"), mapping))
    assert ids(signatures.signature_search(signed, r"CA\-2[0-9]+", mapping)) == [3]
    assert ids(signatures.signature_search(signed, "hel+o", mapping)) == [1]
    top = signatures.top_grams(signatures.query_gram_frequency(docs.sparkSession, ["abc", "abd"]), 2)
    signatures.write_mapping(top, 2, str(tmp_path / "m.json"))
    assert signatures.read_mapping(str(tmp_path / "m.json")) == {"ab": 0, "bc": 1}


def test_arm_choice_and_cache(docs, tmp_path):
    assert arms.choose_arm("abc[0-9]def", {"direct": 1.0, "3way": 0.99, "multiway": 0.99}.get).arm == "direct"
    assert arms.choose_arm("abc[0-9]def", {"direct": 1.0, "3way": 0.5, "multiway": 0.9}.get).arm == "3way"
    assert arms.choose_arm("[0-9]+", lambda arm: 0.0).arm == "direct"
    cache = arms.PolicyCache(str(tmp_path / "p.json"))
    count, choice = arms.adaptive_count(docs, "reopened [a-z]+", docs, cache, "t", cost={"direct": 1.0, "3way": 0.1}.get)
    assert count == 1 and choice.arm == "3way"
    assert arms.adaptive_count(docs, "reopened [a-z]+", docs, arms.PolicyCache(str(tmp_path / "p.json")), "t", cost=None)[1].arm == "3way"
    assert arms.measure(docs, "hello", "direct", 0, 1) > 0


def test_samples(spark, docs):
    many = spark.range(0, 2000, 2).withColumnRenamed("id", "doc_id")
    assert sampling.exact_sample(many, 10).count() == 10
    found = sampling.next_ids(many, spark.createDataFrame([(-5,), (3,), (4,), (1999,), (1998,)], "probe long"))
    assert {r["probe"]: r["id"] for r in found.collect()} == {-5: 0, 3: 4, 4: 4, 1999: None, 1998: 1998}
    assert sampling.jump_sample(many, 20).count() == 20
    assert sampling.bucket_sample(many, 40, 20).groupBy("bucket").count().filter("count = 2").count() == 20
    walk = ids(sampling.stride_ids(spark, 0, 99, 100, 3, 10), "id")
    assert walk == list(range(100))
    assert sampling.sample_docs(many, "exact", 5).count() == 5
    with pytest.raises(ValueError):
        sampling.sample_docs(many.limit(0), "exact", 5)
    assert sampling.next_ids(many.limit(0), spark.range(1).withColumnRenamed("id", "probe")).first()["id"] is None
    assert 300 < sampling.estimate_matches(many, F.col("doc_id") < 1000, 50) < 700


def test_batch(spark, docs):
    patterns = {"a": "hello", "b": "[0-9]{3}", "c": "NB closed|ego s"}
    rows = grams.postings(docs.filter("text is not null"))
    found = sorted(tuple(r) for r in batch.pattern_ids(docs, patterns, rows).select("pid", "doc_id").collect())
    assert found == [("a", 1), ("b", 3), ("c", 2), ("c", 4)]
    assert {r["pid"]: r["n"] for r in batch.pattern_counts(docs, patterns).collect()} == {"a": 1, "b": 1, "c": 2}


def test_windows_report_pruning(docs):
    rows = windows.window_search(docs, r"\yCA\-274\y(?:.|\n){0,30}?\yquickly\y").collect()
    assert [(r["id"], r["matched"]) for r in rows] == [(3, True)]
    text = "foo " * 50 + "bar"
    matched, stats = windows.verify(r"\yfoo\y(?:.|\n){0,9}?\ybar\y", text)
    assert matched and stats.windows < 50


def test_generated_patterns(spark):
    seeds = spark.createDataFrame([(1, "Crash on I-95 near exit 12 reported"), (2, "quick brown foxes"), (3, None)], "doc_id long, text string")
    pool = spark.createDataFrame([("qui", 3), ("fox", 2), ("ras", 5)], "gram string, df long")
    rows = workload.generate(seeds, pool, workload.Policy(expose=0.5, max_per_seed=3)).collect()
    assert {r["seed_id"] for r in rows} == {1, 2}
    checked = batch.self_check(spark.createDataFrame([(r["seed_string"], __import__("trawl.functions.regex_dialect", fromlist=["x"]).to_java(r["regex"])) for r in rows], "seed string, pattern string"))
    assert checked.filter("not matches_seed").count() == 0


def test_seeds_keep_patterns_as_tables_grow(spark, tmp_path):
    from trawl.plans import catalog

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = []
    for times in (1, 10, 60):
        more = turns.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("conv_id", F.col("conv_id") + F.col("copy") * 1000).drop("copy")
        more.write.parquet(f"{tmp_path}/{times}/conversations.parquet")
        found.append(catalog.queries()["workload_generate"](spark, f"{tmp_path}/{times}").count() / more.count())
    assert found[0] <= found[1] <= found[2], found


def test_prefix_provider(spark):
    rows = spark.createDataFrame([(1, r"a\ b{2}", "Main St 1"), (2, r"a\ b{3}", "Main St 2"), (3, "zz", "Elm")], "seed_id long, regex string, seed string")
    grouped = grouping.groups(rows)
    best = grouping.best_prefixes(grouping.prefix_support(rows.withColumn("g", grouping.normalized(F.col("regex"))), "g", "seed"))
    found = grouping.PrefixProvider(grouped, best).prefixes(spark.createDataFrame([(r"a\ b{9}",)], "regex string"))
    assert "main" in ids(found, "prefix")


def test_recall_of_empty_gold(spark):
    gold = spark.createDataFrame([("q", 1), ("q", 2)], "pid string, doc_id long")
    each = metrics.recall(gold, gold.filter("doc_id = 1"), ["pid"], "doc_id", spark.createDataFrame([("q",), ("r",)], "pid string"))
    assert {r["pid"]: r["recall"] for r in each.collect()} == {"q": 0.5, "r": 1.0}


def test_sources_and_sinks(spark, docs, tmp_path):
    csv = tmp_path / "d.csv"
    csv.write_text('text\nhello world\n"I-5, NB\nclosed"\nego sum\n')
    rows = readers.read_csv(spark, str(csv))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, "hello world"), (2, "I-5, NB\nclosed"), (3, "ego sum")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(csv), "other")
    lines = tmp_path / "workload_A.jsonl"
    lines.write_text('{"regex": "a+", "seed_id": 1}\nnot json\n{"seed_id": 2}\n')
    assert ids(readers.read_jsonl(spark, str(lines)), "regex") == ["a+"]
    assert readers.read_jsonl_errors(spark, str(lines)).cache().filter("_error is not null").count() == 1
    pool = tmp_path / "pool.json"
    pool.write_text('{"N": 9, "df3_mid_pairs": [["abc", 3], ["xyz", 5]]}')
    assert {r["gram"]: r["df"] for r in readers.read_pool(spark, str(pool)).collect()} == {"abc": 3, "xyz": 5}
    array = tmp_path / "q.json"
    array.write_text('[{"regex": "a"}, {"regex": "b"}]')
    assert ids(readers.read_queries(spark, str(array)), "regex") == ["a", "b"]
    text = tmp_path / "p.txt"
    text.write_text("a+\n\n b \n")
    assert ids(readers.read_patterns(spark, str(text)), "regex") == ["a+", "b"]
    assert readers.discover(spark, str(tmp_path)).first()["workload"] == "A"
    dump = tmp_path / "dump.csv"
    dump.write_text("7,some text\n8,more text\n")
    assert ids(readers.read_dump(spark, str(dump), ("id", "text")), "id") == ["7", "8"]
    sinks.write_json([{"a": 1}], str(tmp_path / "out" / "r.json"))
    sinks.write_patterns(readers.read_jsonl(spark, str(lines)), str(tmp_path / "patterns"))
    assert ids(spark.read.text(str(tmp_path / "patterns")), "value") == ["a+"]
    sinks.write_prefix_table(docs, str(tmp_path / "prefix"))
    sinks.write_token_table(docs, str(tmp_path / "tokens"))
    assert spark.read.parquet(str(tmp_path / "tokens")).filter(F.array_contains("tokens", "ca-274")).count() == 1
    sinks.write_sample(docs, "text", str(tmp_path / "sample"), 2)
    kv = spark.createDataFrame([("a", 1), ("b", 2)], "index_id string, v int")
    sinks.replace_partitions(kv, str(tmp_path / "kv"))
    sinks.replace_partitions(kv.filter("index_id = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "kv"))
    assert {r["index_id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "kv")).collect()} == {"a": 9, "b": 2}
    assert readers.estimated_rows(docs) == 6


def test_streams(spark, tmp_path):
    from trawl.streaming.filters import stream_indexed, windowed_matches

    spark.createDataFrame([("2024-01-01 00:01:00", "the end"), ("2024-01-01 00:02:00", "no"), ("2024-01-01 00:15:00", "the start")], "ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    running = windowed_matches(arriving, "the").writeStream.outputMode("complete").format("memory").queryName("windows_test").trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows_test").collect()) == [1, 1]
    running = stream_indexed(arriving, {"th": 0}).writeStream.format("memory").queryName("indexed_test").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("indexed_test").filter("sig = 1").count() == 2


def test_methods_side_by_side(docs):
    from trawl.operators import methods

    mapping = {"CA": 0, "he": 1}
    tables = methods.Tables(docs, grams.postings(docs.filter("text is not null")), docs.withColumn("sig", signatures.signature(F.col("text"), mapping)), mapping)
    queries = [("hello [a-z]+", "hello world"), (r"CA\-[0-9]+ re", "CA-274 reopened"), ("[0-9]{3}", None)]
    for method in ("seqscan", "literal", "grams", "limited", "tokens", "signature"):
        results = methods.run_workload(tables, method, queries, 2)
        assert [r.ids for r in results] == [[1], [3], [3]] and all(r.ok and r.t_verify_ms >= 0 for r in results), method
        row = methods.compare(tables, method, queries).first()
        assert (row["macro"], row["micro"]) == (1.0, 1.0)
    assert methods.run_method(tables, "prefix", "[a-z]+", "hello world").ids == [1]
    bad = methods.run_method(tables, "seqscan", "(")
    assert not bad.ok and "UNBALANCED" in bad.error
    assert methods.as_rows([bad])[0]["n_matches"] == 0
    assert "Filter" in methods.explain_stats(search.matches(docs, "hello [a-z]"))["nodes"]


def test_limited_method_counts_all(spark):
    from trawl.operators import methods

    many = spark.range(methods.LIMIT + 76).select(F.col("id").alias("doc_id"), F.lit("hello world").alias("text"))
    tables = methods.Tables(many, grams.postings(many))
    result = methods.run_method(tables, "limited", "hello [a-z]+", keep=2 * methods.LIMIT)
    assert (result.ok, result.n_matches) == (True, methods.LIMIT + 76)
    assert result.ids == list(range(methods.LIMIT))
    assert methods.compare(tables, "limited", [("hello [a-z]+", None)]).first()["micro"] == round(methods.LIMIT / (methods.LIMIT + 76), 6)


def test_next_ids_in_one_pass_over_even_ranges(spark):
    far = 2**60
    many = spark.range(0, 4000, 2).union(spark.createDataFrame([(far,), (far,), (None,)], "id long")).withColumnRenamed("id", "doc_id")
    probes = spark.range(-1, 4001).union(spark.createDataFrame([(far,), (far + 1,), (None,), (None,)], "id long")).withColumnRenamed("id", "probe")
    df = sampling.next_ids(many, probes)
    rows = df.collect()
    assert {r["probe"]: r["id"] for r in rows} == {p: p + p % 2 if p < 3999 else far for p in range(-1, 4001)} | {far: far, far + 1: None, None: None}
    assert len(rows) == 4005
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan  # a frame that only shrinks is added up anew for each row
    sizes = [r["count"] for r in sampling._in_ranges(many.select(F.col("doc_id").alias("at")), F.lit([i * 15 for i in range(1, sampling.RANGES)])).groupBy("slot").count().collect()]
    assert len(sizes) == sampling.RANGES + 1 and sum(sizes) == 2003
    nothing = sampling.next_ids(many.limit(0), probes.filter("probe is null or probe < 2"))
    assert sorted(nothing.collect(), key=lambda r: r["probe"] if r["probe"] is not None else 9) == [(-1, None), (0, None), (1, None), (None, None)]
