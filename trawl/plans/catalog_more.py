"""More named queries: files read back, stored indexes, access methods, arms, pattern policies, and spans with alternations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.regex_analysis import explain_mask
from ..functions.regex_dialect import unescape_pattern
from ..operators import arms, grams, grouping, methods, metrics, sampling, search, signatures, windows, workload
from ..session import shared_folder
from ..sources import readers, sinks
from .catalog import EITHER, LITERAL, MAPPING, NEAR, WORDS, WORKLOAD, _re, docs, query, table

# Files, written to a shared folder and read back.


@query("SELECT doc_id AS id, md5(text) AS digest FROM documents")
def csv_documents(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    written = docs(spark, d).select("doc_id", "text").write.option("header", True).option("escape", '"').option("quoteAll", True)
    written.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path, "text", id_col="doc_id").select("id", F.md5("text_content").alias("digest"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def dump_without_header(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "dump")
    table(spark, d, "customer").select("c_custkey", "c_name").write.csv(path)
    return readers.read_dump(spark, path, ("id", "name"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark")
    return rows.select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("seed_id"), F.col("text").alias("seed_string"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("regex"))


@query("SELECT item_id AS seed_id, text AS seed_string, regexp_extract(text, '^[A-Za-z]+') AS regex FROM benchmark")
def jsonl_workload(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "jsonl")
    sinks.write_jsonl(_lines(spark, d), path)
    return readers.read_jsonl(spark, path).select("seed_id", "seed_string", "regex")


@query("SELECT item_id AS seed_id, regexp_extract(text, '^[A-Za-z]+') AS regex FROM benchmark")
def json_array_workload(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "json-array")
    rows = _lines(spark, d).select(F.struct("seed_id", "regex").alias("s"))
    rows.agg(F.to_json(F.sort_array(F.collect_list("s"))).alias("value")).coalesce(1).write.text(path)  # a small list in one line
    return readers.read_queries(spark, path).select("seed_id", "regex")


@query("SELECT count(*) FILTER (WHERE item_id % 2 = 0) AS good, count(*) FILTER (WHERE item_id % 2 = 1) AS broken FROM benchmark")
def jsonl_errors(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "jsonl-errors")
    line = F.when(F.col("seed_id") % 2 == 0, F.to_json(F.struct("seed_id", "regex"))).otherwise(F.concat(F.lit("{"), F.col("regex")))
    _lines(spark, d).select(line.alias("value")).write.text(path)
    found = readers.read_jsonl_errors(spark, path)
    return found.agg(F.count_if(F.col("_error").isNull() & F.col("seed_id").isNotNull()).alias("good"), F.count_if(F.col("_error").isNotNull()).alias("broken"))


@query("SELECT p_name AS regex, count(*) AS n FROM part GROUP BY p_name")
def pattern_file(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "patterns")
    sinks.write_patterns(table(spark, d, "part"), path, "p_name")
    return readers.read_patterns(spark, path).groupBy("regex").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('A', 1::BIGINT), ('B', 1), ('C', 1), ('D', 1)) t(workload, files)")
def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    root = shared_folder(spark, "discovered")
    for letter in "ABCD":
        _lines(spark, d).coalesce(1).write.json(f"{root}/workload_{letter}")
    return readers.discover(spark, root, "*.json").groupBy("workload").agg(F.count("*").alias("files"))


@query("SELECT 50 AS n, 50 AS known FROM part HAVING count(*) >= 50")
def written_sample(spark: SparkSession, d: str) -> DataFrame:
    path, parts = shared_folder(spark, "sample"), table(spark, d, "part")
    sinks.write_sample(parts, "p_partkey", path, 50)
    rows = spark.read.option("header", True).schema("p_partkey bigint").csv(path)
    known = rows.join(parts.select("p_partkey").distinct(), "p_partkey", "left_semi").agg(F.count("*").alias("known"))
    return rows.agg(F.count_distinct("p_partkey").cast("int").alias("n")).crossJoin(known.select(F.col("known").cast("int").alias("known")))  # one row each


_PAIRS = "SELECT gram, count(*) AS df FROM (SELECT DISTINCT p_name, substring(p_name, i::BIGINT, 3) AS gram FROM (SELECT p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part)) GROUP BY gram"


@query(_PAIRS)
def pool_file(spark: SparkSession, d: str) -> DataFrame:
    path, names = shared_folder(spark, "pool"), table(spark, d, "part").select("p_name").distinct()
    pairs = grams.gram_df(names, 3, "p_name", "p_name").select(F.array("gram", F.col("df").cast("string")).alias("p"))
    pool = pairs.agg(F.sort_array(F.collect_list("p")).alias("df3_mid_pairs")).withColumn("N", F.lit(1))  # a small list, as such files hold
    pool.coalesce(1).write.json(path)
    return readers.read_pool(spark, path)


@query("SELECT CASE WHEN p_brand = 'Brand#1' THEN 'new' ELSE 'old' END AS version, p_brand, p_partkey FROM part WHERE p_brand <> 'Brand#1' UNION ALL SELECT 'new', 'Brand#1', p_partkey FROM part WHERE p_brand = 'Brand#1'")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    path, rows = shared_folder(spark, "partitions"), table(spark, d, "part").select("p_brand", "p_partkey")
    sinks.replace_partitions(rows.withColumn("version", F.lit("old")), path, "p_brand")
    sinks.replace_partitions(rows.filter("p_brand = 'Brand#1'").withColumn("version", F.lit("new")), path, "p_brand")
    return spark.read.parquet(path).select("version", "p_brand", "p_partkey")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'http://th')")
def prefix_table_ids(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "prefix-table")
    sinks.write_prefix_table(table(spark, d, "pages"), path, "url")
    return search.starts_with(spark.read.parquet(path), "http://th", text="url").select("page_id")


@query("SELECT doc_id FROM documents WHERE list_has_all(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_-]+', ' ', 'g'), '\\s+'), lambda x: x <> ''), ['the', 'of'])")
def token_table_search(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "token-table")
    sinks.write_token_table(docs(spark, d), path)
    return spark.read.parquet(path).filter(search.has_tokens(F.col("tokens"), ["the", "of"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_has_all(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_-]+', ' ', 'g'), '\\s+'), lambda x: x <> ''), ['the', 'of'])")
def token_index_ids(spark: SparkSession, d: str) -> DataFrame:
    return grams.holding_all(grams.token_postings(docs(spark, d)), ["the", "of"])


@query("SELECT 'text' AS documents, 'url' AS pages, 'p_name' AS part, (SELECT count(*) FROM orders) AS orders")
def schema_facts(spark: SparkSession, d: str) -> DataFrame:
    columns = search.text_column_of(docs(spark, d)), search.text_column_of(table(spark, d, "pages")), search.text_column_of(table(spark, d, "part"))
    return spark.createDataFrame([(*columns, readers.estimated_rows(table(spark, d, "orders")))], "documents string, pages string, part string, orders bigint")


# Stored indexes.

_URL = r"/(?:en|de)/[a-z]*th"


def _page_index(spark: SparkSession, d: str, **options: object) -> tuple[str, str]:
    target = shared_folder(spark, "index")
    return target, grams.build_index(table(spark, d, "pages"), target, text="url", id_col="page_id", table="pages", **options)


@query(f"SELECT page_id AS doc_id FROM pages WHERE regexp_matches(url, {_re(_URL)})")
def key_index_ids(spark: SparkSession, d: str) -> DataFrame:
    """Builds an index of keys, stores and loads it, and searches: keys of all lengths, shell, bitmaps, substitution, gate, verification."""
    target, name = _page_index(spark, d, c=0.5)
    return grams.key_search(table(spark, d, "pages"), target, name, _URL, text="url", id_col="page_id")


@query(f"SELECT page_id AS doc_id FROM pages WHERE regexp_matches(url, {_re(_URL)})")
def sampled_key_index_ids(spark: SparkSession, d: str) -> DataFrame:
    """The same with keys found on a sample of documents; postings cover all."""
    target, name = _page_index(spark, d, c=0.5, sample=40)
    return grams.key_search(table(spark, d, "pages"), target, name, _URL, text="url", id_col="page_id")


_NGRAMS = " UNION ALL ".join(f"SELECT gram, {n} AS n, count(*) AS df FROM (SELECT DISTINCT page_id, substring(url, i::BIGINT, {n}) AS gram FROM (SELECT page_id, url, unnest(range(1, length(url) - {n - 2})) AS i FROM pages)) GROUP BY gram" for n in range(1, grams.LONGEST + 1))


@query(f"""WITH g AS MATERIALIZED ({_NGRAMS}), t AS (SELECT count(*) AS total FROM pages), keys AS (SELECT gram, n, df FROM g, t WHERE df <= 0.1 * total AND (n = 1 OR substring(gram, 1, n - 1) IN (SELECT gram FROM g, t WHERE df > 0.1 * total)))
    SELECT gram, df FROM keys k WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM keys s WHERE s.n < k.n AND ends_with(k.gram, s.gram))""")
def key_postings_df(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies from the stored bitmaps of the keys."""
    target, name = _page_index(spark, d)
    _, bitmaps = grams.load_index(spark, target, grams.latest_index(spark, target))
    return grams.bitmap_cardinality(bitmaps)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'wid')")
def lowered_trigram_index(spark: SparkSession, d: str) -> DataFrame:
    folded = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("low"))
    return grams.postings(folded, text="low", id_col="p_partkey").filter("gram = 'wid'").select(F.col("doc_id").alias("p_partkey"))


_BITS = "(SELECT sum(CASE WHEN contains(p_name, g) THEN 1 << p ELSE 0 END)::BIGINT FROM (VALUES {}) m(g, p))"


@query(f"SELECT p_partkey, {_BITS.format(chr(44).join(f'({chr(39)}{g}{chr(39)}, {i})' for i, g in enumerate(('re', 'wi', 'zz'))))} AS sig_A_3, {_BITS.format(chr(44).join(f'({chr(39)}{g}{chr(39)}, {i})' for i, g in enumerate(('dg', 'et'))))} AS sig_B_2 FROM part")
def signature_tables(spark: SparkSession, d: str) -> DataFrame:
    maps = {"A": {"re": 0, "wi": 1, "zz": 2}, "B": {"dg": 0, "et": 1}}
    return signatures.signature_table(table(spark, d, "part").select("p_partkey", "p_name"), maps, "p_name").drop("p_name")


@query("SELECT n_name AS gram, n_nationkey::INTEGER AS a, CASE WHEN n_nationkey <> 3 THEN n_nationkey + 1 END::INTEGER AS b, CASE WHEN n_nationkey = 3 THEN 'only_in_a' ELSE 'moved' END AS kind FROM nation WHERE n_nationkey = 3 OR n_nationkey > 20")
def mapping_differences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_name").alias("gram"), F.col("n_nationkey").cast("int").alias("pos"))
    b = a.filter("pos <> 3").withColumn("pos", F.col("pos") + F.when(F.col("pos") > 20, 1).otherwise(0))
    return signatures.mapping_differences(a, b)


@query("SELECT * FROM (VALUES ('the|that', 1::BIGINT), ('(?:vi|v[a-z])', 0), ('then', 3)) t(pattern, mask)")
def pattern_masks(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["the|that", "(?:vi|v[a-z])", "then"]
    return spark.createDataFrame([(p, explain_mask(p, MAPPING)["mask"]) for p in patterns], "pattern string, mask bigint")


# Access methods and arms.


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, count(*) AS n_matches, true AS ok FROM documents WHERE regexp_matches(text, {_re(LITERAL)})" for m in ("seqscan", "literal", "grams", "limited", "tokens", "signature")))
def method_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    tables = methods.Tables(rows, grams.pattern_postings(rows, [LITERAL]), rows.withColumn("sig", signatures.signature(F.col("text"), MAPPING)), MAPPING)
    found = [methods.run_method(tables, m, LITERAL) for m in ("seqscan", "literal", "grams", "limited", "tokens", "signature")]
    return spark.createDataFrame([(r.method, r.n_matches, r.ok) for r in found], "method string, n_matches bigint, ok boolean")


@query("SELECT 2::BIGINT AS n_queries, 1.0::DOUBLE AS macro, 1.0::DOUBLE AS micro")
def method_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    tables = methods.Tables(rows, grams.pattern_postings(rows, [LITERAL, WORDS]))
    return methods.compare(tables, "grams", [(LITERAL, None), (WORDS, None)])


@query(f"SELECT pid, arm, n FROM (SELECT 'p0' AS pid, '3way' AS arm, count(*) AS n FROM documents WHERE regexp_matches(text, {_re(WORKLOAD['p0'])}) UNION ALL SELECT 'p1', 'direct', count(*) FROM documents WHERE regexp_matches(text, {_re(WORKLOAD['p1'])}))")
def adaptive_counts(spark: SparkSession, d: str) -> DataFrame:
    """The arm by given costs: one saves a tenth, the other only two in a hundred."""
    rows, out = docs(spark, d), []
    for pid, cost in (("p0", 0.9), ("p1", 0.98)):
        n, choice = arms.adaptive_count(rows, WORKLOAD[pid], rows, cost=lambda arm, cost=cost: {"direct": 1.0, "3way": cost}.get(arm, 2.0))
        out.append((pid, choice.arm, n))
    return spark.createDataFrame(out, "pid string, arm string, n bigint")


@query("SELECT true AS same, true AS pushed, true AS narrow, 3::BIGINT AS arms")
def plan_facts(spark: SparkSession, d: str) -> DataFrame:
    """All arms count alike; a search pushes its literals down and reads the text alone."""
    rows = docs(spark, d)
    stats = methods.explain_stats(search.search(rows, LITERAL))
    facts = search.cross_check(rows, LITERAL), any("StringContains(text,thing )" in p for p in stats["pushed"]), stats["read"] == ["struct<text:string>"], len(search.explain_arms(rows, LITERAL))
    return spark.createDataFrame([facts], "same boolean, pushed boolean, narrow boolean, arms bigint")


# Samples.


@query("SELECT worker, worker * 1000 // 7 + 5 AS first, (worker + 1) * 1000 // 7 + 4 AS last FROM (SELECT unnest(range(0, 7)) AS worker)")
def worker_ranges(spark: SparkSession, d: str) -> DataFrame:
    return sampling.worker_ranges(spark, 5, 1004, 7)


@query("SELECT (floor((i * 2654435761) % 4294967296 / 4294967296.0::DOUBLE * 1000) + 5)::BIGINT AS id FROM (SELECT unnest(range(0, 300)) AS i)")
def random_ids(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_ids(spark, 5, 1004, 300, key=sampling.uniform("id"))


@query("""SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r FROM (
    SELECT doc_id, least(19, floor((doc_id - (SELECT min(doc_id) FROM documents)) * 20 / ((SELECT max(doc_id) - min(doc_id) + 1 FROM documents))))::INTEGER AS bucket FROM documents)) WHERE r <= 5""")
def sampled_documents(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_docs(docs(spark, d).select("doc_id"), "bucket", 100, 10).select("doc_id")


@query(f"SELECT 'near' AS name, count(*)::DOUBLE AS estimate FROM documents WHERE regexp_matches(text, {_re(NEAR)})")
def estimated_matches(spark: SparkSession, d: str) -> DataFrame:
    """At a share of all rows the estimate is the count; the second question is answered from the cache."""
    cache = sampling.EstimateCache(docs(spark, d), 100, rounds=1)
    for _ in range(2):
        estimate = cache.matches("near", search.pg_rlike(F.col("text"), NEAR))
    return spark.createDataFrame([("near", estimate)], "name string, estimate double")


# Spans with alternations over whole texts.


@query("SELECT doc_id, len(regexp_extract_all(text, '(?:an|the|ing)[a-z]'))::INTEGER AS n FROM documents")
def alternation_spans(spark: SparkSession, d: str) -> DataFrame:
    found = spans.regex_find_all_array("text", F.lit("(?:an|the|ing)[a-z]"), F.lit(False))
    return docs(spark, d).select("doc_id", F.size(found).alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '^(?:<[a-z]+|<!)') THEN 0 WHEN regexp_matches(html, '^[\\s\\S]{6}(?:<[a-z]+|<!)') THEN 1 ELSE -1 END::INTEGER AS w FROM pages")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows at both places, the first longer than any page, with an alternation of open length."""
    windows = F.array(F.lit(1), F.lit(10_000_000), F.lit(7), F.lit(10_000_000))
    return table(spark, d, "pages").select("page_id", spans.regex_verify_windows("html", F.lit("<[a-z]+|<!"), windows).alias("w"))


@query("SELECT doc_id, substring(text, 1, 1) IN ('T', 't') AS one, lower(substring(text, 1, 3)) = 'the' AS three FROM documents WHERE length(text) >= 3")
def span_ends(spark: SparkSession, d: str) -> DataFrame:
    """Two ends of one start: the preferred alternative's and another's."""
    text, pattern = F.col("text"), F.lit("[Tt]|[Tt][Hh][Ee]")
    ends = [spans.regex_match_span(text, pattern, F.lit(1), F.lit(e)).alias(name) for e, name in ((1, "one"), (3, "three"))]
    return docs(spark, d).filter(F.length("text") >= 3).select("doc_id", *ends)


@query("SELECT doc_id, contains(substring(text, 11, 50), 'the') AS inside FROM documents")
def literal_in_window(spark: SparkSession, d: str) -> DataFrame:
    rows = spans.literal_places(docs(spark, d), "the")
    return rows.select("doc_id", F.coalesce(spans.in_window(F.col("places"), F.lit(11), F.lit(60), 3), F.lit(False)).alias("inside"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(EITHER)})")
def dialect_match_ids(spark: SparkSession, d: str) -> DataFrame:
    """The dialect's match called from SQL."""
    spans.register(spark)
    docs(spark, d).createOrReplaceTempView("dialect_documents")
    return spark.sql("SELECT doc_id FROM dialect_documents WHERE regex_matches(text, :pattern)", args={"pattern": EITHER})


@query(f"SELECT count(*) FILTER (WHERE regexp_matches(text, {_re(WORDS)})) AS matched, true AS pruned FROM documents")
def window_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Windows never grow from one pruning step to the next."""
    rows = windows.window_search(docs(spark, d), WORDS)
    return rows.agg(F.count_if("matched").alias("matched"), F.coalesce(F.bool_and(F.expr("n_windows >= n_after_m and n_after_m >= n_after_n")), F.lit(True)).alias("pruned"))


# Workloads and groups.


def _policies(spark: SparkSession, d: str, policy: workload.Policy) -> DataFrame:
    seeds = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return workload.generate(seeds, workload.gram_pool(seeds, 3, 2, 0.375), policy, max_per_regex=2)


@query(" UNION ALL ".join(f"SELECT '{x}' AS policy, true AS found, true AS within, true AS capped" for x in ("generalize light", "literal off", "mixed light")))
def generated_policies(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of every policy find their seeds, keep to the budget give or take an island, and occur at most twice."""
    out = []
    for digits, alternative in (("generalize", "light"), ("literal", "off"), ("mixed", "light")):
        rows = _policies(spark, d, workload.Policy(digits=digits, alternative=alternative))
        found = F.bool_and(search_of_rows(rows)).alias("found")
        within = F.bool_and(F.expr("exposure.exposed_len = exposed_len and exposure.budget_capped <= exposure.max_possible and exposure.n_struct + exposure.n_ngram = exposure.n_islands"))
        per = rows.groupBy("regex").agg(F.count("*").alias("n")).agg(F.bool_and(F.col("n") <= 2).alias("capped"))
        out.append(rows.agg(found, within.alias("within")).crossJoin(per).select(F.lit(f"{digits} {alternative}").alias("policy"), "found", "within", "capped"))  # one row each
    return out[0].unionByName(out[1]).unionByName(out[2])


def search_of_rows(rows: DataFrame) -> F.Column:
    """Whether each row's own pattern finds its seed, by the dialect."""
    return spans.regex_matches(rows["seed_string"], rows["regex"])


@query(f"""WITH pool AS ({_PAIRS}), t AS (SELECT DISTINCT p_name AS token FROM part), g AS (SELECT DISTINCT token, substring(token, i::BIGINT, 3) AS gram FROM (SELECT token, unnest(range(1, length(token) - 1)) AS i FROM t))
    SELECT token, gram, df, rank FROM (SELECT token, gram, df, row_number() OVER (PARTITION BY token ORDER BY df, gram)::INTEGER AS rank FROM g JOIN pool USING (gram)) WHERE rank <= 4""")
def best_token_grams(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_name").distinct()
    return workload.best_grams(names.withColumnRenamed("p_name", "token"), grams.gram_df(names, 3, "p_name", "p_name"), most=4)


@query("SELECT p_partkey, regexp_extract(p_name || '.!', '^[a-z]+ [a-z]+[.!]*') AS punctuated, substring(p_name, 1, 4) AS chars FROM part")
def prefix_variants(spark: SparkSession, d: str) -> DataFrame:
    ended = F.concat("p_name", F.lit(".!"))
    return table(spark, d, "part").select("p_partkey", grouping.token_prefix(ended, 2, True).alias("punctuated"), grouping.char_prefix(F.col("p_name"), 4).alias("chars"))


_KEYED = "SELECT p_name || '[a-z]{' || p_size || '}' AS regex, [p_brand] AS anchors, list_sort([p_name, p_brand]) AS middle_blocks, regexp_replace(p_name, ' +', '\\\\s+', 'g') || '[a-z]{n}' AS shape FROM part"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    regex = F.concat("p_name", F.lit("[a-z]{"), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, d, "part").select(regex.alias("regex"), F.array("p_brand").alias("anchors"), F.array("p_name", "p_brand").alias("middle_blocks"))


@query(f"""SELECT *, round(n_raw / n_rows, 6) AS ratio_raw, round(n_norm / n_rows, 6) AS ratio_norm, round(n_norm_anchors / n_rows, 6) AS ratio_norm_anchors, round(n_norm_anchors_mid / n_rows, 6) AS ratio_norm_anchors_mid
    FROM (SELECT count(*) AS n_rows, count(DISTINCT regex) AS n_raw, count(DISTINCT shape) AS n_norm, count(DISTINCT (shape, anchors)) AS n_norm_anchors, count(DISTINCT (shape, anchors, middle_blocks)) AS n_norm_anchors_mid FROM ({_KEYED}))""")
def key_stats(spark: SparkSession, d: str) -> DataFrame:
    return grouping.key_stats(_keyed(spark, d))


@query(f"SELECT shape AS regex_norm, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM ({_KEYED}) GROUP BY shape ORDER BY n DESC, shape LIMIT 5")
def top_shapes(spark: SparkSession, d: str) -> DataFrame:
    return grouping.top_shapes(_keyed(spark, d), 5)


@query("""WITH b AS (SELECT [p_name, p_brand] AS beam, CASE WHEN p_partkey % 2 = 0 THEN [p_brand] ELSE ['none'] END AS targets, p_size AS estimate, p_partkey % 3 AS best FROM part)
    SELECT round(avg(list_has_any(beam, targets)::INTEGER), 6) AS beam_hit, round(avg(CASE WHEN estimate > 0 AND best > 0 THEN estimate / best END), 6) AS estimate_ratio FROM b""")
def beam_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.array("p_name", "p_brand").alias("beam"), F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("none")).alias("targets"), F.col("p_size").alias("estimate"), (F.col("p_partkey") % 3).alias("best_estimate"))
    return grouping.beam_evaluation(rows)


@query(r"""WITH r AS (SELECT replace(p_name, ' ', '\s+') AS regex_norm, p_name, p_brand FROM part), s AS (SELECT regex_norm AS grp, regexp_extract(lower(p_brand), '^[^a-z0-9]*[a-z0-9]+') AS prefix, count(DISTINCT p_brand) AS support FROM r GROUP BY 1, 2)
    SELECT DISTINCT p_name AS regex, prefix, support FROM r JOIN (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY support DESC, length(prefix) DESC, prefix) AS k FROM s) ON regex_norm = grp WHERE k = 1""")
def provided_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes for a pattern from its shape's group."""
    rows = table(spark, d, "part").withColumn("regex_norm", grouping.normalized(F.col("p_name")))
    support = grouping.prefix_support(rows, "regex_norm", "p_brand", 1)
    provider = grouping.PrefixProvider(rows.select("regex_norm").distinct(), grouping.best_prefixes(support))
    return provider.prefixes(table(spark, d, "part").select(F.col("p_name").alias("regex")).distinct()).select("regex", "prefix", "support")


@query(r"SELECT 'a\d' AS pattern, 'a\d' AS plain UNION ALL SELECT 'a\\d', 'a\d' UNION ALL SELECT 'a\\\\d', 'a\d'")
def unescaped_patterns(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["a\\d", "a\\\\d", "a\\\\\\\\d"]
    return spark.createDataFrame([(p, unescape_pattern(p)) for p in patterns], "pattern string, plain string")


@query("SELECT (event_id + 1 - 1) // 10 AS id, event_type = 'click' AS vulnerable FROM events")
def status_log(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("event_id") + 1).cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(number, F.lit(": success"))).when(F.col("event_type") == "view", F.concat(number, F.lit(" failed: timeout"))).otherwise(F.concat(number, F.lit(": unknown")))
    return metrics.parse_status_log(table(spark, d, "events").select(line.alias("value")))


@query("SELECT event_id // 10 AS id, event_type AS pattern, event_type = 'click' AS vulnerable FROM events")
def section_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of sections, written and read with their separator."""
    path = shared_folder(spark, "section-log")
    result = F.when(F.col("event_type") == "click", "RESULT-TRUE").otherwise("RESULT-FALSE")
    section = F.concat(F.lit("\nid:"), (F.col("event_id") + 1).cast("string"), F.lit("\n"), F.col("event_type"), F.lit("\n"), result, F.lit("\n"))
    table(spark, d, "events").select(section.alias("value")).write.option("lineSep", metrics.SECTION).text(path)
    return metrics.parse_section_log(spark.read.option("lineSep", metrics.SECTION).text(path))


@query("SELECT * FROM (VALUES ('n', '5'), ('zx', '10')) t(gram, pos)")
def mapping_file(spark: SparkSession, d: str) -> DataFrame:
    """A map of grams in its file format: an object with k, mapping and stats."""
    path = shared_folder(spark, "mapping")
    value = json.dumps({"k": 64, "mapping": {"n": 5, "zx": 10}, "stats": {"n": 2}})
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(path)
    rows = spark.read.schema("k int, mapping map<string,string>").json(path)
    return rows.select(F.explode("mapping").alias("gram", "pos"))
