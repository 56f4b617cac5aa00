"""Named queries of the engine on the test tables, and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.regex_dialect import to_java, to_re2
from ..operators import batch, grams, grouping, metrics, sampling, search, signatures, windows, workload
from ..operators.arms import ARMS
from ..operators.search import refusal
from ..session import shared_folder
from ..sources.readers import dense_ids, read_documents
from ..streaming.filters import stream_matches

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NEAR = r"\ythe\y(?:.|\n){0,30}?\yand\y"
LITERAL = r"thing [a-z]+ the"
EITHER = r"(?:hathe|anthe|ciónla|einen) [a-z]"
WORDS = r"on the [a-z]{2,6} of"
WORKLOAD = {"p0": NEAR, "p1": LITERAL, "p2": EITHER, "p3": r"[0-9]{3}-[0-9]{4}", "p4": r"\yque\y"}
MAPPING = {g: i for i, g in enumerate(["th", "he", "on", "an", "qu", "ei", "ch", "ou", "ón", "ng", "zx", "e "])}


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _re(pattern: str) -> str:
    return "'" + to_re2(pattern).replace("'", "''") + "'"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


# Searches.


@query(f"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, {_re(NEAR)})")
def regex_count(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), NEAR)


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(NEAR)})")
def regex_ids(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), NEAR, "ids")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(NEAR)}) ORDER BY doc_id LIMIT 100")
def regex_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), NEAR, "topk")


@query(f"SELECT doc_id, text FROM documents WHERE regexp_matches(text, {_re(LITERAL)})")
def regex_texts(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), LITERAL, "texts")


@query(r"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '\bstupid\b', 'i')")
def regex_count_ci(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), r"\yStupid\y", ignore_case=True)


@query(f"SELECT count(*) AS n FROM documents WHERE NOT regexp_matches(text, {_re(NEAR)})")
def regex_not_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(~search.pg_rlike(F.col("text"), NEAR)).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(LITERAL)})")
def seqscan_ids(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), LITERAL, "ids", filtered=False)


@query(f"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, {_re(LITERAL)})")
def literal_prefilter_count(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), LITERAL, lengths=True)


@query(f"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, {_re(EITHER)})")
def literal_or_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), EITHER)


@query(f"""SELECT *, round(n_candidates / n_rows, 6) AS candidate_ratio FROM (SELECT count(*) AS n_rows,
    count(*) FILTER (WHERE contains(text, 'thing ') AND contains(text, ' the')) AS n_candidates,
    count(*) FILTER (WHERE regexp_matches(text, {_re(LITERAL)})) AS n_matches FROM documents)""")
def prefilter_candidates(spark: SparkSession, d: str) -> DataFrame:
    return search.candidate_counts(docs(spark, d), LITERAL)


@query(f"""SELECT arm, n FROM (SELECT unnest(['direct', '3way', 'multiway']) AS arm), (SELECT count(*) AS n FROM documents
    WHERE regexp_matches(text, {_re(WORDS)}))""")
def arms_counts(spark: SparkSession, d: str) -> DataFrame:
    column = F.col("text")
    tests = {a: F.lit(True) if (c := search.literal_prefilter(column, WORDS, a)) is None else c for a in ARMS}
    counted = docs(spark, d).agg(*[F.count_if(t & search.pg_rlike(column, WORDS)).alias(a) for a, t in tests.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("n")) for a in ARMS])).alias("x")).select("x.*")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%THING %' AND text ILIKE '% the%'")
def ilike_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(search.ilike_prefilter(F.col("text"), LITERAL)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500 AND regexp_matches(text, {_re(LITERAL)})")
def user_where(spark: SparkSession, d: str) -> DataFrame:
    return search.search(docs(spark, d), LITERAL, "ids", user_where="lang = 'en' AND n_chars > 500")


@query("SELECT doc_id FROM documents WHERE starts_with(text, 'The ') AND regexp_matches(text, 'ing [a-z]+ of')")
def prefix_like_ids(spark: SparkSession, d: str) -> DataFrame:
    return search.starts_with(docs(spark, d), "The ", "ing [a-z]+ of").select("doc_id")


@query("SELECT count(*) AS n FROM documents WHERE starts_with(lower(text), 'th')")
def prefix_ilike_count(spark: SparkSession, d: str) -> DataFrame:
    return search.starts_with(docs(spark, d), "TH", ignore_case=True).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 10 AND regexp_matches(text, {_re(WORDS)})")
def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(docs(spark, d), WORDS, lengths=True).select("doc_id", F.length("text").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(LITERAL)})")
def candidate_semi_join(spark: SparkSession, d: str) -> DataFrame:
    held = grams.leaf_postings(docs(spark, d), ["thing "]).select("doc_id")
    return search.search(docs(spark, d).join(held, "doc_id", "left_semi"), LITERAL, "ids")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def ordered_offset(spark: SparkSession, d: str) -> DataFrame:
    return read_documents(f"{d}/documents.parquet", spark, 50, 100).select("doc_id")


@query("SELECT count(*) AS n, min(id) AS low, max(id) AS high, count(DISTINCT id) AS ids FROM (SELECT row_number() OVER (ORDER BY doc_id) AS id FROM documents)")
def dense_id_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = dense_ids(docs(spark, d).select("doc_id", "lang"), "id")
    return rows.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids"))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<title>[^<]{5,40}</title>')")
def pages_regex(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "pages"), "<title>[^<]{5,40}</title>", "ids", text="html", id_col="page_id")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'http://th') AND regexp_matches(url, '/(?:en|de)/')")
def pages_url_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.starts_with(table(spark, d, "pages"), "http://th", "/(?:en|de)/", "url").select("page_id")


@query(r"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(text, '\bthe\b.{0,20}\bof\b')")
def conversations_regex(spark: SparkSession, d: str) -> DataFrame:
    found = search.matches(table(spark, d, "conversations"), r"\ythe\y[^\n]{0,20}\yof\y", user_where="role = 'user'")
    return found.select("conv_id", "turn")


@query("SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(props, '\"k\": [0-9]{2}}') GROUP BY event_type")
def events_props_regex(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(table(spark, d, "events"), r'"k": [0-9]{2}\}', "props").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(?:red|small) [a-z]*g')")
def part_name_regex(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(table(spark, d, "part"), "^(?:red|small) [a-z]*g", "p_name").select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE regexp_matches(p_name, 'widget$') AND l_quantity > 45")
def lineitem_part_regex(spark: SparkSession, d: str) -> DataFrame:
    parts = search.matches(table(spark, d, "part"), "widget$", "p_name").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").filter("l_quantity > 45").join(parts, "l_partkey").select("l_orderkey", "l_linenumber")


# Tokens.

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_-]+', ' ', 'g'), '\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def token_table(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", search.text_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'and', 'that'])")
def token_contains(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(search.holds_tokens(F.col("text"), ["the", "and", "that"])).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['que', 'para', 'los'])")
def token_array_contains(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("t", search.text_tokens(F.col("text"))).filter(search.has_tokens(F.col("t"), ["que", "para", "los"])).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, ' for the (?:an|th)')")
def token_search_ids(spark: SparkSession, d: str) -> DataFrame:
    return search.token_search(docs(spark, d), " for the (?:an|th)").select("doc_id")


# Grams and postings.


def _gram_sql(n: int, source: str = "documents", id_col: str = "doc_id", text: str = "text") -> str:
    return f"SELECT DISTINCT {id_col} AS doc_id, substring(text, i::BIGINT, {n}) AS gram FROM (SELECT {id_col}, {text} AS text, unnest(range(1, length({text}) - {n - 2})) AS i FROM {source})"


@query(f"SELECT gram, count(*) AS df FROM ({_gram_sql(2)}) GROUP BY gram")
def bigram_df(spark: SparkSession, d: str) -> DataFrame:
    return grams.gram_df(docs(spark, d), 2)


@query(f"SELECT gram, count(*) AS df FROM ({_gram_sql(3, 'pages', 'page_id', 'url')}) GROUP BY gram")
def trigram_df(spark: SparkSession, d: str) -> DataFrame:
    return grams.gram_df(table(spark, d, "pages"), 3, "url", "page_id")


@query(f"SELECT gram, df, round(df / (SELECT count(*) FROM documents), 6) AS sel FROM (SELECT gram, count(*) AS df FROM ({_gram_sql(2)}) GROUP BY gram) WHERE df <= 0.1 * (SELECT count(*) FROM documents)")
def gram_selectivity(spark: SparkSession, d: str) -> DataFrame:
    total = docs(spark, d).agg(F.count("*").alias("total"))
    found = grams.gram_df(docs(spark, d), 2).crossJoin(F.broadcast(total))  # one row
    return found.filter(F.col("df") <= 0.1 * F.col("total")).select("gram", "df", F.round(F.col("df") / F.col("total"), 6).alias("sel"))


_URLS = " UNION ALL ".join(f"SELECT gram, {n} AS n, count(*) AS df FROM ({_gram_sql(n, 'pages', 'page_id', 'url')}) GROUP BY gram" for n in range(1, grams.LONGEST + 1))
_KEYS = f"""WITH g AS MATERIALIZED ({_URLS}), t AS (SELECT count(*) AS total FROM pages),
    keys AS (SELECT gram, n, df FROM g, t WHERE df <= 0.1 * total AND (n = 1 OR substring(gram, 1, n - 1) IN (SELECT gram FROM g, t WHERE df > 0.1 * total)))"""


@query(f"{_KEYS} SELECT gram, n, df FROM keys")
def useful_keys(spark: SparkSession, d: str) -> DataFrame:
    return grams.useful_keys(table(spark, d, "pages"), 0.1, text="url", id_col="page_id").select("gram", "n", "df")


@query(f"""{_KEYS} SELECT gram, df FROM keys k WHERE NOT EXISTS (SELECT 1 FROM keys s WHERE s.n < k.n AND ends_with(k.gram, s.gram))""")
def presuf_shell(spark: SparkSession, d: str) -> DataFrame:
    return grams.presuf_shell(grams.useful_keys(table(spark, d, "pages"), 0.1, text="url", id_col="page_id")).select("gram", "df")


def _postings(spark: SparkSession, d: str, *patterns: str) -> DataFrame:
    return grams.pattern_postings(docs(spark, d), list(patterns))


@query(f"SELECT gram, count(*) AS df FROM ({_gram_sql(3)}) WHERE gram IN ('the', 'ing', 'que', 'zzz', 'ein') GROUP BY gram")
def postings_df(spark: SparkSession, d: str) -> DataFrame:
    rows = grams.postings(docs(spark, d), lengths=(3,)).filter(F.col("gram").isin("the", "ing", "que", "zzz", "ein"))
    return grams.bitmap_cardinality(grams.bitmap_postings(rows))


@query("SELECT count(*) AS n FROM documents WHERE contains(text, 'the') AND contains(text, 'ing') AND contains(text, 'hea')")
def postings_and(spark: SparkSession, d: str) -> DataFrame:
    return grams.bitmap_and(grams.bitmap_postings(grams.leaf_postings(docs(spark, d), ["the", "ing", "hea"])), ["the", "ing", "hea"])


@query("SELECT count(*) AS n FROM documents WHERE contains(text, 'que') OR contains(text, 'ein')")
def postings_or(spark: SparkSession, d: str) -> DataFrame:
    return grams.bitmap_or(grams.bitmap_postings(grams.leaf_postings(docs(spark, d), ["que", "ein"])), ["que", "ein"])


@query("SELECT doc_id AS p_partkey, array_to_string(list_sort(list(gram)), ',') AS grams FROM (" + _gram_sql(3, "part", "p_partkey", "p_name") + ") GROUP BY doc_id")
def trigram_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(grams.gram_array(F.col("p_name"), 3)), ",").alias("grams"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(WORDS)})")
def index_query_ids(spark: SparkSession, d: str) -> DataFrame:
    return grams.index_search(docs(spark, d), _postings(spark, d, WORDS), WORDS)


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(EITHER)})")
def index_or_query_ids(spark: SparkSession, d: str) -> DataFrame:
    return grams.index_search(docs(spark, d), _postings(spark, d, EITHER), EITHER)


_CANDIDATES = " AND ".join(f"contains(text, '{g}')" for g in ("thi", "hin", "ing", "ng ", " th", "the"))


@query(f"""SELECT n_rows, n_candidates, round(n_candidates / n_rows, 6) AS candidate_ratio, CASE WHEN n_candidates / n_rows > 0.5 THEN 'scan' ELSE 'index' END AS decision
    FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_CANDIDATES}) AS n_candidates FROM documents)""")
def candidate_ratio_gate(spark: SparkSession, d: str) -> DataFrame:
    return grams.gate_decision(docs(spark, d), _postings(spark, d, LITERAL), LITERAL)


@query(" UNION ALL ".join(f"SELECT '{k}' AS pid, doc_id FROM documents WHERE regexp_matches(text, {_re(p)})" for k, p in WORKLOAD.items()))
def multi_pattern_index(spark: SparkSession, d: str) -> DataFrame:
    return batch.pattern_ids(docs(spark, d), WORKLOAD, _postings(spark, d, *WORKLOAD.values()))


@query(" UNION ALL ".join(f"SELECT '{k}' AS pid, count(*) AS n FROM documents WHERE regexp_matches(text, {_re(p)})" for k, p in WORKLOAD.items()))
def multi_regex_matrix(spark: SparkSession, d: str) -> DataFrame:
    return batch.pattern_counts(docs(spark, d), WORKLOAD)


# Signatures.

_SIG = " + ".join(f"(CASE WHEN contains(text, '{g}') THEN {1 << p} ELSE 0 END)" for g, p in MAPPING.items())


@query(f"SELECT doc_id, ({_SIG})::BIGINT AS sig FROM documents")
def signature_build(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", signatures.signature(F.col("text"), MAPPING).alias("sig"))


@query(f"SELECT doc_id FROM documents WHERE ((({_SIG})::BIGINT) & 7) = 7")
def signature_filter(spark: SparkSession, d: str) -> DataFrame:
    signed = docs(spark, d).select("doc_id", signatures.signature(F.col("text"), MAPPING).alias("sig"))
    return signed.filter(signatures.mask_test(F.col("sig"), 7)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(LITERAL)})")
def signature_search(spark: SparkSession, d: str) -> DataFrame:
    signed = docs(spark, d).withColumn("sig", signatures.signature(F.col("text"), MAPPING))
    return signatures.signature_search(signed, LITERAL, MAPPING).select("doc_id")


@query(f"""SELECT bit, count(*) AS n FROM (SELECT unnest(range(0, {len(MAPPING)})) AS bit, sig FROM (SELECT ({_SIG})::BIGINT AS sig FROM documents))
    WHERE ((sig >> bit) & 1) = 1 GROUP BY bit""")
def signature_bit_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(signatures.signature_words(F.col("text"), {g: p + 64 for g, p in MAPPING.items()})[1].alias("sig"))
    bits = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(len(MAPPING) - 1)))).filter(F.expr("shiftright(sig, bit) & 1 = 1"))
    return bits.groupBy(F.col("bit").cast("long").alias("bit")).agg(F.count("*").alias("n"))


_PLAIN = ["abcde", "bcdab", "abx", "xabab", "zz"]


@query(f"""SELECT gram, n_queries, (row_number() OVER (ORDER BY n_queries DESC, gram) - 1)::INTEGER AS pos FROM (SELECT gram, count(DISTINCT q) AS n_queries FROM (
    SELECT q, substring(p, i::BIGINT, 2) AS gram FROM (SELECT *, unnest(range(1, length(p))) AS i FROM (SELECT unnest(range(0, 5)) AS q, unnest({_sql_list(_PLAIN)}) AS p))) GROUP BY gram)
    ORDER BY n_queries DESC, gram LIMIT 5""")
def query_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    return signatures.top_grams(signatures.query_gram_frequency(spark, _PLAIN), 5)


@query("""WITH a AS (SELECT n_nationkey AS pos, n_name AS gram FROM nation), b AS (SELECT (n_nationkey + (CASE WHEN n_nationkey > 20 THEN 1 ELSE 0 END)) AS pos, n_name AS gram FROM nation WHERE n_nationkey <> 3)
    SELECT *, n_different = 0 AS same_set, n_different = 0 AND n_common = n_same_pos AS same_order FROM (SELECT count(*) FILTER (WHERE a.pos IS NULL OR b.pos IS NULL) AS n_different,
    count(*) FILTER (WHERE a.pos IS NOT NULL AND b.pos IS NOT NULL) AS n_common, count(*) FILTER (WHERE a.pos = b.pos) AS n_same_pos FROM a FULL JOIN b ON a.gram = b.gram)""")
def mapping_consistency(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_name").alias("gram"), F.col("n_nationkey").alias("pos"))
    b = a.filter("pos <> 3").withColumn("pos", F.col("pos") + F.when(F.col("pos") > 20, 1).otherwise(0))
    return signatures.compare_mappings(a, b)


# Samples.


@query("SELECT min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents")
def id_bounds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.id_bounds(docs(spark, d))


@query("SELECT o_orderkey + 1 AS probe, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS id FROM (SELECT DISTINCT o_orderkey FROM orders)")
def next_id_probe(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders")
    return sampling.next_ids(ids, ids.select((F.col("o_orderkey") + 1).alias("probe")), "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey LIMIT 90")
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    return sampling.exact_sample(table(spark, d, "orders").select("o_orderkey"), 90, key=key)


@query("""SELECT bucket, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r FROM (
    SELECT doc_id, least(19, floor((doc_id - (SELECT min(doc_id) FROM documents)) * 20 / ((SELECT max(doc_id) - min(doc_id) + 1 FROM documents))))::INTEGER AS bucket FROM documents)) WHERE r <= 5""")
def stratified_bucket_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bucket_sample(docs(spark, d).select("doc_id"), 100).select("bucket", "doc_id")


@query("SELECT ((11 + i * 7919) % 1000 + 5)::BIGINT AS id FROM (SELECT unnest(range(0, 300)) AS i)")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stride_ids(spark, 5, 1004, 300, 11, 7919)


@query("SELECT doc_id FROM documents WHERE (doc_id * 2654435761) % 4294967296 / 4294967296.0::DOUBLE < 0.1")
def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bernoulli(docs(spark, d).select("doc_id"), 10, key=sampling.uniform("doc_id"))


@query("""WITH b AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents), p AS (SELECT id, (floor((id * 2654435761) % 4294967296 / 4294967296.0::DOUBLE * (high - low + 1)) + low)::BIGINT AS probe FROM (SELECT unnest(range(0, 250)) AS id), b),
    n AS (SELECT (SELECT min(doc_id) FROM documents WHERE doc_id >= probe) AS doc_id, min(id) AS o FROM p GROUP BY probe) SELECT doc_id FROM n GROUP BY doc_id ORDER BY min(o) LIMIT 50""")
def jump_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.jump_sample(docs(spark, d).select("doc_id"), 50, key=sampling.uniform("id"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY pow((doc_id * 2654435761) % 4294967296 / 4294967296.0::DOUBLE, 1.0::DOUBLE / n_chars) DESC LIMIT 50")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted_sample(docs(spark, d).select("doc_id", "n_chars"), "n_chars", 50, key=sampling.uniform("doc_id"))


# Spans.


@query("SELECT doc_id, i::INTEGER AS s, (i + 2)::INTEGER AS e FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents) WHERE substring(text, i::BIGINT, 3) = 'ana'")
def find_all_spans(spark: SparkSession, d: str) -> DataFrame:
    spans.register(spark)
    found = docs(spark, d).filter("contains(text, 'ana')")
    return found.lateralJoin(spans.RegexFindAll(F.col("text").outer(), F.lit("ana"), F.lit(True))).select("doc_id", "s", "e")


@query("SELECT doc_id, strpos(text, 'hea')::INTEGER AS s, (strpos(text, 'hea') + 2)::INTEGER AS e FROM documents WHERE contains(text, 'hea')")
def span_first(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", spans.first_span(F.col("text"), to_java("hea")).alias("x")).filter("x is not null").select("doc_id", "x.s", "x.e")


@query("SELECT doc_id, len(regexp_extract_all(text, 'an[a-e]'))::INTEGER AS n FROM documents")
def span_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", spans.span_count(F.col("text"), to_java("an[a-e]")).alias("n"))


@query("SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(range(1, length(text) - 1)) AS i) WHERE substring(text, i::BIGINT, 3) = 'ana')::INTEGER AS n FROM documents")
def span_count_overlap(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", spans.span_count(F.col("text"), "ana", True).alias("n"))


@query("SELECT doc_id, CASE WHEN substring(text, 1, 2) = 'Th' THEN 0 WHEN substring(text, 5, 2) = 'Th' THEN 1 WHEN length(text) >= 12 AND substring(text, 10, 2) = 'Th' THEN 2 ELSE -1 END AS w FROM documents")
def verify_windows(spark: SparkSession, d: str) -> DataFrame:
    places = F.array(*[F.lit(x) for x in (1, 2, 5, 9, 10, 12)])
    return docs(spark, d).select("doc_id", spans.regex_verify_windows("text", F.lit("Th"), places).alias("w"))


@query("SELECT doc_id, substring(text, 3, 2) = 'er' AS exact, substring(text, 3, 2) = 'er' AS upto, CASE WHEN substring(text, 3, 2) = 'er' THEN '3-4' END AS at FROM documents")
def match_spans(spark: SparkSession, d: str) -> DataFrame:
    text, pattern = F.col("text"), F.lit("er")
    at = spans.regex_find_at_upto(text, pattern, F.lit(3), F.lit(4))
    return docs(spark, d).select("doc_id", spans.regex_match_span(text, pattern, F.lit(3), F.lit(4)).alias("exact"), spans.regex_match_from_upto(text, pattern, F.lit(3), F.lit(4)).alias("upto"), F.when(at.isNotNull(), F.array_join(at.cast("array<string>"), "-")).alias("at"))


@query("SELECT doc_id, strpos(substring(text, 20), 'an')::INTEGER + 19 AS s FROM documents WHERE contains(substring(text, 20), 'an')")
def find_from_place(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", spans.regex_find_from("text", F.lit("an"), F.lit(20)).alias("x")).filter("x is not null").select("doc_id", F.col("x")[0].alias("s"))


@query("SELECT doc_id, len(list_filter(range(1, length(text) - 2), lambda i: substring(text, i::BIGINT, 4) = 'tion'))::INTEGER AS n FROM documents")
def literal_positions(spark: SparkSession, d: str) -> DataFrame:
    return spans.literal_places(docs(spark, d), "tion").select("doc_id", F.size("places").alias("n"))


@query(f"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, {_re(WORDS)})")
def window_search_ids(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_search(docs(spark, d), WORDS).filter("matched").select("id")


# Workloads and groups.


@query("SELECT item_id, regexp_matches(text, '^' || regexp_extract(text, '^[A-Za-z]+') || '[ ,.]') AS matches_seed FROM benchmark")
def seed_self_check(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "benchmark").select("item_id", F.col("text").alias("seed"), F.concat(F.lit("^"), F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit("[ ,.]")).alias("pattern"))
    return batch.self_check(seeds).select("item_id", "matches_seed")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    pool = workload.gram_pool(seeds, 3, 2, 0.375)
    return workload.generate(seeds, pool, workload.Policy())


@query()
def workload_generate(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).drop("regex_hash", "exposure")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2")
def cap_per_key(spark: SparkSession, d: str) -> DataFrame:
    return workload.cap_per_key(table(spark, d, "conversations"), "conv_id", 2, "turn").select("conv_id", "turn", "role")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return workload.dedup_first(docs(spark, d), ["source", "lang"], "doc_id").select("source", "doc_id")


_WORDS_SQL = "regexp_extract_all(text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*')"


@query(f"""SELECT doc_id, n_tokens, n_struct, n_alpha, struct_ratio, CASE WHEN struct_ratio = 0 THEN 0 WHEN struct_ratio < 0.25 THEN 1 WHEN struct_ratio < 0.5 THEN 2 ELSE 3 END AS bin,
    CASE WHEN struct_ratio >= 0.5 THEN 1.0 WHEN struct_ratio >= 0.25 THEN 0.9 WHEN struct_ratio > 0 THEN 0.65 ELSE 0.35 END::DOUBLE AS diversity FROM (SELECT doc_id, len(w)::INTEGER AS n_tokens,
    len(list_filter(w, lambda x: regexp_matches(x, '[0-9-]')))::INTEGER AS n_struct, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+')))::INTEGER AS n_alpha,
    round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9-]'))) / len(w) ELSE 0 END, 6)::DOUBLE AS struct_ratio FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents))""")
def struct_token_stats(spark: SparkSession, d: str) -> DataFrame:
    found = workload.struct_stats(docs(spark, d))
    return found.select("doc_id", "n_tokens", "n_struct", "n_alpha", "struct_ratio", "bin", F.col("diversity").cast("double").alias("diversity"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g'))::INTEGER AS n FROM documents")
def word_char_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", workload.word_chars(F.col("text")).alias("n"))


_SHAPES = r"""SELECT p_partkey, p_name, replace(p_name, ' ', '\ ') || '[a-z]{' || p_size || '}' AS regex,
    regexp_replace(regexp_replace(replace(p_name, ' ', '\ ') || '[a-z]{' || p_size || '}', '(?:\\ | )+', '\\s+', 'g'), '\{[0-9]+\}', '{n}', 'g') AS regex_norm FROM part"""


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("\\ ")), F.lit("[a-z]{"), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, d, "part").select("p_partkey", "p_name", pattern.alias("regex"))


@query(f"""WITH w AS ({_SHAPES}), e AS (SELECT regex_norm, regex, count(*) AS n FROM w GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY regex_norm ORDER BY n DESC, regex) AS r FROM e)
    SELECT b.regex_norm, b.regex AS regex_canon, b.n AS canon_freq, (SELECT sum(n) FROM e WHERE e.regex_norm = b.regex_norm)::BIGINT AS group_size FROM b WHERE r = 1""")
def regex_norm_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.groups(_shaped(spark, d), seed="p_partkey").drop("seed_ids_sampled")


@query(f"SELECT *, round(n_norm / n_rows, 6) AS norm_ratio FROM (SELECT count(*) AS n_rows, count(DISTINCT regex) AS n_raw, count(DISTINCT regex_norm) AS n_norm FROM ({_SHAPES}))")
def shape_stats(spark: SparkSession, d: str) -> DataFrame:
    return grouping.shape_stats(_shaped(spark, d))


@query("SELECT c_custkey, regexp_extract(c_mktsegment || ' ' || c_name, '^(?:[^A-Za-z0-9]*[A-Za-z0-9]+){2}') AS prefix FROM customer")
def token_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("t"))
    return rows.select("c_custkey", grouping.token_prefix(F.col("t"), 2).alias("prefix"))


_PREFIXES = """WITH r AS (SELECT DISTINCT p_brand AS grp, lower(p_name) AS low, p_name FROM part), c AS (SELECT grp, p_name, 1 AS tokens, regexp_extract(low, '^[a-z0-9]+') AS prefix FROM r
    UNION ALL SELECT grp, p_name, 2, low FROM r), s AS (SELECT grp, prefix, count(DISTINCT p_name) AS support, min(tokens)::INTEGER AS len_tokens FROM c GROUP BY 1, 2),
    z AS (SELECT p_brand AS grp, count(DISTINCT p_name) AS size FROM part GROUP BY 1), p AS (SELECT s.grp, prefix, support, round(support / size, 6) AS support_ratio, length(prefix)::INTEGER AS len_chars, len_tokens FROM s JOIN z ON s.grp = z.grp)"""


@query(f"{_PREFIXES} SELECT * FROM p")
def prefix_support(spark: SparkSession, d: str) -> DataFrame:
    return grouping.prefix_support(table(spark, d, "part"), "p_brand", "p_name", 2)


@query(f"""{_PREFIXES} SELECT grp, prefix, support, bucket FROM (SELECT *, row_number() OVER (PARTITION BY grp, bucket ORDER BY support DESC, len_chars DESC, prefix) AS r FROM (SELECT *, CASE WHEN len_tokens <= 1 THEN 0 ELSE 1 END AS bucket FROM p)) WHERE r = 1""")
def best_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    found = grouping.best_prefixes(grouping.prefix_support(table(spark, d, "part"), "p_brand", "p_name", 2))
    return found.select("grp", "prefix", "support", "bucket")


@query(f"{_PREFIXES} SELECT grp AS regex, prefix, round(support_ratio * log2(1 + support), 6) AS weight FROM p")
def prefix_training_rows(spark: SparkSession, d: str) -> DataFrame:
    return grouping.training_rows(grouping.prefix_support(table(spark, d, "part"), "p_brand", "p_name", 2).withColumnRenamed("grp", "regex_canon"))


@query("""SELECT round(avg((p_name = t)::INTEGER), 6) AS exact, round(avg((starts_with(t, p_name) OR starts_with(p_name, t))::INTEGER), 6) AS startswith_any, round(avg(length(p_name)), 6) AS avg_len
    FROM (SELECT p_name, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN regexp_extract(p_name, '^[a-z]+') ELSE 'zz' END AS t FROM part)""")
def prefix_evaluation(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.regexp_extract("p_name", "^[a-z]+", 0)).otherwise("zz")
    return grouping.prefix_evaluation(table(spark, d, "part").select(F.col("p_name").alias("predicted"), F.array(target).alias("targets")))


@query("SELECT o_orderpriority, count(*) AS group_size, round(quantile_cont(o_totalprice, 0.5), 6) AS cand_est_median, round(sum(o_custkey::DOUBLE), 6) AS hits_est_sum FROM orders GROUP BY o_orderpriority")
def group_estimates(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_estimates(table(spark, d, "orders").withColumn("hits", F.col("o_custkey").cast("double")), "o_orderpriority", "o_totalprice", "hits")


@query("""WITH g AS (SELECT count(*) AS size FROM orders GROUP BY o_custkey), s AS (SELECT list_sort(list(size)) AS l FROM g)
    SELECT p, l[round_even(p * (len(l) - 1), 0)::BIGINT + 1] AS size FROM s, (SELECT unnest([0.5::DOUBLE, 0.9, 0.99]) AS p)""")
def size_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return grouping.size_quantiles(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n")


@query("SELECT 'ein' AS gram, doc_id FROM documents WHERE contains(text, 'ein') UNION ALL SELECT 'que', doc_id FROM documents WHERE contains(text, 'que')")
def bitmap_ids(spark: SparkSession, d: str) -> DataFrame:
    return grams.bitmap_ids(grams.bitmap_postings(grams.leaf_postings(docs(spark, d), ["ein", "que"])))


@query("""SELECT doc_id, array_to_string(p, ',') AS places FROM (SELECT doc_id, list_filter(range(1, length(text) - 1), lambda i: substring(text, i::BIGINT, 3) IN ('que', 'ado')) AS p FROM documents) WHERE len(p) > 0""")
def merged_places(spark: SparkSession, d: str) -> DataFrame:
    rows = spans.literal_places(docs(spark, d), "que").withColumnRenamed("places", "a")
    rows = spans.literal_places(rows, "ado").select("doc_id", spans.merged_places(F.array("a", "places")).alias("p")).filter(F.size("p") > 0)
    return rows.select("doc_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("places"))


# Measures. Events stand for runs: their value is the duration, an event is a completion of its user's item.


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "user_id", "value", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "click").alias("passed"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg, list_sort(list(value))[floor(0.5 * (count(*) - 1))::BIGINT + 1] AS p50, list_sort(list(value))[floor(0.9 * (count(*) - 1))::BIGINT + 1] AS p90
    FROM events WHERE event_type <> 'error' GROUP BY event_type""")
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_summary(_runs(spark, d), "value", "ok", "event_type")


@query("SELECT event_type, round(avg(value), 6) AS avg, max(value) AS max, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def pctl_linear(spark: SparkSession, d: str) -> DataFrame:
    return metrics.linear_percentiles(_runs(spark, d), "value", "event_type")


_METHODS = """q AS (SELECT event_id // 3 AS qid, CASE event_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'trgm' ELSE 'prefix' END AS kind, value AS execution_time_ms, floor(value * 10)::BIGINT % 7 AS count, CASE WHEN event_type = 'error' THEN 'x' END AS error FROM events)"""


@query(f"""WITH {_METHODS}, b AS (SELECT qid, count AS base_count FROM q WHERE error IS NULL AND kind = 'base' AND count > 0)
    SELECT kind, count(*) AS n, round(avg(execution_time_ms), 6) AS avg_ms, round(avg(least(1.0::DOUBLE, count / base_count)), 6) AS avg_recall FROM q JOIN b ON q.qid = b.qid WHERE error IS NULL GROUP BY kind""")
def method_table(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "base").when(F.col("event_id") % 3 == 1, "trgm").otherwise("prefix")
    count = F.floor(F.col("value") * 10).cast("long") % 7
    return metrics.method_table(e.select(F.expr("event_id div 3").alias("qid"), kind.alias("kind"), F.col("value").alias("execution_time_ms"), count.alias("count"), F.when(F.col("event_type") == "error", "x").alias("error")))


_GOLD = " UNION ALL ".join(f"SELECT '{k}' AS pid, doc_id FROM documents WHERE regexp_matches(text, {_re(p)})" for k, p in WORKLOAD.items())


@query(f"""WITH gold AS ({_GOLD}), got AS (SELECT pid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY doc_id) AS r FROM gold) WHERE r <= 64),
    e AS (SELECT g.pid, count(*) AS n_gold, count(t.doc_id) AS n_hit FROM gold g LEFT JOIN got t ON g.pid = t.pid AND g.doc_id = t.doc_id GROUP BY g.pid)
    SELECT count(*) AS n_queries, round(avg(round(n_hit / n_gold, 6)), 6) AS macro, round(sum(n_hit) / sum(n_gold), 6) AS micro FROM e""")
def recall_macro_micro(spark: SparkSession, d: str) -> DataFrame:
    gold = batch.scan_ids(docs(spark, d), WORKLOAD)
    limited = workload.cap_per_key(gold, "pid", 64, "doc_id")
    return metrics.recall_summary(metrics.recall(gold, limited, ["pid"], "doc_id"))


@query("""SELECT conv_id, round(CASE WHEN len(gold) = 0 THEN 1 ELSE len(list_intersect(got, gold)) / len(gold) END, 6)::DOUBLE AS recall
    FROM (SELECT conv_id, list(DISTINCT turn) AS gold, list(DISTINCT turn) FILTER (WHERE role = 'user') AS got FROM conversations GROUP BY conv_id)""")
def array_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("gold"), F.collect_set(F.when(F.col("role") == "user", F.col("turn"))).alias("got"))
    return rows.select("conv_id", F.round(metrics.recall_of_arrays(F.col("got"), F.col("gold")), 6).alias("recall"))


_PASS = "SELECT user_id AS id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY user_id"


def _pass_sql(k: int) -> str:
    return f"SELECT id, n, c, round(CASE WHEN n - c < {k} THEN 1 WHEN c = 0 THEN 0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: (1 - {k}.0::DOUBLE / i)), lambda a, b: a * b) END, 6)::DOUBLE AS score FROM ({_PASS})"


@query(_pass_sql(3))
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_at_k(_runs(spark, d).withColumnRenamed("user_id", "id"), 3)


@query(" UNION ALL ".join(f"SELECT {k} AS k, CASE WHEN min(n) >= {k} THEN round(avg(score), 6) END AS score FROM ({_pass_sql(k)})" for k in (1, 3, 10)))
def mean_pass_at(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_pass_at(_runs(spark, d).withColumnRenamed("user_id", "id"))


@query("""SELECT 3 AS k, round(100 * avg(hit), 6) AS percent FROM (SELECT user_id, max((event_type = 'click')::INTEGER) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id)""")
def dfa_eq_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.any_in_first_k(_runs(spark, d).withColumnRenamed("user_id", "id"), 3, order="event_id")


@query("SELECT count(*) FILTER (WHERE p_name = 'red widget') AS hits, count(DISTINCT p_brand) AS items, round(100 * count(*) FILTER (WHERE p_name = 'red widget') / count(DISTINCT p_brand), 6) AS percent FROM part")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("completion"), F.lit("red widget").alias("expression"))
    return metrics.exact_match(rows)


@query("SELECT * FROM (VALUES ('OK', 3::BIGINT), ('CHARCLASS_ONLY', 1), ('UNSUPPORTED_ALTERNATION', 1), ('UNSUPPORTED_BACKREFERENCE', 1), ('LITS_TOO_SHORT_FOR_TRGM', 1), ('UNTERMINATED_ESCAPE', 1), ('UNTERMINATED_CLASS', 1)) t(reason, n)")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["abc", "[a-z]+", "abc|[bc]d*", r"(a[a-z])\1", "ab[0-9]", "ab\\", "[ab", "(?i)ABC", r"\yCA\-274\y"]
    return metrics.reason_histogram(spark.createDataFrame([(refusal(p),) for p in patterns], "reason string"))


@query("SELECT event_id AS id, event_type = 'click' AS vulnerable FROM events WHERE event_type IN ('click', 'view')")
def vulnerability_log(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "click", "Vulnerable").when(F.col("event_type") == "view", "not vulnerable").otherwise("?")
    return metrics.parse_vulnerability_log(table(spark, d, "events").select(F.concat_ws(": ", F.col("event_id").cast("string"), verdict).alias("value")))


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, NULL)) t(id, equivalent)")
def regex_equivalence(spark: SparkSession, d: str) -> DataFrame:
    pairs = [(1, "a|b", "[ab]"), (2, "a+", "aa*"), (3, "a*", "a+"), (4, "(?:ab){2}", "abab"), (5, r"a(?=b)", "a")]
    return metrics.equivalence(spark.createDataFrame(pairs, "id int, completion string, expression string")).select("id", "equivalent")


@query("SELECT * FROM (VALUES (1, true, true), (2, true, false), (3, false, false)) t(id, compiled, passed)")
def compile_and_match(spark: SparkSession, d: str) -> DataFrame:
    items = [(1, "[0-9]+", ["1", "22"], ["a"]), (2, "[0-9]+", ["1"], ["2"]), (3, "(", ["1"], [])]
    return metrics.compile_and_match(spark.createDataFrame(items, "id int, completion string, matches array<string>, non_matches array<string>")).select("id", "compiled", "passed")


@query("SELECT conv_id AS id, regex, positive_example FROM (SELECT conv_id, 'r' || conv_id AS regex, text AS positive_example, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3 AND length(positive_example) > 0")
def positive_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return workload.positive_pairs(rows.select(F.col("conv_id").alias("id"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("expression"), F.col("t.text").alias("matches")), 3)


@query(r"SELECT 1 AS id, '^\d$' AS regex, i::VARCHAR AS positive_example FROM (SELECT unnest(range(0, 10)) AS i) UNION ALL SELECT 2, '^\d{3}$', repeat(i::VARCHAR, 3) FROM (SELECT unnest(range(0, 10)) AS i)")
def expand_examples(spark: SparkSession, d: str) -> DataFrame:
    return workload.expand_digits(spark.createDataFrame([(1, r"^\d$"), (2, r"^\d{3}$"), (3, "abc")], "id int, expression string"))


# Streams.


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_re(LITERAL)})")
def stream_regex_ids(spark: SparkSession, d: str) -> DataFrame:
    schema = docs(spark, d).schema
    arriving, target = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*"), shared_folder(spark, "stream-regex-ids")
    found = stream_matches(arriving, LITERAL).select("doc_id")
    running = found.writeStream.format("parquet").option("path", f"{target}/ids").option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{target}/ids")


def queries() -> dict[str, Query]:
    from . import catalog_more  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_more  # noqa: F401

    return dict(_SQL)
