"""n-gram indexes: which grams are worth a posting list, the postings, and searches through them.

Grams of a text come from one lookahead extraction, which takes linear time. Minimal useful keys are found level by level: a gram
is extended only while it is too frequent, so that long grams are counted only below frequent ones. Postings are rows (gram,
doc_id), or bitmaps of 32,768 ids; a pattern's plan becomes a conjunction of disjunctions of grams, and one aggregation over the
postings answers any number of patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex_analysis import analyze
from ..plans.prefilter import TRUE, Plan, all_of, conjuncts, leaf, leaves, substitute
from ..session import shared_folder
from .search import pg_rlike, text_tokens

#: Selectivity below which a gram is useful, longest key, candidate share above which a full scan is better.
USEFUL, LONGEST, GATE = 0.1, 10, 0.5
#: Leaves or ids that may be sent as a literal list or a broadcast; more go through a shuffled join.
INLINE, BROADCAST = 5_000, 200_000


def gram_array(column: Column, n: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def doc_grams(docs: DataFrame, n: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Distinct grams of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(gram_array(F.col(text), n)).alias("gram"))


def gram_df(docs: DataFrame, n: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Document frequency of every gram."""
    return doc_grams(docs, n, text, id_col).groupBy("gram").agg(F.count("*").alias("df"))


def useful_keys(docs: DataFrame, c: float = USEFUL, longest: int = LONGEST, text: str = "text", id_col: str = "doc_id", total: int | None = None, folder: str | None = None, sample: int | None = None) -> DataFrame:
    """Grams in at most a share ``c`` of the documents whose prefix without the last character is in more.

    Each level's grams are counted once, in one pass over the texts, and written to a shared folder (by default one of its own).
    With ``sample`` the keys are found on that many documents, those whose ids have the smallest hashes; frequencies are theirs.
    """
    if sample is not None:
        chosen = docs.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
        docs = docs.join(chosen, id_col, "left_semi")
    total = docs.count() if total is None else total
    folder = folder or shared_folder(docs.sparkSession, "useful-keys")
    out, frequent = None, None
    for n in range(1, longest + 1):
        grams = doc_grams(docs, n, text, id_col)
        if frequent is not None:
            grams = grams.withColumn("head", F.substring("gram", 1, n - 1)).join(frequent.withColumnRenamed("gram", "head"), "head", "left_semi")
        counted = grams.groupBy("gram").agg(F.count("*").alias("df")).withColumn("sel", F.col("df") / F.lit(float(max(1, total))))
        counted.write.mode("overwrite").parquet(f"{folder}/{n}")
        counted = docs.sparkSession.read.schema(counted.schema).parquet(f"{folder}/{n}")
        useful = counted.filter(F.col("sel") <= c).withColumn("n", F.lit(n))
        out = useful if out is None else out.unionByName(useful)
        frequent = counted.filter(F.col("sel") > c).select("gram")
        if frequent.isEmpty():
            break
    return out


def presuf_shell(keys: DataFrame) -> DataFrame:
    """Keys of which no proper suffix is a key."""
    longest = F.length("gram")
    suffixes = keys.select("gram", F.explode(F.sequence(F.lit(1), longest - 1)).alias("drop")).filter(longest > 1)
    suffixes = suffixes.select("gram", F.expr("substring(gram, drop + 1)").alias("suffix"))
    covered = suffixes.join(keys.select(F.col("gram").alias("suffix")), "suffix", "left_semi").select("gram").distinct()
    return keys.join(covered, "gram", "left_anti")


def postings(docs: DataFrame, keys: DataFrame | None = None, lengths: tuple[int, ...] = (3,), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (gram, doc_id) for the keys of the lengths; all grams without keys. Keys of one character get none."""
    out = None
    for n in lengths:
        rows = doc_grams(docs, n, text, id_col)
        if keys is not None:
            rows = rows.join(keys.filter(F.length("gram") == n).select("gram"), "gram", "left_semi")
        out = rows if out is None else out.unionByName(rows.select(out.columns))
    return out.select("gram", "doc_id")


def leaf_postings(docs: DataFrame, wanted: list[str], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (gram, doc_id) for a few grams, without listing the others: one ``contains`` for each."""
    keys = F.array(*[F.lit(g) for g in dict.fromkeys(wanted)]).cast("array<string>")
    held = F.filter(keys, lambda g: F.contains(F.col(text), g))
    return docs.select(F.explode(held).alias("gram"), F.col(id_col).alias("doc_id"))


def pattern_postings(docs: DataFrame, patterns: list[str], n: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Posting rows of the grams that some patterns ask for."""
    return leaf_postings(docs, [g for p in patterns for g in leaves(gram_plan(p, n))], text, id_col)


def bitmap_postings(rows: DataFrame) -> DataFrame:
    """Bitmaps (gram, bucket, bitmap, df) of the posting rows."""
    bucket, bit = F.bitmap_bucket_number("doc_id"), F.bitmap_bit_position("doc_id")
    return rows.groupBy("gram", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"), F.count("*").alias("df"))


def bitmap_ids(bitmaps: DataFrame) -> DataFrame:
    """Rows (gram, doc_id) of bitmaps: bucket b holds the ids from (b - 1) * 32768 + 1 on, bucket 0 those up to 0 downwards."""

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for gram, bucket, bitmap in zip(batch["gram"], batch["bucket"], batch["bitmap"], strict=True):
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little"))
                out.append(pd.DataFrame({"gram": gram, "doc_id": (bucket - 1) * 32768 + 1 + bits if bucket > 0 else bucket * 32768 - bits}))
            yield pd.concat(out) if out else pd.DataFrame({"gram": pd.Series(dtype=str), "doc_id": pd.Series(dtype="int64")})

    return bitmaps.select("gram", "bucket", "bitmap").mapInPandas(unpack, "gram string, doc_id long")


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("gram").agg(F.sum(F.bitmap_count("bitmap")).alias("df"))


def _grams_of(literal: str, n: int) -> Plan:
    """The literal as a conjunction of its grams; TRUE if it is shorter."""
    return all_of(*[leaf(literal[i : i + n]) for i in range(len(literal) - n + 1)])


def gram_plan(pattern: str, n: int = 3) -> Plan:
    """The pattern's plan over grams of one length."""
    found = analyze(pattern)
    return TRUE if found.case_mode != "sensitive" else substitute(found.plan, lambda literal: _grams_of(literal, n))


def key_plan(plan: Plan, df: dict[str, int], most: int = 2) -> Plan:
    """Put indexed keys in the place of literals: of each literal the rarest ones, neither inside nor next to one another."""

    def change(literal: str) -> Plan:
        found = [(df[literal[i:j]], -(j - i), i, literal[i:j]) for i in range(len(literal)) for j in range(i + 2, len(literal) + 1) if literal[i:j] in df]
        chosen: list[tuple[int, str]] = []
        for _, _, at, key in sorted(found):
            if all(key not in k and k not in key and abs(at - a) > 1 for a, k in chosen):
                chosen.append((at, key))
            if len(chosen) == most:
                break
        return all_of(*[leaf(k) for _, k in chosen])

    return substitute(plan, change)


def bounds(plan: Plan, df: dict[str, int], total: int) -> int:
    """Upper bound of the candidates, from document frequencies alone."""
    if plan.kind == "LEAF":
        return min(total, df.get(plan.literal, 0))
    sizes = [bounds(p, df, total) for p in plan.parts]
    return total if plan.kind == "TRUE" else min(sizes) if plan.kind == "AND" else min(total, sum(sizes))


def plan_leaves(spark: SparkSession, plans: dict[str, Plan]) -> DataFrame:
    """Rows (pid, grp, gram, n_groups) of the plans' conjuncts."""
    rows = []
    for pid, plan in plans.items():
        groups = conjuncts(plan)
        rows += [(pid, number, gram, len(groups)) for number, group in enumerate(groups) for gram in group]
    return spark.createDataFrame(rows, "pid string, grp int, gram string, n_groups int")


def candidates(rows: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """Ids (pid, doc_id) that meet each plan; the plans must not be TRUE. One aggregation serves all of them."""
    wanted = plan_leaves(rows.sparkSession, plans)
    grams = sorted({g for plan in plans.values() for g in leaves(plan)})
    rows = rows.filter(F.col("gram").isin(grams)) if len(grams) <= INLINE else rows
    joined = rows.join(F.broadcast(wanted) if len(grams) <= BROADCAST else wanted, "gram")
    met = joined.groupBy("pid", "doc_id").agg(F.count_distinct("grp").alias("met"), F.max("n_groups").alias("n_groups"))
    return met.filter("met = n_groups").select("pid", "doc_id")


def bitmap_and(bitmaps: DataFrame, grams: list[str]) -> DataFrame:
    """Number of ids in all of the grams' posting lists."""
    rows = bitmaps.filter(F.col("gram").isin(grams)).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("lists"))
    return rows.filter(F.col("lists") == len(set(grams))).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def bitmap_or(bitmaps: DataFrame, grams: list[str]) -> DataFrame:
    """Number of ids in any of the grams' posting lists."""
    rows = bitmaps.filter(F.col("gram").isin(grams)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return rows.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def index_search(docs: DataFrame, rows: DataFrame, pattern: str, n: int = 3, gate: float = GATE, text: str = "text", id_col: str = "doc_id", total: int | None = None, df: dict[str, int] | None = None) -> DataFrame:
    """Matching ids through the postings; a full scan if the plan is TRUE or lets too many through."""
    plan = gram_plan(pattern, n)
    verified = docs.filter(pg_rlike(F.col(text), pattern)).select(F.col(id_col).alias("doc_id"))
    if plan.kind == "TRUE" or total and df and bounds(plan, df, total) > gate * total:
        return verified
    ids = candidates(rows, {"q": plan}).select("doc_id")
    small = bool(df) and bounds(plan, df, total or 0) <= BROADCAST
    return docs.withColumn("doc_id", F.col(id_col)).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").filter(pg_rlike(F.col(text), pattern)).select("doc_id")


def gate_decision(docs: DataFrame, rows: DataFrame, pattern: str, n: int = 3, gate: float = GATE) -> DataFrame:
    """Rows, candidates, their share and what the gate decides."""
    plan = gram_plan(pattern, n)
    total = docs.agg(F.count("*").alias("n_rows"))
    found = total.select(F.col("n_rows").alias("n_candidates")) if plan.kind == "TRUE" else candidates(rows, {"q": plan}).agg(F.count("*").alias("n_candidates"))
    out = total.crossJoin(found).withColumn("candidate_ratio", F.round(F.col("n_candidates") / F.col("n_rows"), 6))  # one row each
    return out.withColumn("decision", F.when(F.col("candidate_ratio") > gate, "scan").otherwise("index"))


def token_postings(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (token, doc_id): an inverted index of tokens."""
    return docs.select(F.explode(F.array_distinct(text_tokens(F.col(text)))).alias("token"), F.col(id_col).alias("doc_id"))


def holding_all(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """Ids with all of the tokens."""
    wanted = list(dict.fromkeys(tokens))
    held = rows.filter(F.col("token").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("token").alias("held"))
    return held.filter(F.col("held") == len(wanted)).select("doc_id")


def bitmap_candidates(bitmaps: DataFrame, plan: Plan) -> DataFrame:
    """Ids (doc_id) that meet a plan, from stored bitmaps: an OR in each conjunct, an AND over them, bucket by bucket."""
    wanted = plan_leaves(bitmaps.sparkSession, {"q": plan})
    rows = bitmaps.filter(F.col("gram").isin(sorted(leaves(plan)))).join(F.broadcast(wanted), "gram")  # the pattern's leaves
    each = rows.groupBy("bucket", "grp", "n_groups").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    both = each.groupBy("bucket", "n_groups").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("met"))
    return bitmap_ids(both.filter("met = n_groups").select(F.lit("").alias("gram"), "bucket", "bitmap")).select("doc_id")


def build_index(docs: DataFrame, target: str, c: float = USEFUL, longest: int = LONGEST, shell: bool = True, sample: int | None = None, text: str = "text", id_col: str = "doc_id", table: str = "docs") -> str:
    """Find useful keys, keep their shell, and store the keys and their postings over all documents as bitmaps; returns the index's name."""
    name, total = index_id(c, longest, shell, table), docs.count()
    keys = useful_keys(docs, c, longest, text, id_col, total if sample is None else None, sample=sample)
    keys = presuf_shell(keys) if shell else keys
    lengths = [r["n"] for r in keys.select("n").distinct().collect() if r["n"] > 1]  # at most `longest` rows
    rows = postings(docs, keys, tuple(sorted(lengths)), text, id_col) if lengths else docs.select(F.lit("").alias("gram"), F.col(id_col).alias("doc_id")).limit(0)
    save_index(keys, rows, target, name, total=total, c=c, longest=longest)
    return name


def key_search(docs: DataFrame, target: str, name: str, pattern: str, gate: float = GATE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Matching ids through a stored index of keys: substitution, gate, bitmaps, verification; a scan where keys don't help."""
    spark = docs.sparkSession
    keys, bitmaps = load_index(spark, target, name)
    about = spark.read.schema("params map<string,string>").json(f"{target}/{name}/meta").first()["params"]
    total = int(about["total"])
    verified = docs.filter(pg_rlike(F.col(text), pattern)).select(F.col(id_col).alias("doc_id"))
    found = analyze(pattern)
    parts = sorted({x[i:j] for x in leaves(found.plan) for i in range(len(x)) for j in range(i + 2, min(len(x), i + int(about["longest"])) + 1)})
    if found.case_mode != "sensitive" or not parts:
        return verified
    df = {r["gram"]: r["df"] for r in keys.filter(F.col("gram").isin(parts)).select("gram", "df").collect()}  # parts of one pattern
    plan = key_plan(found.plan, df)
    if plan.kind == "TRUE" or bounds(plan, df, total) > gate * total:
        return verified
    ids = bitmap_candidates(bitmaps, plan).withColumnRenamed("doc_id", id_col)
    ids = F.broadcast(ids) if bounds(plan, df, total) <= BROADCAST else ids
    return docs.join(ids, id_col, "left_semi").filter(pg_rlike(F.col(text), pattern)).select(F.col(id_col).alias("doc_id"))


def index_id(c: float = USEFUL, longest: int = LONGEST, shell: bool = True, table: str = "docs") -> str:
    """The same name for the same parameters."""
    return f"{table}_c{c:g}_l{longest}_{'shell' if shell else 'full'}"


def save_index(keys: DataFrame, rows: DataFrame, target: str, name: str, **meta: object) -> None:
    """Write keys, postings as bitmaps in the order of the grams, and a description; an index of the same name is replaced.

    A key's frequency is that among the rows, which may cover more documents than those it was found on.
    """
    spark = keys.sparkSession
    bitmaps = bitmap_postings(rows).repartitionByRange("gram").sortWithinPartitions("gram", "bucket")
    bitmaps.write.mode("overwrite").parquet(f"{target}/{name}/postings")
    df = spark.read.parquet(f"{target}/{name}/postings").groupBy("gram").agg(F.sum("df").alias("df"))
    keys.drop("df", "sel").join(df, "gram").repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{target}/{name}/keys")
    about = spark.createDataFrame([(name, {k: str(v) for k, v in meta.items()})], "index_id string, params map<string,string>")
    about.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{target}/{name}/meta")


def load_index(spark: SparkSession, target: str, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{target}/{name}/keys"), spark.read.parquet(f"{target}/{name}/postings")


def latest_index(spark: SparkSession, target: str) -> str | None:
    """The index written last."""
    meta = spark.read.schema("index_id string, params map<string,string>, created_at timestamp").json(f"{target}/*/meta")
    row = meta.orderBy(F.desc("created_at"), "index_id").first()
    return row["index_id"] if row else None


def drop_index(spark: SparkSession, target: str, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
