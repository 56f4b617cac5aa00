"""Readers: document tables from CSV, workloads from JSON, JSON Lines and text, discovery of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A workload line; missing fields are null, malformed lines are dropped.
WORKLOAD = (
    "dataset string, seed_id bigint, seed_string string, regex string, anchor_n int, expose_ratio_target double, k_max int, "
    "islands array<struct<kind:string,pos:int,tok:string,expose_len:int,n:int,gram:string,start:int>>, kept_positions array<int>, "
    "stats struct<seed_len_tokens:int,n_islands:int>"
)
ID_NAMES = ("id", "doc_id", "docid", "row_id")


def dense_ids(df: DataFrame, name: str = "id", *order: str) -> DataFrame:
    """Ids 1, 2, ... without gaps in the order of the rows' places (or of the given columns), without a single sorting task.

    Rows are numbered inside the partitions of the scan and moved by the sizes of the partitions before.
    """
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    if order:
        placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.join(F.broadcast(base), "_part").select((inside + F.col("_base")).cast("long").alias(name), *[c for c in df.columns if c != name])


def read_csv(spark: SparkSession, path: str, text_col: str = "text", limit: int | None = None, id_col: str | None = None) -> DataFrame:
    """Documents (id, text_content) of a CSV file with a header; ids are made where no column has them."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if text_col not in rows.columns:
        raise ValueError(f"no column {text_col}: {rows.columns}")
    rows = rows.limit(limit) if limit is not None else rows
    if id_col:
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text_content"))
    return dense_ids(rows.select(F.col(text_col).alias("text_content")), "id")


def has_header(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> bool:
    """Does the first line look like names: no numbers, or one of the expected names?"""
    first = spark.read.text(path).first()
    cells = [c.strip().strip('"').lower() for c in (first[0] if first else "").split(",")]
    return any(c in ID_NAMES or c in names for c in cells) or bool(cells) and not any(c.lstrip("-").replace(".", "", 1).isdigit() for c in cells)


def read_dump(spark: SparkSession, path: str, columns: tuple[str, ...], gen_id_if_missing: bool = False) -> DataFrame:
    """A CSV dump with or without a header; ids are made on demand."""
    if has_header(spark, path, columns):
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    else:
        rows = spark.read.option("multiLine", True).schema(StructType([StructField(c, StringType()) for c in columns])).csv(path)
    if not any(c.lower() in ID_NAMES for c in rows.columns):
        if not gen_id_if_missing:
            raise ValueError("the dump has no id column")
        rows = dense_ids(rows, "id")
    return rows


def read_jsonl(spark: SparkSession, path: str, schema: str = WORKLOAD, field: str | None = "regex") -> DataFrame:
    """JSON Lines; malformed lines and lines without the field are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col(field).isNotNull()) if field else rows


def read_jsonl_errors(spark: SparkSession, path: str, schema: str = WORKLOAD) -> DataFrame:
    """All lines; those that can't be read have their text in ``_error``."""
    return spark.read.schema(schema + ", _error string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_error").json(path)


def read_pool(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """Rows (gram, df) of a JSON pool of mid-frequency grams with fields like ``df3_mid_pairs``."""
    rows = spark.read.schema(f"N bigint, df_low bigint, df_high bigint, df{n}_mid_pairs array<array<string>>").option("multiLine", True).json(path)
    pairs = rows.select(F.explode(f"df{n}_mid_pairs").alias("p"))
    return pairs.select(F.col("p")[0].alias("gram"), F.col("p")[1].cast("long").alias("df"))


def read_queries(spark: SparkSession, path: str, schema: str = WORKLOAD) -> DataFrame:
    """A JSON array or JSON Lines, told apart by the first character."""
    first = spark.read.text(path, wholetext=False).filter(F.trim("value") != "").first()
    array = bool(first) and first[0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).option("mode", "DROPMALFORMED").json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """One pattern a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("regex")).filter("regex <> ''")


def discover(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Files below a folder, in order, with the workload's letter if the name has one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    return files.withColumn("workload", F.regexp_extract("path", r"(?i)workload[_-]?([A-D])", 1)).orderBy("path")


def read_documents(path: str, spark: SparkSession, limit: int | None = None, offset: int = 0, id_col: str = "doc_id", ordered: bool = False) -> DataFrame:
    """A document table; in the order of ids where rows are skipped or counted off."""
    rows = spark.read.parquet(path)
    if ordered or limit is not None or offset:
        rows = rows.orderBy(id_col).offset(offset)
    return rows.limit(limit) if limit is not None else rows


def estimated_rows(df: DataFrame) -> int:
    """The optimiser's number of rows if it knows one, else a count."""
    known = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(known.get())) if known.isDefined() else df.count()
