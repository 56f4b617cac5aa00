"""What the operators share: scratch tables in the cluster's shared folder, Arrow helpers, gapless ranks, components."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of Arrow data handed to a Python worker at once.
BATCH_BYTES = 32 << 20
#: Keys that a broadcast may hold; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Rows of a few numbers in one file of a table whose size is known.
FILE_ROWS = 250_000
#: Spark's own setting: remove an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_for(spark: SparkSession, rows: int, each: int = FILE_ROWS) -> int:
    """Files for so many rows, one for each core at least.

    Hadoop starts three processes for each file in a local folder (chmod of folder, file and checksums), and each shares all
    memory of its executor until it runs, so that for a moment the executor's memory is seen twice.
    """
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / each))


class Scratch:
    """Tables written to the folder that all executors share, so that a lost executor costs no lineage.

    The folder is ``spark.checkpoint.dir`` of the session; a session without it must be one local process, as in tests, and gets
    a local folder. Shuffle files behind a table go as soon as it is written. Tables can be dropped as soon as a later one replaces them; the rest goes when the driver ends.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            Scratch._own = Scratch._own or tempfile.mkdtemp(prefix="trawl-scratch-")
            base = f"file://{Scratch._own}"
        self.base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop, "")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def files(self, rows: int, each: int = FILE_ROWS) -> int:
        return files_for(self.spark, rows, each)

    def table(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write ``df``, by at most ``files`` tasks, and read it again; the plan behind it ends here."""
        df = df if files is None else df.coalesce(files)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            for name in names:
                target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone when the driver ends
            if any(names):
                raise


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to forget shuffles that no plan needs any more, so that their files go."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gapless_rank(written: DataFrame, group: list[str], order: list[Column], out: str, part: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, though one group may hold most rows.

    ``written`` is a table that can be read twice with the same rows; its column ``part`` names the slice (the task that wrote
    the row). Rows are numbered inside (group, slice) and moved by the sizes of the group's slices before it.
    """
    sizes = written.groupBy(*group, part).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*group, part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, part).orderBy(*order)
    ranked = written.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(base, [*group, part]).withColumn(out, (F.col("_rank") + F.col("_base")).cast("long")).drop("_rank", "_base")


def components(edges: DataFrame, scratch: Scratch, name: str, limit: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges(u, v)`` as a written table ``(node, component)``, the component being its smallest node.

    Alternates large-star and small-star steps: each hangs a node's neighbours onto the smallest of them, with a minimum per
    node (combined before the shuffle) and a join. The minima are broadcast while there are few edges; beyond that they are
    written, so that both sides of the join are plain shuffles, which Spark splits where one node has most edges. Every step is
    written, and only counts reach the driver. ``rows``, about the number of edges, keeps small tables in few files.
    """
    def signature(table: DataFrame) -> tuple:
        hashed = F.xxhash64("u", "v")  # two sums over all 64 bits
        return tuple(table.agg(F.count("*"), F.sum(hashed.cast("decimal(20,0)")), F.bit_xor(hashed)).first())

    def hung(held: DataFrame, lowest: DataFrame, at: str) -> DataFrame:
        if 2 * seen[0] <= BROADCAST_KEYS:
            return held.join(F.broadcast(lowest), "u")
        return held.join(scratch.table(lowest, f"{name}-{at}", files()), "u")

    def files() -> int | None:
        return None if rows is None else scratch.files(2 * seen[0])

    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table, last = scratch.table(edges, f"{name}-0", None if rows is None else scratch.files(rows)), f"{name}-0"
    seen = signature(table)
    for step in range(1, limit + 1):
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = table.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node's neighbours above it
        large = hung(larger, lowest, "large").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hung(large, lowest, "small").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = scratch.table(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}", files())
        scratch.drop(last)
        last, now = f"{name}-{step}", signature(table)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    scratch.drop(f"{name}-large", f"{name}-small")
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    settled = scratch.table(table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), name, files())
    scratch.drop(last)
    return settled


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
