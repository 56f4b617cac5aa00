"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Writing range-partitions the documents by id, so that files, stripes and row groups follow each other in ascending id order and
their minima and maxima tell which hold an id. A row keeps its start within its file; how many ids the files before hold follows
from the files' own metadata columns, read without the ids. Files split by stripe, so that many tasks read one file.

Defined results: a null or empty text is the end id alone; null document ids come first; rows with equal ids follow each other
in the order of their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encoder, in_slices, lean
from .common import Scratch, free_shuffles, offsets_of, read_table, tune

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SCHEMA = "doc_id long, file int, local_start long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "5000",
    "orc.stripe.size": str(16 << 20),
    "compression": "none",  # the run-length encoding has packed the ids already
}


def _range_of(key: Column, bounds: list[float], first: int = 0) -> Column:
    """Number of bounds up to the key, as a balanced tree of comparisons; 0 for null."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key >= F.lit(int(bounds[middle])), _range_of(key, bounds[middle + 1 :], first + middle + 1)).otherwise(_range_of(key, bounds[:middle], first))


def write(docs: DataFrame, target: str, path: str, end_id: int = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids to ``target`` in ascending id order."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, file, start = encoder(path, True), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in in_slices(texts, 2_000_000):
                raw = [r + end for r in tokens.encode(texts[part])]
                lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                cuts = offsets_of(lengths)
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                keys = batch.column("doc_id").slice(part.start, len(raw))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(raw), file, dtype=np.int32)), pa.array(cuts[:-1] + start), pa.array(lengths), ids], ["doc_id", "file", "local_start", "n_tokens", "ids"])
                start += int(cuts[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / partitions for i in range(1, partitions)], 0.1 / partitions))) if partitions > 1 else []  # reads ids alone
    rows = rows.repartitionById(partitions, _range_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lean(encode), SCHEMA).write.mode("overwrite").options(**OPTIONS).orc(target)


def read(spark: SparkSession, target: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids``, stripes and row groups without them are skipped by index and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(target)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def file_starts(spark: SparkSession, target: str) -> DataFrame:
    """Ids in the files before each file; one row a file, from the column of lengths alone."""
    sums = read(spark, target).groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()
    starts = offsets_of(np.array([r["n"] for r in sums], dtype=np.int64))
    return spark.createDataFrame([(r["file"], int(s)) for r, s in zip(sums, starts, strict=False)], "file int, file_start long")


def digests(spark: SparkSession, target: str) -> DataFrame:
    """What the files hold for each document: doc_id, start, n_tokens and the checksum of its ids."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, cuts = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "local_start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "file", "local_start", "n_tokens", "ids_crc32"])

    rows = read(spark, target).mapInArrow(lean(sums), "doc_id long, file int, local_start long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(file_starts(spark, target))  # one row a file
    return rows.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    target = Scratch(spark, "orc-tokens").path("ids")
    write(read_table(spark, sf_dir, "documents"), target, public_tokenizers.path(TOKENIZER))
    free_shuffles(spark)
    return digests(spark, target)
