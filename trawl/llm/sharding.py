"""Sharding by jump consistent hashing: a key's shard follows from the key and the number of shards alone.

There is no ring table. Going from n to n + 1 shards moves a key either nowhere or into the new shard, so that only the
necessary fraction moves.

Defined results: a null text counts as empty; a null id has the key of 0; ids of any integer type have the key of their value; rows
with equal ids share a shard and get different slots; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, gapless_rank, read_table, tune
from .shingles import LENGTH, mix

SHARDS = 40
#: Bytes counted for each document besides its text.
OVERHEAD = 16


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key by the published jump consistent hash (Lamping and Veach, 2014)."""
    if buckets < 1:
        raise ValueError("at least one bucket")
    state = keys.astype(np.uint64)
    found = np.zeros(len(state), dtype=np.int64)
    rest = np.arange(len(state))
    while len(rest):
        grown = state[rest] * np.uint64(2862933555777941757) + np.uint64(1)
        state[rest] = grown
        step = (found[rest] + 1) * (float(1 << 31) / ((grown >> np.uint64(33)).astype(np.float64) + 1.0))
        jump = step.astype(np.int64)
        rest, jump = rest[jump < buckets], jump[jump < buckets]
        found[rest] = jump
    return found.astype(np.int32)


def shard_keys(ids: pa.Array) -> np.ndarray:
    """Keys of 64 mixed bits: the finaliser of SplitMix64 on the id plus its constant."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(values + np.uint64(LENGTH))


def assign(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and next shard of every document: columns of the contract of ``op10``."""

    def jump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = shard_keys(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(jump_hash(keys, shards)), pa.array(jump_hash(keys, shards + 1)), batch.column("part")],
                ["doc_id", "size", "text_crc32", "shard", "grown_shard", "part"],
            )

    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
    )
    rows = rows.mapInArrow(jump, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int")
    rows = scratch.table(rows, "assigned")
    ranked = gapless_rank(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", "part")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same in SQL: checksums byte by byte, the key by arithmetic on 128 bits, the hash's jumps by recursion. Numbering by id is the
#: order of a table in one slice.
ORACLE = f"""WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) r(i))),
  h AS (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
  d AS (SELECT rid, doc_id, (len(b) + {OVERHEAD})::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
    ((CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616::UHUGEINT - (-doc_id)::UHUGEINT ELSE coalesce(doc_id, 0)::UHUGEINT END + {LENGTH}) % 18446744073709551616::UHUGEINT)::UBIGINT AS k0 FROM h, t),
  k1 AS (SELECT *, ((xor(k0, k0 >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS a FROM d),
  k2 AS (SELECT *, ((xor(a, a >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS c FROM k1),
  j(rid, k, pos) AS (SELECT rid, xor(c, c >> 31), 0::BIGINT FROM k2 UNION ALL
    SELECT rid, n, floor((pos + 1) * (2147483648.0::DOUBLE / ((n >> 33)::DOUBLE + 1.0)))::BIGINT FROM (SELECT rid, pos, ((k::UHUGEINT * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)::UBIGINT AS n FROM j)
    WHERE floor((pos + 1) * (2147483648.0::DOUBLE / ((n >> 33)::DOUBLE + 1.0))) < {SHARDS + 1}),
  s AS (SELECT rid, max(pos) FILTER (WHERE pos < {SHARDS})::INTEGER AS shard, max(pos)::INTEGER AS grown_shard FROM j GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM d JOIN s USING (rid)"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return assign(read_table(spark, sf_dir, "documents"), Scratch(spark, "sharding"))
