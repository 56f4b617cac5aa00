"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing takes pieces from the longest to the shortest and puts each into the open sequence with the least room
that still takes it, else into a new one. What it does depends on the lengths alone, and there are at most ``capacity`` of
them. So the driver packs the histogram of lengths: open sequences with equal room form runs, a segment tree over the rooms
finds the tightest room that fits in logarithmic time, and a whole run of sequences is filled at once. The result is a list of
runs, of a size that the capacity bounds, never the number of documents; it is the same packing that one pass over all pieces
in order would give. The executors then number the pieces of each length without gaps and look their places up in the runs.

Defined results: a null or empty text is the end id alone; equal lengths are told apart by their numbers, so repeated rows each
get a place; null document ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encoder, in_slices, lean
from .common import Scratch, files_for, gapless_rank, read_table, tune

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's memo of frequent words: fewer than the token files take, as workers also hold what stages before learnt.
MEMO = 400_000


class RoomTree:
    """Segment tree over the rooms 0..capacity that tells which rooms have open sequences."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.held = [0] * (2 * self.base)

    def set(self, room: int, number: int) -> None:
        at = self.base + room
        change = number - self.held[at]
        while at:
            self.held[at] += change
            at //= 2

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that an open sequence has."""
        at = self.base + size
        if self.held[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.held[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.held[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``first``.. of one length go to sequences ``sequence``.., ``each`` to a sequence, from ``offset`` on."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of the best-fit decreasing packing of ``counts[length]`` pieces of each length."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, number of sequences)
    tree, runs, unused = RoomTree(capacity), [], 0

    def put(room: int, sequence: int, number: int) -> None:
        if room and number:
            open_at[room].append((sequence, number))
            tree.set(room, tree.held[tree.base + room] + number)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, sequence, number = capacity, unused, -(-left // (capacity // length))
                unused += number
            else:
                sequence, number = open_at[room].pop()
                tree.set(room, tree.held[tree.base + room] - number)
            each = room // length
            used = min(number, -(-left // each))
            take = min(left, used * each)
            runs.append(Run(length, done, take, sequence, each, capacity - room))
            full, over = divmod(take, each)
            put(room - each * length, sequence, full)
            if over:
                put(room - over * length, sequence + full, 1)
            put(room, sequence + used, number - used)
            done, left = done + take, left - take
    return runs


class Places:
    """Where the runs put the n-th piece of a length."""

    def __init__(self, runs: list[Run]):
        runs = sorted(runs, key=lambda r: (r.length, r.first))
        self.starts = np.array([(r.length << 48) + r.first for r in runs], dtype=np.int64)
        self.table = np.array([(r.length, r.first, r.sequence, r.each, r.offset) for r in runs], dtype=np.int64).reshape(-1, 5)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.starts, (lengths.astype(np.int64) << 48) + ranks, side="right") - 1
        length, first, sequence, each, offset = self.table[at].T
        inside = ranks - first
        return sequence + inside // each, offset + (inside % each) * length


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and the writing task in ``part``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, False, MEMO)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple[int, int, int, int, int]] = []
            for part in in_slices(texts):
                for i, raw in enumerate(tokens.encode(texts[part]), part.start):
                    raw = memoryview(raw + end)
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        some = raw[at : at + 4 * capacity]
                        rows.append((i, piece, at // 4, len(some) // 4, zlib.crc32(some)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return rows.withColumn("part", F.spark_partition_id())


def pack(written: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with ``length`` and ``part``."""
    histogram = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = pack_histogram(histogram, capacity)
    shared = written.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, see above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = gapless_rank(written, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", "part")
    ranked = ranked.coalesce(files_for(written.sparkSession, sum(histogram.values())))
    return ranked.select(*columns, "rank").mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, scratch: Scratch, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return pack(scratch.table(pieces(docs, path), "pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "packing"))
