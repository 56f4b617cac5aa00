"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), h' being the context without
its oldest word, and P(w) the smoothed share of w among all training tokens. As an automaton, every context seen in training is a
state with an arc for each word seen after it and a failure arc of weight m / (c(h) + m) to the state of h'; the root has an arc
for every word. With the production order of three a chain of failures leads from a pair of words to the last word and on to the
root. One pass over a text from left to right carries the state and adds up log-probabilities.

The counts follow the corpus, so no task and no driver holds them all. Texts are written once, as hashed words in blocks. Each
block sends the sorted distinct hashes of its n-grams of every length, with their training counts, to buckets by hash; a bucket adds
up what the blocks sent and answers each block with the totals of the keys it asked for. From the answers a block builds the part of
the automaton that its own texts can reach, and walks through them. There are as many buckets as the bytes of all texts ask for, so
that none grows with the corpus. An n-gram that fills a third of the corpus is one entry per block. Messages are packed arrays.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text when the held-out part is
drawn; repeated rows count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import lean
from .common import Scratch, offsets_of, read_table, texts_of, tune
from .shingles import PLACE, lowered, mix, word_hashes

#: Bytes of text in a block, and for each bucket of counts.
BLOCK, BUCKET = 4 << 20, 12 << 20
#: Pseudo-counts of the next lower model in contexts of one word, of two words and so on; one more than these is the order.
STRENGTHS = (200.0, 20.0)
FOLDS, HELD_OUT = 5, 1
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
START = np.uint64(xxhash.xxh3_64_intdigest(b"\x00start"))


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class BackoffAutomaton:
    """The arcs that some texts read, resolved for each token of them.

    A state is a context of up to ``order`` - 1 words that training has seen; its level is their number, and level 0 is the root.
    ``arcs[k]`` tells for each token whether the state of the k words before it has an arc for the token, ``weights[k]`` has that
    arc's weight and ``fails[k]`` the weight of that state's failure arc to the state of k - 1 words. Weights are log10
    probabilities. The root has an arc for every token, and ``known`` tells whether training has seen the token itself.
    """

    def __init__(self, arcs: list[np.ndarray], weights: list[np.ndarray], fails: list[np.ndarray], known: np.ndarray):
        self.arcs, self.weights, self.fails, self.known = arcs, weights, fails, known
        self.top = len(arcs) - 1

    def walk(self, begin: int, end: int) -> float:
        """Log10 probability of the tokens from ``begin`` to ``end``, read from left to right from the state of a text's start."""
        arcs, weights, fails = ([x[begin:end].tolist() for x in table] for table in (self.arcs, self.weights, self.fails))
        known, top, total = self.known[begin:end].tolist(), self.top, 0.0
        level = top
        for at in range(end - begin):
            while level and not arcs[level][at]:
                total += fails[level][at]
                level -= 1
            total += weights[level][at]
            level = min(level + 1, top) if known[at] else 0
        return total


class Block:
    """Some documents as sequences of word hashes, each with the end token, and the hashes of their n-grams."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, order: int):
        self.tokens, self.lengths, self.order = tokens, lengths, order
        self.starts = offsets_of(lengths)[:-1]

    @classmethod
    def of(cls, texts: list[bytes], order: int = 1) -> Block:
        end = np.array([END])
        hashed = [word_hashes(lowered(text)) for text in texts]  # words of one text at a time
        return cls(np.concatenate([x for h in hashed for x in (h, end)]), np.array([len(h) + 1 for h in hashed], dtype=np.int64), order)

    def pack(self) -> bytes:
        """Distinct words with their counts, and each token's rank by count as byte planes, compressed."""
        words, at, counts = np.unique(self.tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(words), dtype="<u4")
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        head = pack_keys(words, counts)
        planes = rank[at].view(np.uint8).reshape(-1, 4).T.tobytes()
        return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=1).compress(planes)

    @classmethod
    def unpack(cls, data: bytes, lengths: list[int], order: int) -> Block:
        size = int.from_bytes(data[:8], "little")
        words, counts = unpack_keys(data[8 : 8 + size])
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + size :]), dtype=np.uint8).reshape(4, -1)
        ranks = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
        return cls(words[np.argsort(-counts.astype(np.int64), kind="stable")][ranks], np.array(lengths, dtype=np.int64), order)

    def keys(self, first: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of n-grams from ``first`` on the sorted distinct keys and, for each token, the place of the n-gram that it ends."""
        before, folded = self.tokens, self.tokens * PLACE[0]
        for length in range(1, self.order + 1):
            if length > 1:
                before = np.roll(before, 1)
                before[self.starts] = START
                folded = folded + before * PLACE[length - 1]
            if length >= first:
                keys, at = np.unique(mix(folded + np.uint64(length)), return_inverse=True)
                yield keys, at.astype(np.int32)


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte planes together, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(12, -1)
    steps = np.ascontiguousarray(planes[:8].T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u4").reshape(-1)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


def _bundling(size: int):
    """Neighbouring documents in blocks of about ``size`` bytes, the hashed words of each as one compressed row, numbered by task."""

    def row(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        block = Block.of(texts)
        training = sum(not held_out(i) for i in ids)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([training], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([block.lengths], pa.list_(pa.int64())), pa.array([block.pack()], pa.binary())], ["block", "bytes", "training", "ids", "lengths", "tokens"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 16
                if held >= size:
                    yield row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row(number, ids, texts)

    return bundle


def _asking(buckets: int, first: int, last: int):
    """Messages of each block: its keys of lengths ``first`` to ``last`` and their training counts, split by the top bits of the keys."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
        for batch in batches:
            for number, ids, lengths, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "lengths", "tokens")), strict=True):
                block = Block.unpack(packed, lengths, last)
                training = np.repeat([not held_out(i) for i in ids], block.lengths)
                for length, (keys, at) in enumerate(block.keys(first), first):
                    counts = np.bincount(at[training], minlength=len(keys))
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                    payload = [pack_keys(keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]) for b in full]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(full), pa.int64()), pa.array([length] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(payload, pa.binary())], ["block", "length", "bucket", "payload"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Totals of the keys of one length in one bucket: an answer to each block, and a row with the numbers of tokens and of known keys."""
    length, bucket = table.column("length")[0].as_py(), table.column("bucket")[0].as_py()
    asked = [unpack_keys(p) for p in table.column("payload").to_pylist()]
    keys, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    totals = np.bincount(at, weights=np.concatenate([c for _, c in asked]), minlength=len(keys)).astype(np.int64)
    cuts = offsets_of(np.array([len(k) for k, _ in asked]))
    answers = [pack_counts(totals[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(asked)
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
        "length": pa.array([length] * (n + 1), pa.int32()),
        "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "payload": pa.array([*answers, b""], pa.binary()),
        "tokens": pa.array([0] * n + [int(totals.sum())], pa.int64()),
        "known": pa.array([0] * n + [int((totals > 0).sum())], pa.int64()),
    })


def build_automaton(counts: list[np.ndarray], places: list[np.ndarray], starts: np.ndarray, n: int, v: int, documents: int, strengths: tuple[float, ...]) -> BackoffAutomaton:
    """The part of the automaton that a block's texts reach.

    ``counts[k]`` are training counts of its distinct n-grams of k + 1 words, ``places[k]`` tells which of them each token ends, and
    ``starts`` where texts begin; the contexts there are start marks alone, which ``documents`` training texts have.
    """
    share = (counts[0] + 0.5) / (n + 0.5 * (v + 1))  # by n-gram, for one length after the other
    arcs, weights, fails = [np.ones(len(places[0]), dtype=bool)], [np.log10(share)[places[0]]], [np.zeros(len(places[0]))]
    for k, strength in enumerate(strengths, 1):
        some = np.empty(len(counts[k]), dtype=np.int64)
        some[places[k]] = np.arange(len(places[k]))  # a token that ends each n-gram
        context = np.empty(len(places[k]), dtype=np.float64)
        context[1:] = counts[k - 1][places[k - 1]][:-1]
        context[starts] = documents
        share = (counts[k] + strength * share[places[k - 1][some]]) / (context[some] + strength)
        arcs.append((counts[k] > 0)[places[k]])
        weights.append(np.log10(share)[places[k]])
        fails.append(np.log10(strength / (context + strength)))
    return BackoffAutomaton(arcs, weights, fails, counts[0][places[0]] > 0)


def _scoring(n: int, v: int, documents: int, strengths: tuple[float, ...]):
    """Walk the automaton of a block through its texts."""

    def score(answers: pa.Table, bundle: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for ids, lengths, packed in zip(*(bundle.column(c).to_pylist() for c in ("ids", "lengths", "tokens")), strict=True):
            block = Block.unpack(packed, lengths, len(strengths) + 1)
            counts, places = [], []
            for length, (keys, at) in enumerate(block.keys(), 1):
                rows = answers.filter(pa.compute.equal(answers.column("length"), length)).sort_by("bucket")
                counts.append(np.concatenate([unpack_counts(p) for p in rows.column("payload").to_pylist()]))
                places.append(at)
                if len(keys) != len(counts[-1]):
                    raise RuntimeError("the answers do not belong to this block")
            automaton = build_automaton(counts, places, block.starts, n, v, documents, strengths)
            ends = block.starts + block.lengths
            out["doc_id"] += ids
            out["held_out"] += [held_out(i) for i in ids]
            out["n_tokens"] += block.lengths.tolist()
            out["n_known"] += np.add.reduceat(automaton.known.astype(np.int64), block.starts).tolist()
            out["base_score"] += np.add.reduceat(automaton.weights[0], block.starts).tolist()
            out["score"] += [automaton.walk(a, b) for a, b in zip(block.starts.tolist(), ends.tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "held_out": pa.array(out["held_out"], pa.bool_()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "train_tokens": pa.array([n] * len(out["doc_id"]), pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    return score


def score_documents(docs: DataFrame, scratch: Scratch, strengths: tuple[float, ...] = STRENGTHS, block: int = BLOCK, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every document by n-grams of up to ``len(strengths) + 1`` words: the columns of the contract of ``op8``."""
    order = len(strengths) + 1
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bundles = scratch.table(docs.mapInArrow(lean(_bundling(block)), "block long, bytes long, training long, ids array<long>, lengths array<long>, tokens binary"), "blocks")
    totals = bundles.agg(F.count("*"), F.sum("bytes"), F.sum("training"), F.max(F.shiftright("block", 32)) + 1, F.max(F.col("block").bitwiseAND(0xFFFFFFFF)) + 1)
    blocks, size, documents, tasks, most = (int(x or 0) for x in totals.first())
    buckets, tables = max(1, math.ceil(size / bucket)), []
    for first, last in [(1, min(2, order)), *((length, length) for length in range(3, order + 1))]:  # no more on the disks at once
        asked = bundles.select("block", "ids", "lengths", "tokens").mapInArrow(lean(_asking(buckets, first, last)), "block long, length int, bucket int, payload binary")
        asked = asked.repartitionById(buckets, F.col("bucket"))
        found = asked.groupBy("length", "bucket").applyInArrow(_answer, "block long, length int, bucket int, payload binary, tokens long, known long")
        tables.append(scratch.table(found, f"answers-{first}"))
    n, v = (int(x or 0) for x in tables[0].filter("block < 0 and length = 1").agg(F.sum("tokens"), F.sum("known")).first())
    answers = reduce(DataFrame.unionByName, tables).filter("block >= 0").select("block", "length", "bucket", "payload")
    places = max(1, min(math.ceil(tasks * most / 2), 2 * blocks))  # two blocks a task, each pair in a place of its own where tasks had alike many
    number = F.shiftright("block", 32) * most + F.col("block").bitwiseAND(0xFFFFFFFF)
    place = F.pmod(F.shiftright(number, 1), F.lit(places)).cast("int")
    sides = answers, bundles.select("block", "ids", "lengths", "tokens")
    answers, bundles = (side.withColumn("place", place).repartitionById(places, F.col("place")).groupBy("place", "block") for side in sides)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.cogroup(bundles).applyInArrow(_scoring(n, v, documents, strengths), schema)


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return score_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "ngram-lm"))
