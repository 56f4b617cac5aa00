"""Near-duplicate embeddings by spherical-cap filters from random product codes.

A turned vector is cut into parts, and each part has a codebook of random directions; a filter is one direction of every part, and
passes the vectors whose products with its directions add up to a threshold. A vector's filters are listed by going through the
parts' directions from the best on, leaving off as soon as the best of the remaining parts can't reach the threshold. Vectors
that share a filter are compared in double precision. So that a pair counts once, only the smallest filter that both pass does so.

Threshold and codebooks follow from the number of vectors and their dimension by the law of a random unit vector's product with a
fixed direction: about ``CROWD`` unrelated vectors pass a filter, and a pair at the least similarity shares ``SHARED`` filters on
average. Where caps that small would hold too few such pairs, as in low dimensions, a filter is wider, so that a vector passes
``PASSES`` filters at most; and where that saves nothing, all vectors pass one filter. Filters belong to several independent codes,
as a single one treats some directions worse than others. Equal vectors form a class of which one goes
on with its multiplicity. A crowded filter is compared in blocks of bounded size, and what leaves a block are sums of links for
each vector and a spanning forest of the links, never all pairs.

Defined results: vectors that are null, empty or zero or hold null or non-finite components are linked with nothing; vectors of
different dimensions are not compared; rows with equal ids and equal vectors are one vector, with different vectors several; each row
without an id is a vector of its own, linked and counted like others; component_id is null where no vector of the component has an
id, and such rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import lean
from .common import Scratch, components, read_table, tune

SIMILARITY = 0.9
CROWD, SHARED = 64.0, 36.0
#: Independent codes; a vector that few filters of one code pass has others.
CODES = 12
#: Directions in the codebook of a part, at most.
MOST_DIRECTIONS = 1 << 16
#: Filters that a vector passes at most, on average.
PASSES = 256.0
#: Neighbouring filters that share the rows of one family, at most.
FAMILY = 128
#: Vectors compared with each other in one block.
BLOCK = 2048


@lru_cache(maxsize=64)
def _angles(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the probability that a random direction is within each of a fixed one."""
    angle = np.linspace(0, math.pi, 200_001)
    density = np.sin(angle) ** (dimension - 2)
    below = np.concatenate([[0.0], np.cumsum(density[1:] + density[:-1])])
    return angle, below / below[-1]


def _both(x: float, correlation: float, dimension: int) -> float:
    """Probability that a random direction's products with two unit vectors of this product both exceed x."""
    angle = np.linspace(0, math.acos(x), 4001)
    density = np.sin(angle) ** (dimension - 2) * math.exp(math.lgamma(dimension / 2) - math.lgamma((dimension - 1) / 2)) / math.sqrt(math.pi)
    rest = math.sqrt(1 - correlation**2) * np.sin(angle)  # what the plane's other axis can add
    need = np.divide(x - correlation * np.cos(angle), rest, out=np.full(len(angle), -1.0), where=rest > 0)
    above = np.interp(np.arccos(np.clip(need, -1, 1)), *_angles(dimension - 1))
    return float(np.trapezoid(density * above, angle))


@lru_cache(maxsize=1024)
def plan(vectors: int, similarity: float = SIMILARITY, dimension: int = 64) -> tuple[float, int, int, int]:
    """Threshold in standard deviations, number of parts, directions of each part of one code, number of codes."""
    everything = (-math.inf, 1, 1, 1)
    if dimension < 3:
        return everything

    def law(share: float) -> tuple[float, float]:
        angle, below = _angles(dimension)
        least = math.cos(np.interp(share, below, angle))
        return least, _both(least, similarity, dimension)

    share = min(0.1, CROWD / max(1, vectors))
    least, both = law(share)
    if SHARED * share > PASSES * both:
        low, high = math.log(share), math.log(0.5)
        for _ in range(40):
            middle = (low + high) / 2
            share = math.exp(middle)
            low, high = (low, middle) if SHARED * share <= PASSES * law(share)[1] else (middle, high)
        share = math.exp(high)
        least, both = law(share)
        if SHARED * share * share >= both:
            return everything
    filters, codes, parts = SHARED / CODES / both, CODES, 2
    while filters ** (1 / parts) > MOST_DIRECTIONS:  # filters of more parts are less independent of each other, so more codes
        filters, codes, parts = filters / 2, codes * 2, parts + 1
    return least * math.sqrt(dimension), parts, math.ceil(filters ** (1 / parts)), codes


class ProductCode:
    """Filters for unit vectors of one dimension."""

    def __init__(self, dimension: int, threshold: float, parts: int, directions: int, number: int = 0):
        rng = np.random.default_rng([dimension, directions, number])
        parts = min(parts, dimension)
        self.first = number * directions**parts
        self.turn = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.ends = [dimension * (p + 1) // parts for p in range(parts)]
        self.books = []
        for start, end in zip([0, *self.ends[:-1]], self.ends, strict=True):
            book = rng.normal(size=(directions, end - start))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(end - start))
        self.least = threshold  # the sum of the parts' products has standard deviation 1
        self.directions = directions

    def filters(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters that it passes."""
        turned = vectors @ self.turn
        scores = [turned[:, s:e] @ book.T for s, e, book in zip([0, *self.ends[:-1]], self.ends, self.books, strict=True)]
        best = [s.max(axis=1) for s in scores]
        rest = np.cumsum([np.zeros(len(vectors)), *best[:0:-1]], axis=0)[::-1]  # what the parts after each can add at most
        out = []
        for i in range(len(vectors)):
            numbers, sums = np.zeros(1, dtype=np.int64), np.zeros(1)
            for part, score in enumerate(scores):
                total = sums[:, None] + score[i][None, :]
                at, direction = np.nonzero(total >= self.least - rest[part][i])
                numbers, sums = numbers[at] * self.directions + direction, total[at, direction]
            out.append(np.sort(numbers) + self.first)
        return out


@lru_cache(maxsize=16)
def codes(dimension: int, threshold: float, parts: int, directions: int, many: int) -> list[ProductCode]:
    return [ProductCode(dimension, threshold, parts, directions, number) for number in range(many)]


def all_filters(units: np.ndarray, threshold: float, parts: int, directions: int, many: int = CODES) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all filters of all codes that it passes."""
    listed = [c.filters(units) for c in codes(units.shape[1], threshold, parts, directions, many)]
    return [np.concatenate(x) for x in zip(*listed, strict=True)]


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it has no direction."""
    if not vector or None in vector:
        return None
    x = np.array(vector, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, raw = [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = unit(vector)
            raw.append(None if x is None else np.array(vector, dtype=np.float64).tobytes())
            keys.append(f"none {vec_id}".encode() if x is None else xxhash.xxh3_128_digest(raw[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "raw"])


def _packed(vector: np.ndarray) -> bytes:
    """In single precision where that loses nothing."""
    single = vector.astype(np.float32)
    return b"4" + single.tobytes() if (single == vector).all() else b"8" + vector.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype=np.float32 if data[:1] == b"4" else np.float64).astype(np.float64)


def _passing(plans: dict[int, tuple[float, int, int, int]], wide: bool):
    """Rows for the families of neighbouring filters that a class passes.

    A row has the vector and the vector's filters up to that family, from the smallest on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(r) for r in batch.column("raw").to_pylist()]
            for size in sorted({len(v) for v in vectors}):
                rows = [i for i, v in enumerate(vectors) if len(v) == size]
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    found = all_filters(np.array([unit(vectors[i].tolist()) for i in some]), *plans[size])
                    owner, family, packed, filters = [], [], [], []
                    for i, numbers in zip(some, found, strict=True):
                        families, ends = np.unique(numbers // min(plans[size][2], FAMILY), return_index=True)
                        ends = [*ends[1:].tolist(), len(numbers)]
                        owner += [i] * len(families)
                        family += families.tolist()
                        packed += [_packed(vectors[i])] * len(families)
                        filters += [numbers[:end] for end in ends]
                    taken = batch.take(pa.array(owner, pa.int64()))
                    yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("many"), pa.array(packed, pa.binary()), pa.array([size] * len(owner), pa.int32()), pa.array(family, pa.int64()), pa.array(filters, pa.list_(pa.int64() if wide else pa.int32()))], ["vec_id", "many", "vector", "dimension", "family", "filters"])

    return run


def _linked(similarity: float, plans: dict[int, tuple[float, int, int, int]]):
    """Links of one block of a family: rows (vec_id, null, number of linked vectors) and forest edges (u, v, 0)."""

    def links(table: pa.Table) -> pa.Table:
        ids, many = table.column("vec_id").to_numpy(), table.column("many").to_numpy()
        width = min(plans[table.column("dimension")[0].as_py()][2], FAMILY)
        blocks, low, first = table.column("block").to_numpy(), table.column("low")[0].as_py(), table.column("family")[0].as_py() * width
        same = low == table.column("high")[0].as_py()
        left = blocks == low
        vectors = np.array([unit(_unpacked(r).tolist()) for r in table.column("vector").to_pylist()])
        lists = table.column("filters").combine_chunks()
        value, owner = lists.values.to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        here = value >= first
        number, member = value[here], owner[here]
        order = np.argsort(number, kind="stable")
        member, cuts = member[order], np.flatnonzero(np.diff(number[order], prepend=-1, append=-1))
        pairs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            crowd = member[a:b]
            rows, columns = (crowd, crowd) if same else (crowd[left[crowd]], crowd[~left[crowd]])
            for at in range(0, len(rows), 512):
                i, j = np.nonzero(vectors[rows[at : at + 512]] @ vectors[columns].T >= similarity)
                i, j = rows[at + i], columns[j]
                if same:
                    i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
                pairs.append(i.astype(np.int64) * len(ids) + j)
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        i, j = np.divmod(pairs, max(1, len(ids)))
        if len(i):  # pairs that meet in an earlier family count there
            used = np.unique(np.concatenate([i, j]))
            early = (value < first) & np.isin(owner, used)
            number, member = value[early], np.searchsorted(used, owner[early])
            found, back, times = np.unique(number, return_inverse=True, return_counts=True)
            shared = times[back] > 1
            if shared.any():
                found, back = np.unique(number[shared], return_inverse=True)
                passes = np.zeros((len(used), len(found)), dtype=np.float32)
                passes[member[shared], back] = 1
                earlier = passes @ passes.T > 0
                fresh = ~earlier[np.searchsorted(used, i), np.searchsorted(used, j)]
                i, j = i[fresh], j[fresh]
        counts = np.bincount(i, weights=many[j], minlength=len(ids)) + np.bincount(j, weights=many[i], minlength=len(ids))
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        forest = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[b] = a
                forest.append((a, b))
        with_links = np.flatnonzero(counts)
        u, v = (ids[[e[k] for e in forest]] if forest else np.empty(0, dtype=np.int64) for k in (0, 1))
        return pa.table({
            "u": pa.array(np.concatenate([ids[with_links], u]), pa.int64()),
            "v": pa.concat_arrays([pa.nulls(len(with_links), pa.int64()), pa.array(v, pa.int64())]),
            "n": pa.array(np.concatenate([counts[with_links].astype(np.int64), np.zeros(len(forest), dtype=np.int64)]), pa.int64()),
        })

    return links


def near_duplicates(vectors: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    keyed = scratch.table(vectors.mapInArrow(lean(_keys), "vec_id long, key binary, raw binary"), "keyed")
    once = keyed.groupBy("key", "vec_id").agg(F.count("*").alias("rows"))
    odd = scratch.table(once.groupBy("vec_id").agg(F.count("*").alias("several")).filter("vec_id is null or several > 1").select("vec_id"), "odd")
    any_odd = not odd.isEmpty()
    classes = once.groupBy("key").agg(F.min("vec_id").alias("rep"), F.sum(F.when(F.col("vec_id").isNull(), F.col("rows")).otherwise(1)).alias("many"))
    number = F.col("rep")
    if any_odd:  # the smallest id is none or that of several classes: the vector tells the class
        classes = classes.join(odd.select(F.col("vec_id").alias("rep"), F.lit(True).alias("odd")), "rep", "left")
        number = F.when(F.col("rep").isNull() | F.col("odd"), F.xxhash64("key")).otherwise(F.col("rep"))
    classes = scratch.table(classes.select("key", "rep", "many", number.alias("number")), "classes")
    reps = keyed.filter("raw is not null").groupBy("key").agg(F.first("raw").alias("raw")).join(classes, "key")
    reps = scratch.table(reps.select(F.col("number").alias("vec_id"), "many", "raw"), "reps")
    sizes = reps.groupBy((F.octet_length("raw") / 8).cast("int").alias("dimension")).agg(F.count("*").alias("size")).collect()
    plans = {r["dimension"]: plan(1 << math.ceil(math.log2(max(2, r["size"]))), similarity, r["dimension"]) for r in sizes}
    wide = any(many * directions**parts >= 1 << 31 for _, parts, directions, many in plans.values())

    passing = reps.mapInArrow(lean(_passing(plans, wide)), f"vec_id long, many long, vector binary, dimension int, family long, filters array<{'bigint' if wide else 'int'}>")
    passing = scratch.table(passing, "passing")
    crowds = passing.groupBy("dimension", "family").agg(F.count("*").alias("size")).filter("size > 1")
    crowds = crowds.select("dimension", "family", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = passing.join(crowds, ["dimension", "family"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("dimension", "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "many", "vector", "filters")
    links = rows.groupBy("dimension", "family", "low", "high").applyInArrow(_linked(similarity, plans), "u long, v long, n long")
    links = scratch.table(links, "links")
    scratch.drop("passing", "reps")

    counts = links.filter("v is null").groupBy(F.col("u").alias("number")).agg(F.sum("n").alias("links"))
    found = components(links.filter("v is not null").select("u", "v"), scratch, "component").withColumnRenamed("node", "number")
    if any_odd:
        found = found.join(found.join(classes, "number").groupBy("component").agg(F.min("rep").alias("first")), "component")
    else:
        found = found.withColumn("first", F.col("component"))
    result = keyed.select("vec_id", "key", F.col("raw").isNotNull().alias("valid")).join(classes, "key")
    result = result.join(counts, "number", "left").join(found.select("number", "first"), "number", "left")
    component = F.when(F.col("valid"), F.coalesce("first", "rep")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("valid"), F.coalesce("links", F.lit(0)) + F.col("many") - 1).otherwise(0)
    return result.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


#: The same in SQL, by all pairs.
ORACLE = f"""WITH RECURSIVE x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
  y AS (SELECT vec_id, len(e) AS d, list_transform(e, lambda z: z / sqrt(list_dot_product(e, e))) AS u FROM x WHERE list_dot_product(e, e) > 0),
  l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM y a JOIN y b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= {SIMILARITY}),
  r(vec_id, other) AS (SELECT u, v FROM l UNION SELECT r.vec_id, l.v FROM r JOIN l ON l.u = r.other),
  m AS (SELECT vec_id, min(other) AS low FROM r GROUP BY vec_id), n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), Scratch(spark, "cap-filters"))
