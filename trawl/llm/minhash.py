"""Near-duplicate documents by MinHash bands, odd sketches and a check on the full shingle sets.

Each document's distinct five-word shingles give 256 MinHash samples. Half of them are hashed in 32 bands of 4, and all are
folded into an odd sketch: each sample flips one of 2,048 bits, so that the exclusive or of two sketches counts the samples that
differ, most precisely where few do. Documents with equal sets form a class, of which one goes on. Classes that share a band are candidates;
those whose sketches differ by more than similar sets' ever would are dropped, and the rest are compared on their full sets.

What a bucket of a band needs is not all its pairs but its connected components. First every member is compared with the
bucket's smallest member, unless their sizes rule it out. Only where that leaves members of one bucket in different components go on those whose sketches are
close across components: chains of them make families, and a family's members are compared on their full sets in blocks of
bounded size. What leaves a block are stars with the same components as the links, never all pairs. A pair with similarity 0.75 misses all bands with probability 5e-6.

Defined results: a text without words is linked with nothing; rows with equal ids are one document, linked by any of their texts; a
row without an id takes part like others, gets the component of its text and is kept if no row with an id is in it; component_id
is null where no row of the component has an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .chunks import lean
from .common import BROADCAST_KEYS, Scratch, components, read_table, texts_of, tune
from .shingles import LOWERED_SQL, WIDTH, mix, shingle_set

SIMILARITY = 75  # percent
BANDS, ROWS = 32, 4
SAMPLES = 2 * BANDS * ROWS
BITS = 2048
#: Members of a bucket or family in one block at least and at most, blocks in between, and bytes of a family's texts in a block.
LEAST_BLOCK, BLOCK, BLOCKS, BLOCK_BYTES = 256, 2048, 8, 4 << 20
#: Rows with bands and sketch, or that join two sketches, in one file.
SKETCH_ROWS = 16_000
#: Tasks to which a shuffle deals the rows of a key where its other side has too many keys for a broadcast.
DEALT = 64

_rng = np.random.default_rng(7)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY, ADD, PLACE, FOLD = _odd(SAMPLES), _odd(SAMPLES), _odd(SAMPLES), _odd(SAMPLES)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        hashed = MULTIPLY[:, None] * shingles[None, at : at + 2048] + ADD[:, None]
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    folded = (sampled[: BANDS * ROWS] * PLACE[: BANDS * ROWS]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mix(folded + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(sampled: np.ndarray) -> np.ndarray:
    flips = (mix(sampled * FOLD) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(flips, minlength=BITS) & 1).view(np.int64)


def sketch_cutoff(similarity: float = SIMILARITY / 100, deviations: float = 4.5) -> int:
    """Differing bits that the sketches of sets of this similarity exceed with a probability of about 3e-6."""
    flips = 2 * SAMPLES * (1 - similarity)
    left = math.exp(-2 * flips / BITS)  # flips that no other flip undoes
    spread = math.hypot(2 * math.sqrt(SAMPLES * similarity * (1 - similarity)) * left, 2 * math.sqrt(flips * flips / (2 * BITS)))
    return math.ceil(BITS / 2 * (1 - left) + deviations * spread)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and len(b) > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, keys, banded, sketched = batch.column("doc_id").to_pylist(), [], [], [], []
        for doc_id, text in zip(ids, texts_of(batch.column("text")), strict=True):
            shingles = shingle_set(text)
            sizes.append(len(shingles))
            if len(shingles):
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sampled = samples(shingles)
                banded.append(bands(sampled))
                sketched.append(odd_sketch(sampled))
            else:
                keys.append(set_key(None, doc_id))
                banded.append(np.empty(0, dtype=np.int64))
                sketched.append(np.empty(0, dtype=np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(sketched, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "bands", "sketch"],
            )


class _Forest:
    """Union of things that are linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Link two things; false if they were linked already."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def stars(self) -> list[tuple[int, int]]:
        """Each thing that is linked to a smaller one, with the smallest that it is linked to."""
        return [(root, x) for x in list(self.parent) if (root := self.root(x)) != x]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that link what the task's pairs with similar full sets link; the left texts come in runs."""
    last, left, joined = None, np.empty(0, dtype=np.uint64), _Forest()
    for batch in batches:
        for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v")), strict=True):
            if joined.root(u) != joined.root(v):
                if u != last:
                    last, left = u, shingle_set(a)
                if similar(left, shingle_set(b)):
                    joined.join(u, v)
    yield from _edge_table(joined.stars()).to_batches()


def _close_pairs(table: pa.Table, cutoff: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places in a block: one, and those in other components with a similar size and a close sketch."""
    ids, parts, sizes = (table.column(c).to_numpy() for c in ("doc_id", "component", "n"))
    blocks, first = table.column("block").to_numpy(), table.column("low")[0].as_py()
    same = first == table.column("high")[0].as_py()
    sketches = np.array(table.column("sketch").to_pylist(), dtype=np.int64).view(np.uint64)
    for i in np.flatnonzero(blocks == first):
        others = np.flatnonzero((ids > ids[i]) if same else (blocks != first))
        others = others[(parts[others] != parts[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= SIMILARITY * np.maximum(sizes[others], sizes[i]))]
        close = others[np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1) <= cutoff]
        if len(close):
            yield int(i), close


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    u, v = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _across(cutoff: int):
    """Stars that link what close sketches across components link in one block of a bucket."""

    def forest(table: pa.Table) -> pa.Table:
        ids, joined = table.column("doc_id").to_pylist(), _Forest()
        for i, close in _close_pairs(table, cutoff):
            for j in close.tolist():
                joined.join(ids[i], ids[j])
        return _edge_table(joined.stars())

    return forest


def _within(cutoff: int):
    """Stars of the components that full sets link in one block of a family."""

    def links(table: pa.Table) -> pa.Table:
        parts, texts, joined, sets = table.column("component").to_pylist(), table.column("text"), _Forest(), {}

        def full(place: int) -> np.ndarray:
            if place not in sets:
                sets[place] = shingle_set((texts[place].as_py() or "").encode())
            return sets[place]

        for i, close in _close_pairs(table, cutoff):
            for j in close.tolist():
                if joined.root(parts[i]) != joined.root(parts[j]) and similar(full(i), full(j)):
                    joined.join(parts[i], parts[j])
        return _edge_table(joined.stars())

    return links


def _with(rows: DataFrame, small: DataFrame, key: str, scratch: Scratch, name: str, files: int) -> DataFrame:
    """Rows joined with a table of one row a key: broadcast if it is small enough, else dealt so that no key is one task."""
    small = scratch.table(small, name, files)
    if small.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(small), key)
    repeated = small.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return rows.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).cast("int")).join(repeated, [key, "_deal"]).drop("_deal")


def _blocks(size: Column) -> Column:
    """Number of blocks for so many members: enough to share the work, few enough that a member isn't copied too often."""
    return F.ceil(size / F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), size / BLOCKS))).cast("int")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt into their key's ``blocks``, and every pair of blocks as a group (key, low, high)."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def _texts_of(ids: DataFrame, texts: DataFrame, scratch: Scratch, name: str, files: int) -> DataFrame:
    """Texts of the classes in ``ids(doc_id)``, by a broadcast of the ids where they are few enough."""
    ids = scratch.table(ids.distinct(), f"{name}-ids", files)
    found = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "doc_id", "left_semi")
    return scratch.table(found, f"{name}-texts")


def _confirm(pairs: DataFrame, number: int, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Enough of the written ``number`` of ``pairs(u, v)`` with similar texts to link all that such pairs link."""
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id")))
    texts = _texts_of(ids, texts, scratch, name, scratch.files(2 * number))
    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    both = both.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    found = both.select("u", "v", F.encode("text_u", "UTF-8").alias("text_u"), F.encode("text_v", "UTF-8").alias("text_v")).mapInArrow(lean(_verified), "u long, v long")
    found = scratch.table(found.repartition(scratch.files(number)), f"{name}-found")
    scratch.drop(f"{name}-ids", f"{name}-texts")
    return found


def set_key(text: bytes | None, doc_id: object) -> bytes:
    """The same for texts with equal sets of shingles; a text without words has one for its id."""
    shingles = shingle_set(text or b"")
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b"no words " + str(doc_id).encode()


def with_set_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "set_key") -> DataFrame:
    """The rows with `set_key` as one more column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(t, i) for t, i in zip(texts_of(batch.column(text_col)), batch.column(id_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _class_texts(docs: DataFrame, members: DataFrame, odd: DataFrame | None) -> DataFrame:
    """A text of each class, under the class's number: its document's, or if that has no id or several rows, one by the set."""
    if odd is None:
        return docs
    plain = docs.filter("doc_id is not null").join(odd, "doc_id", "left_anti")
    keyed = with_set_key(docs.filter("doc_id is null").unionByName(docs.join(odd, "doc_id", "left_semi")), name="key")
    found = keyed.groupBy("key").agg(F.min("text").alias("text")).join(members.filter("by_set").select("key", "doc_id"), "key")
    return plain.unionByName(found.select("doc_id", "text"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; set_key tells equal sets, component_no equal components."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = scratch.table(docs.mapInArrow(lean(_fingerprints), "doc_id long, n_shingles long, key binary, bands array<long>, sketch array<long>"), "prints")
    odd = prints.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("doc_id is null or rows > 1").select("doc_id")
    rows = prints.count()
    odd = scratch.table(odd, "odd", scratch.files(rows))  # documents without an id or in several rows; none in most tables
    odd = None if odd.isEmpty() else odd
    classes = prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    by_set = F.lit(False)
    if odd is not None:
        classes = classes.join(odd.select(F.col("doc_id").alias("rep"), F.lit(True).alias("odd")), "rep", "left")
        by_set = F.coalesce("odd", F.col("rep").isNull())
    number = F.when(by_set, F.xxhash64("key")).otherwise(F.col("rep"))
    members = scratch.table(classes.select(number.alias("doc_id"), "key", "rep", by_set.alias("by_set"), "n", "bands", "sketch"), "members", scratch.files(rows, SKETCH_ROWS))
    texts = _class_texts(docs, members, odd)

    buckets = members.select("doc_id", "n", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.min_by("n", "doc_id").alias("n_u"), F.count("*").alias("size")).filter("size > 1")
    crowded = scratch.table(buckets.join(hubs, "bucket"), "crowded", scratch.files(BANDS * rows))  # most documents share no bucket
    shared = crowded.count()
    star = crowded.filter((F.col("doc_id") != F.col("u")) & (100 * F.least("n", "n_u") >= SIMILARITY * F.greatest("n", "n_u")))
    star = star.select("u", F.col("doc_id").alias("v")).distinct()
    sketches = members.select("doc_id", "n", "sketch")
    cutoff = sketch_cutoff()
    star = star.join(sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sketch_v")), "v")
    star = star.join(sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("sketch_u")), "u")
    differing = sum((F.bit_count(F.col("sketch_u")[i].bitwiseXOR(F.col("sketch_v")[i])) for i in range(BITS // 64)), F.lit(0))
    star = scratch.table(star.filter(differing <= cutoff).select("u", "v"), "star", scratch.files(shared, SKETCH_ROWS))
    pairs = star.count()
    edges = _confirm(star, pairs, texts, scratch, "near")
    if odd is not None:  # the texts of one document
        held = prints.join(odd, "doc_id", "left_semi").select("doc_id", "key").distinct().join(members.select("key", F.col("doc_id").alias("v")), "key")
        edges = edges.unionByName(held.join(held.groupBy("doc_id").agg(F.min("v").alias("u")), "doc_id").select("u", "v"))
        pairs += rows  # at most
    found = components(edges, scratch, "component", rows=pairs)

    placed = crowded.filter("size > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = scratch.table(placed.select("bucket", "size", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed", scratch.files(shared))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    held = _with(placed, mixed, "bucket", scratch, "mixed", scratch.files(shared)).withColumn("blocks", _blocks(F.col("size"))).drop("size")
    held = _in_blocks(held).join(sketches, "doc_id")
    across = held.groupBy("bucket", "low", "high").applyInArrow(_across(cutoff), "u long, v long")
    across = scratch.table(across.repartition(scratch.files(shared)), "across")
    if chained := across.count():
        few = scratch.files(2 * chained)
        families = components(across, scratch, "families", rows=chained).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
        shown = _texts_of(families.select("doc_id"), texts, scratch, "family", few)
        placed = families.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        placed = placed.join(sketches, "doc_id").join(shown, "doc_id")
        blocks = F.greatest(_blocks(F.count("*")), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int")
        held = _in_blocks(_with(placed, placed.groupBy("family").agg(blocks.alias("blocks")), "family", scratch, "family-blocks", few))
        within = held.groupBy("family", "low", "high").applyInArrow(_within(cutoff), "u long, v long")
        within = scratch.table(within.repartition(few), "within")
        edges = edges.unionByName(within)
        found = components(edges, scratch, "component-2", rows=pairs + chained)
        scratch.drop("families", "family-ids", "family-texts", "family-blocks", "within", "component")
    scratch.drop("crowded", "placed", "mixed", "star", "near-found", "across")

    if odd is not None:
        named = found.join(members.select(F.col("doc_id").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
        found = found.join(named, "component")
    else:
        found = found.withColumn("first", F.col("component"))
    found = found.select(F.col("node").alias("number"), "component", "first")
    classes = members.select("key", "rep", F.col("doc_id").alias("number")).join(found, "number", "left")
    result = prints.select("doc_id", "n_shingles", "key").join(classes, "key")
    component = F.coalesce("first", "rep")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    result = result.coalesce(scratch.files(rows))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("key").alias("set_key"), F.coalesce("component", "number").alias("component_no"))


def survivors(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns that stay: one of each component.

    That is a row of the document with the smallest id; of several rows of that document, the first by text and other columns
    stays. Where no row has an id, the first by text stays. Rows without id and words all stay.
    """
    found = scratch.table(near_duplicates(docs, scratch, id_col, text_col), "found")
    files = scratch.files(found.count())
    dropped = scratch.table(found.filter("doc_id is not null and not kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped", files)
    few = dropped.count() <= BROADCAST_KEYS
    identity = F.col(id_col).cast("long") == F.col("_id")
    rows = docs.join(F.broadcast(dropped) if few else dropped, identity, "left_anti")
    odd = scratch.table(found.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("doc_id is null or rows > 1").select(F.col("doc_id").alias("_id")), "several", files)
    if odd.isEmpty():
        return rows
    order = [F.col(text_col), F.xxhash64(*docs.columns)]
    several = rows.join(odd, identity, "left_semi").withColumn("_row", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    unnamed = with_set_key(docs.filter(F.col(id_col).isNull()), id_col, text_col, "_key")
    decided = found.filter("doc_id is null").select(F.col("set_key").alias("_key"), F.col("n_shingles").alias("_n"), F.col("kept").alias("_kept"), F.col("component_no").alias("_no")).distinct()
    unnamed = unnamed.join(decided, "_key").filter("_kept")
    first = F.row_number().over(Window.partitionBy("_no").orderBy(*order))
    unnamed = unnamed.withColumn("_row", F.when(F.col("_n") == 0, 1).otherwise(first))
    plain = rows.filter(F.col(id_col).isNotNull()).join(odd, identity, "left_anti")
    return plain.unionByName(several.filter("_row = 1").select(*docs.columns)).unionByName(unnamed.filter("_row = 1").select(*docs.columns))


#: The same in SQL, by all pairs that share a shingle.
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, {LOWERED_SQL} AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < {WIDTH} THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - {WIDTH - 2}), lambda i: array_to_string(l[i:i + {WIDTH - 1}], ' ')) END) AS sh FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
  b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
  r(doc_id, other) AS (SELECT u, v FROM b UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.other),
  m AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "near-dedup"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
