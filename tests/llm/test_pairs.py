"""Near-duplicate documents and vectors against all pairs."""

import math
from pathlib import Path

import numpy as np
import pytest

from tests.llm.plain import components, near_duplicates
from trawl.llm import cap_filters, common, minhash
from trawl.llm.common import components as spark_components


def test_documents(docs, scratch, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, scratch).collect()}
    assert found == near_duplicates(texts)


def test_odd_tables(odd, empty, scratch, texts):
    rows = minhash.near_duplicates(odd, scratch).collect()
    assert len(rows) == len(texts) + 1
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(5, False)]
    expected = near_duplicates(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None} == expected
    stay = minhash.survivors(odd, scratch)
    assert stay.columns == odd.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == [k for k, (_, _, keep) in sorted(expected.items()) if keep]
    assert minhash.near_duplicates(empty, scratch).count() == 0


def test_repeated_and_missing_ids(spark, scratch):
    """Rows with equal ids are one document; copies without an id are found as well; one row of each group stays."""
    words = [f"w{i}" for i in range(300)]
    a, b, c, d = (" ".join(words[i : i + 60]) for i in (0, 70, 140, 210))
    near = lambda text: text + " extra"
    rows = [(7, a), (7, a), (7, b), (3, near(b)), (9, c), (None, near(c)), (None, d), (None, near(d)), (None, d), (11, near(a)), (None, ""), (None, None), (12, ""), (12, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id int, text string, n int")
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, scratch).collect()}
    assert found == {(7, 56, 3, False), (3, 57, 3, True), (9, 56, 9, True), (None, 57, 9, False), (None, 56, None, True), (None, 57, None, True), (11, 57, 3, False), (None, 0, None, True), (12, 0, 12, True)}
    stay = sorted(((r["doc_id"] or 0, r["text"] or "") for r in minhash.survivors(df, scratch).collect()), key=str)
    assert stay == sorted([(3, near(b)), (9, c), (0, d), (0, ""), (0, ""), (12, "")], key=str)


def test_blocks_change_nothing(docs, scratch, texts, monkeypatch):
    for name, value in (("BLOCK", 5), ("LEAST_BLOCK", 3), ("BLOCK_BYTES", 3000), ("BROADCAST_KEYS", 1)):
        monkeypatch.setattr(minhash, name, value)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, scratch).collect()}
    assert found == near_duplicates(texts)


def test_small_tables_are_few_files(spark, scratch, docs, texts, monkeypatch):
    """However many partitions a shuffle has: each file of a local folder makes an executor start processes."""
    write, files = common.Scratch.table, {}

    def counted(self, df, name, *args):
        table = write(self, df, name, *args)
        files[name] = len(list(Path(self.path(name).removeprefix("file://")).glob("*.parquet")))
        return table

    monkeypatch.setattr(common.Scratch, "table", counted)
    cores = spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3 * cores)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        kept = {r["doc_id"] for r in minhash.survivors(docs, scratch).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == {k for k, (_, _, keep) in near_duplicates(texts).items() if keep}
    assert {"found", "members", "crowded", "star", "near-found", "component-0", "across", "dropped"} <= files.keys()
    assert {k: n for k, n in files.items() if n > cores} == {}


def test_families_find_links_that_no_hub_has(spark, scratch):
    """A chain of texts, each similar to the next but not to the one after."""
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[i * 12 : i * 12 + 120]) for i in range(20)}
    texts |= {100 + i: " ".join(words[i * 12 : i * 12 + 119] + [f"x{i}"]) for i in range(20)}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), scratch).collect()}
    assert found == near_duplicates(texts)
    assert found[119][1] == 0


def test_odd_sketches_tell_similarities():
    """The differing bits of sketches estimate the similarity, with the spread that the cutoff allows for."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for similarity in (0.6, 0.75, 0.9, 0.97):
        common, errors = round(2000 * similarity / (1 + similarity)), []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
            a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
            bits = int(np.bitwise_count((minhash.odd_sketch(minhash.samples(a)) ^ minhash.odd_sketch(minhash.samples(b))).view(np.uint64)).sum())
            errors.append(1 + minhash.BITS / (4 * minhash.SAMPLES) * math.log(1 - 2 * bits / minhash.BITS) - similarity)
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
    assert minhash.sketch_cutoff() > 0


def test_bands_miss_no_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 280, dtype=np.uint64)
        a, b = minhash.samples(pool[:245]), minhash.samples(pool[35:])
        missed += not (minhash.bands(a) == minhash.bands(b)).any()
        assert np.bitwise_count((minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64)).sum() <= minhash.sketch_cutoff()
    assert missed == 0


@pytest.mark.parametrize("most", [common.BROADCAST_KEYS, 3])
def test_components(spark, scratch, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(1, 80)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    expected = components(nodes, [e for e in edges if e[0] != e[1]])
    found = {r["node"]: r["component"] for r in spark_components(spark.createDataFrame(edges, "u long, v long"), scratch, "test").collect()}
    assert found == expected
    assert spark_components(spark.createDataFrame([], "u long, v long"), scratch, "none").count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = {i: rng.normal(size=16).tolist() for i in range(300)}
    base = rng.normal(size=16)
    rows |= {300 + i: (base + 0.12 * rng.normal(size=16)).tolist() for i in range(120)}
    rows |= {420 + i: rows[7] for i in range(30)}
    rows |= {450: None, 451: [], 452: [0.0] * 16, 453: [None, *[1.0] * 15], 454: [math.nan, *[1.0] * 15], 455: [math.inf, *[1.0] * 15], 456: (np.array(rows[300]) * 1e200).tolist(), 457: (np.array(rows[8]) * -1).tolist(), 458: [1.0, 2.0], 459: [2.0, 4.0], 460: (np.array(rows[9]) * 3).tolist()}
    return rows


def plain_links(rows):
    units = {k: cap_filters.unit(v) for k, v in rows.items()}
    keys = sorted(rows)
    edges = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    found = components(keys, edges)
    return {k: (sum(k in e for e in edges), found[k], found[k] == k) for k in keys}


def test_vectors(spark, scratch, vectors):
    df = spark.createDataFrame(sorted(vectors.items()), "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_duplicates(df, scratch).collect()}
    assert found == plain_links(vectors)


def test_odd_vectors(spark, scratch):
    """Repeated ids, missing ids, and other columns of clashing names."""
    a, near, far = [1.0, 0.0, 0.0, 0.2], [1.0, 0.1, 0.0, 0.2], [0.0, 0.0, 5.0, 0.0]
    rows = [(1, a), (1, a), (2, near), (None, [2.0, 0.0, 0.0, 0.4]), (4, far), (4, a), (None, [0.0, 3.0, 0.0, 0.0]), (None, None), (None, None), (8, None), (8, [])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id int, embedding array<double>, key string, component string, number string")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_duplicates(df, scratch).collect()), key=str)
    # 1 and 4 have one vector, near it are 2 and the row without an id
    expected = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (4, 0, 4, True), (4, 3, 1, False), (None, 0, None, True), (None, 0, None, True), (None, 0, None, True), (8, 0, 8, True), (8, 0, 8, True)]
    assert found == sorted(expected, key=str)


def test_crowded_filters_in_blocks(spark, scratch, vectors, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 16)
    df = spark.createDataFrame(sorted(vectors.items()), "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_duplicates(df, scratch).collect()}
    assert found == plain_links(vectors)


def test_no_vectors(spark, scratch):
    assert cap_filters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


@pytest.mark.parametrize("vectors", [500, 16_384, 65_536])
def test_recall_of_filters(vectors):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(1500, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    plan = cap_filters.plan(vectors)
    left, right = cap_filters.all_filters(x, *plan), cap_filters.all_filters(0.9 * x + math.sqrt(1 - 0.81) * y, *plan)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(left, right)]) > 0.995


@pytest.mark.parametrize(("vectors", "dimension"), [(1 << n, d) for n in (20, 24, 30) for d in (16, 32, 64, 384, 768)] + [(1 << 14, 3), (1 << 20, 4), (1 << 20, 8), (1 << 34, 64)])
def test_recall_at_any_size_and_dimension(vectors, dimension):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(500, dimension))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    plan = cap_filters.plan(vectors, dimension=dimension)
    assert plan[3] * plan[2] ** plan[1] < 1 << 63
    left, right = cap_filters.all_filters(x, *plan), cap_filters.all_filters(0.9 * x + math.sqrt(1 - 0.81) * y, *plan)
    shared = np.array([len(np.intersect1d(a, b)) for a, b in zip(left, right)])
    assert np.mean(shared > 0) > 0.995
    assert plan[3] == 1 or shared.mean() > 25


def test_vectors_of_few_dimensions(spark, scratch):
    rng = np.random.default_rng(4)
    rows = {i: rng.normal(size=(1, 2, 3, 5)[i % 4]).tolist() for i in range(400)}
    units = {k: cap_filters.unit(v) for k, v in rows.items()}
    links = {k: sum(k != j and len(u) == len(w) and u @ w >= 0.9 for j, w in units.items()) for k, u in units.items()}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in cap_filters.near_duplicates(df, scratch).collect()} == links


def test_listing_finds_all_filters():
    code = cap_filters.ProductCode(12, 1.5, 3, 7)
    x = np.random.default_rng(1).normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.turn
    for i, found in enumerate(code.filters(x)):
        scores = [turned[i, a:b] @ book.T for a, b, book in zip([0, *code.ends[:-1]], code.ends, code.books)]
        total = scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None, :]
        assert found.tolist() == np.flatnonzero(total.reshape(-1) >= 1.5 - 1e-12).tolist()
