"""Byte-level BPE, token files, packing and sharding against the libraries and plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.plain import best_fit, jump
from trawl.llm import bpe, chunks, orc_tokens, packing, sharding


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(ranks, n):
    rng = random.Random(9)
    signs = "abcdeé  \n\t漢字\U0001f600.,!'s1230ThñÜß́\x1c"
    vocabulary = [b for b in ranks if len(b) > 3]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + [b"".join(rng.choice(vocabulary) for _ in range(3)).decode("utf-8", "ignore") for _ in range(n)]


def test_encoding_equals_the_library(ranks, library, texts):
    encoder = bpe.Encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    all_texts = some_texts(ranks, 800) + [t or "" for t in texts.values()]
    for text, (ids, joined) in zip(all_texts, encoder.encode(all_texts), strict=True):
        assert ids == library.encode_ordinary(text), text
        assert joined == ",".join(map(str, ids))


def test_few_states_and_a_small_memo_change_nothing(ranks, library):
    encoder = bpe.Encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN, memo=10)
    encoder.transducer.limit = 50
    some = some_texts(ranks, 300)
    for text in some:
        assert next(encoder.encode([text]))[0] == library.encode_ordinary(text)
    assert encoder.transducer.flushes > 10 and len(encoder.transducer.hypotheses) <= 51


def test_long_pieces_are_emitted_in_windows(ranks, library, monkeypatch):
    rng = random.Random(3)
    vocabulary = [b.decode() for b in ranks if b.isalpha() and b.isascii()]
    text = "".join(rng.choice(vocabulary) for _ in range(30_000))
    machine = bpe.Transducer(ranks)
    assert machine.encode(text.encode()) == library.encode_ordinary(text)
    monkeypatch.setattr(bpe, "WINDOW", 7)
    for at in range(0, 3000, 30):
        assert machine.encode(text[at : at + 30].encode()) == library.encode_ordinary(text[at : at + 30])


def test_lookahead_is_bounded(ranks):
    """What all hypotheses agree on never lags behind by more than twice the longest token."""
    machine, rng = bpe.Transducer(ranks), random.Random(8)
    vocabulary = [b for b in ranks if b.isalpha()]
    for _ in range(30):
        data, state, lengths = b"".join(rng.choice(vocabulary) for _ in range(40)), 0, []
        for byte in data:
            state, _, length = machine._step(state, byte)
            lengths.append(length)
            assert len(lengths) - machine.agreed(state, lengths) <= 2 * machine.longest


def test_states_grow_slower_than_texts(ranks, library):
    """Real pieces share states: words of the test table lead to far fewer states than they have beginnings."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    encoder = bpe.Encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for text, (ids, _) in zip(texts, encoder.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
    pieces = {p.encode() for t in texts for p in encoder.pieces(t)} - set(ranks)
    beginnings = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
    assert encoder.transducer.flushes == 0 and 4 * len(encoder.transducer.hypotheses) < len(beginnings)


def test_pair_rule_equals_merging(ranks):
    machine, rng = bpe.Transducer(ranks), random.Random(4)
    tokens = [t for t in list(ranks.values()) if bpe.merge(machine.bytes_of[t], ranks) == [t]]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert machine._may_follow(a, b) == (bpe.merge(machine.bytes_of[a] + machine.bytes_of[b], ranks) == [a, b])


@pytest.mark.parametrize("data", ["aé漢\U0001f600z".encode(), b"a\xc3", b"\xff\xc3\xa9", b"\xe6\xbc\xe6\xbc\xa2", b"\xf0\x9f\x98a", b"\xc0\x80", b"\xed\xa0\x80x", b"\xf4\x90\x80\x80"])
def test_streaming_decoder(data):
    table = {i: data[i : i + 1] for i in range(len(data))}
    decoder = bpe.StreamDecoder(table)
    out = b"".join(decoder.feed([i]) for i in range(len(data))) + decoder.end()
    assert out.decode() == data.decode("utf-8", "replace")


def test_round_trip(odd, empty, texts, library):
    import hashlib

    path, pattern = public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN
    rows = {r["doc_id"]: r for r in bpe.round_trip(odd, path, pattern).collect()}
    assert set(rows) == {*texts, None}
    for key, text in texts.items():
        ids = library.encode_ordinary(text or "")
        assert rows[key]["n_tokens"] == len(ids)
        assert rows[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    again = bpe.decode_documents(bpe.encode_documents(odd, path, pattern), path)
    assert {r["doc_id"]: r["text"] for r in again.collect() if r["doc_id"] is not None} == {k: t or "" for k, t in texts.items()}
    assert bpe.round_trip(empty, path, pattern).count() == 0


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_equal_whole_texts(ranks, texts, name, spaced):
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), chunks.ChunkEncoder(path, spaced, memo=200)
    some = some_texts(ranks, 300) + [t or "" for t in texts.values()] + ["a\x1cb \x1c c", " 　x  y", "abc\n def", "\nabc  d\n", "0 0\n0", "x's 'll.'ve"]
    for at in range(0, len(some), 50):
        part = some[at : at + 50]
        expected = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part) == expected


def whole_ids(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_orc_files(spark, odd, texts, scratch):
    target = scratch.path("ids")
    orc_tokens.write(odd, target, public_tokenizers.path(orc_tokens.TOKENIZER), partitions=5)
    rows = orc_tokens.digests(spark, target).collect()
    library = Tokenizer.from_file(public_tokenizers.path(orc_tokens.TOKENIZER))
    expected, start = [], 0
    for key in [None, *sorted(texts)]:
        ids = [*library.encode(texts[5 if key is None else key] or "", add_special_tokens=False).ids, 0]
        expected.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    files = sorted({r[0] for r in orc_tokens.read(spark, target).select(F.input_file_name()).collect()})
    assert len(files) == 5
    some = orc_tokens.read(spark, target, [7, 99])
    assert sorted(r["doc_id"] for r in some.select("doc_id").collect()) == [7, 99]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def test_orc_metadata(spark, docs, scratch):
    import pyarrow.orc as orc

    target = scratch.path("ids")
    orc_tokens.write(docs, target, public_tokenizers.path(orc_tokens.TOKENIZER), partitions=2)
    path = orc_tokens.read(spark, target).select(F.input_file_name()).first()[0].removeprefix("file://")
    assert orc.ORCFile(path).nstripes >= 1
    assert b"orc" in open(path, "rb").read(3).lower()


def test_orc_indexes_skip_stripes(spark, scratch, texts):
    """The files' own streams: row indexes and Bloom filters of the ids are there, and a missing id reads no row groups."""
    import pyarrow.orc as orc

    target = scratch.path("ids")
    many = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "repeat('some words here ', 4) AS text")
    orc_tokens.write(many, target, public_tokenizers.path(orc_tokens.TOKENIZER), partitions=2)
    paths = [r[0].removeprefix("file://").removeprefix("file:") for r in orc_tokens.read(spark, target).select(F.input_file_name()).distinct().collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 5000 and reader.getStripes().size() == orc.ORCFile(path).nstripes
        stripes = reader.getStripes()
        held = [stripes[n].getIndexLength() for n in range(stripes.size())]
        assert min(held) > 5000  # indexes with a Bloom filter of the ids for every 5,000 rows
    assert orc_tokens.read(spark, target, [4, 39_998]).count() == 2
    assert orc_tokens.read(spark, target, [5, 39_999, 70_000]).count() == 0


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_repeated_rows_and_small_ids(spark, scratch, kind):
    """Ids of any integer type, repeated and missing ids, clashing columns."""
    rows = [(1, "a b c", "k"), (1, "a b c", "k"), (1, "other", "l"), (None, None, None), (2, "", "m")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, file string")
    path, target = public_tokenizers.path(bpe.RANKS), scratch.path("ids")
    assert sorted(r["n_tokens"] for r in bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())[:2] == [0, 0]
    orc_tokens.write(df, target, public_tokenizers.path(orc_tokens.TOKENIZER), partitions=2)
    found = sorted(tuple(r) for r in orc_tokens.digests(spark, target).select("start", "n_tokens").collect())
    assert len(found) == 5 and all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:]))
    assert packing.pack_documents(df, scratch).count() == 5
    shards = sharding.assign(df, scratch).collect()
    assert len(shards) == 5 and len({r["shard"] for r in shards if r["doc_id"] == 1}) == 1
    plain = sharding.assign(spark.createDataFrame([(1, "")], "doc_id bigint, text string"), scratch).first()
    assert {r["shard"] for r in shards if r["doc_id"] == 1} == {plain["shard"]}


def test_shards_by_the_plain_hash(spark, scratch):
    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return x ^ (x >> 31)

    ids = [*range(-5, 200), 1 << 40, -(1 << 62)]
    rows = sharding.assign(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), scratch).collect()
    assert {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in rows} == {i: (jump(mixed(i % (1 << 64)), 40), jump(mixed(i % (1 << 64)), 41)) for i in ids}


def test_one_word_of_megabytes(spark, scratch):
    df = spark.createDataFrame([(1, "x" * 3_000_000)], "doc_id long, text string")
    rows = packing.pack_documents(df, scratch).collect()
    assert sum(r["length"] for r in rows) >= 2 and max(r["length"] for r in rows) <= 4096


def test_orc_of_nothing(spark, empty, scratch):
    target = scratch.path("ids")
    orc_tokens.write(empty, target, public_tokenizers.path(orc_tokens.TOKENIZER), partitions=2)
    assert orc_tokens.digests(spark, target).count() == 0


def test_packing(odd, texts, scratch):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack_documents(odd, scratch).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for key in [*texts, None]:
        ids, at = [*library.encode(texts[5 if key is None else key] or "", add_special_tokens=False).ids, 1], 0
        for number, r in enumerate(sorted(by_doc[key], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["length"]) == (number, at, min(4096, len(ids) - at))
            assert r["ids_crc32"] == crc(ids[at : at + 4096])
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == best_fit([r["length"] for r in rows])


def test_packing_of_nothing(empty, scratch):
    assert packing.pack_documents(empty, scratch).count() == 0


def test_histogram_packing_is_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, 2, capacity // 2, capacity // 3]) or 1 for _ in range(rng.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.pack_histogram(counts, capacity)
        places = packing.Places(runs)
        filled = defaultdict(list)
        for length, count in counts.items():
            assert sum(r.count for r in runs if r.length == length) == count
            sequence, offset = places.find(np.full(count, length), np.arange(count))
            for s, o in zip(sequence.tolist(), offset.tolist()):
                filled[s].append((o, length))
        for pieces in filled.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(filled) == best_fit(lengths, capacity)
    with pytest.raises(ValueError):
        packing.pack_histogram({5000: 1})


def test_room_tree():
    tree = packing.RoomTree(20)
    tree.set(7, 1)
    tree.set(15, 2)
    assert [tree.tightest(n) for n in (1, 7, 8, 15, 16)] == [7, 7, 15, 15, None]
    tree.set(7, 0)
    assert tree.tightest(3) == 15


def test_jump_hash():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for n in (1, 2, 7, 40, 41, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    before, after = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    moved = before != after
    assert (after[moved] == 40).all() and 0.01 < moved.mean() < 0.05
    assert len(sharding.jump_hash(keys[:0], 5)) == 0
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_sharding(odd, texts, empty, scratch):
    rows = sharding.assign(odd, scratch).collect()
    assert len(rows) == len(texts) + 1
    slots = defaultdict(list)
    for r in rows:
        data = (texts[5 if r["doc_id"] is None else r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty, scratch).count() == 0


def test_one_shard_for_equal_ids(spark, scratch):
    rows = sharding.assign(spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "doc_id long, text string"), scratch).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == [0, 1, 2]
