"""Byte-level BPE by a lazily determinised transducer, and streaming decoding through a UTF-8 state machine.

A sequence of vocabulary tokens is the BPE encoding of its bytes exactly if every token encodes to itself and every two
neighbours, encoded together, stay the same two tokens. That makes encoding a matter of a finite-state machine: a hypothesis
holds the last finished token and the bytes read since, which must begin some token that may follow. All hypotheses alive at once
form one state of the determinised transducer. Exactly one of them has nothing left over, so that a transition puts out the token
that ends with its byte in the encoding of the text so far; tokens on which all hypotheses agree are emitted, after a lookahead
that the longest token bounds. Last tokens after which the same tokens may follow, given the bytes read since, are the same in a
state, so that states are far fewer than the texts that lead to them. States and transitions are made when first needed; once there
are as many as allowed, all are dropped and made anew as needed. There is no other way through.

Defined results: a null or empty text has no ids and decodes to nothing; malformed bytes in a stream of ids decode to U+FFFD;
repeated rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import LETTERS, SPACED, Memo, in_slices, lean
from .common import read_table, tune

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's memo of frequent text pieces, and states of its transducer.
MEMO = 800_000
STATES = 100_000
#: Bytes of a piece between two emissions.
WINDOW = 4096
#: Remembered answers to whether a token may follow another.
VALID = 500_000
#: Plain words, which are one match of the pattern.
PLAIN = re.compile(f" ?[{LETTERS}]+").fullmatch
SINGLE = [bytes((b,)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition of BPE: merge the neighbours of the lowest rank, the first of equals, until none can be merged."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece of text to token ids.

    A hypothesis is (last token or -1, bytes since), a state a tuple of them, the shortest rest last. ``steps`` maps (state, byte)
    to (state, token that ends here, its length).
    """

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.begins = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.longer: dict[bytes, list[int]] = {}
        for token, rank in ranks.items():
            for n in range(2, len(token)):
                self.longer.setdefault(token[:n], []).append(rank)
        self.extended = {token[:n] for token in ranks for n in range(1, len(token))}
        self.longest = max(map(len, ranks))
        self.limit, self.flushes = states, 0
        self.valid: dict[int, bool] = {}
        self.spines: dict[int, list[tuple[bytes, int, int]] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop all states; the first is that before a piece."""
        self.hypotheses: list[tuple] = [((-1, b""),)]
        self.numbers: dict[tuple, int] = {self.hypotheses[0]: 0}
        self.steps: dict[int, tuple[int, int, int]] = {}
        self.alike: dict[tuple[int, bytes], int | None] = {}
        self.by_edge: dict[tuple, int | None] = {}
        self.by_tokens: dict[tuple, int] = {}

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """Parts of a token at its right or left edge while BPE builds it: (part, made at, used up at), the whole last.

        None if the token does not encode to itself.
        """
        key = token << 1 | right
        if key in self.spines:
            return self.spines[key]
        data, ranks, never = self.bytes_of[token], self.ranks, 1 << 60
        parts, spine, edge, made = [data[i : i + 1] for i in range(len(data))], [], -1 if right else 0, -1
        while len(parts) > 1:
            rank, at = min((ranks.get(x + y, never), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == never:
                self.spines[key] = None
                return None
            if at == (len(parts) - 2 if right else 0):
                spine.append((parts[edge], made, rank))
                made = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        spine.append((data, made, never))
        self.spines[key] = spine
        return spine

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the two tokens, encoded together, stay as they are: no parts at the seam ever merge with each other.

        Two parts merge if their union has a rank at which both still stand at the seam; of equal ranks the left one goes first.
        """
        get = self.ranks.get
        lefts = self._spine(last, True)
        for y, made_y, used_y in self._spine(token, False):
            for x, made_x, used_x in lefts:
                rank = get(x + y)
                if rank is not None:
                    when = max(rank, made_x, made_y)
                    if when < used_x and when <= used_y:
                        return False
        return True

    def _valid(self, last: int, token: int) -> bool:
        if len(self.valid) > VALID:
            self.valid.clear()
        found = self._spine(token, False) is not None and (last < 0 or self._may_follow(last, token))
        self.valid[last << 32 | token] = found
        return found

    def _like(self, last: int, since: bytes) -> int | None:
        """The token that stands for all after which the same tokens that begin with ``since`` may follow; None if none may."""
        if (last, since) in self.alike:
            return self.alike[last, since]
        ranks, begins, places = self.ranks.get, self.begins, range(1, len(since))
        # the parts at the token's edge that could merge with what begins a token after it
        edge = () if last < 0 else tuple(x for x in self._spine(last, True) if x[0] + since in begins or any((ranks(x[0] + since[:n]) or x[2]) < x[2] for n in places))
        found = self.by_edge.get((since, edge), 0)
        if found == 0:
            follow: object = edge
            if len(since) > 1:  # few enough to ask one by one
                follow = frozenset(t for t in self.longer[since] if self.valid.get(last << 32 | t, None) or last << 32 | t not in self.valid and self._valid(last, t))
            found = self.by_edge[since, edge] = self.by_tokens.setdefault((since, follow), last) if follow or len(since) == 1 else None
        self.alike[last, since] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int, int]:
        alive, tokens, valid, extended = [], self.ranks.get, self.valid, self.extended
        single, done, size = SINGLE[byte], -1, 0
        for last, since in self.hypotheses[state]:
            since += single
            token = tokens(since)
            if token is not None and not size:
                found = valid.get(last << 32 | token)
                if found is None:
                    found = self._valid(last, token)
                if found:
                    done, size = token, len(since)
            if since in extended:
                same = self._like(last, since)
                if same is not None:
                    alive.append((same, since))
        alive.append((done, b""))
        after = tuple(alive)
        number = self.numbers.get(after)
        if number is None:
            full = len(self.hypotheses) >= self.limit or len(self.alike) > 10 * self.limit
            if full:
                self._forget()
                self.flushes += 1
            number = self.numbers[after] = len(self.hypotheses)
            self.hypotheses.append(after)
            if full:
                return number, done, size
        step = self.steps[state << 8 | byte] = number, done, size
        return step

    def agreed(self, state: int, lengths: list[int]) -> int:
        """How many of the bytes read all hypotheses of the state encode alike; ``lengths`` are those of the tokens that end there."""
        ends = {len(lengths) - len(since) for _, since in self.hypotheses[state]}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - lengths[last - 1])
        return ends.pop()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        steps, state, out, tokens, lengths = self.steps.get, 0, [], [], []
        for at in range(0, len(piece), WINDOW):
            for byte in piece[at : at + WINDOW]:
                step = steps(state << 8 | byte)
                if step is None:
                    step = self._step(state, byte)
                    steps = self.steps.get
                state, token, length = step
                tokens.append(token)
                lengths.append(length)
            end = self.agreed(state, lengths) if at + WINDOW < len(piece) else len(lengths)
            back, place = [], end
            while place:
                back.append(tokens[place - 1])
                place -= lengths[place - 1]
            out += back[::-1]
            del tokens[:end], lengths[:end]
        return out


def _utf8_machine() -> dict[int, dict[int, int]]:
    """States of well-formed UTF-8: 0 between characters, others by what may still follow; a missing entry is an error."""
    tail = range(0x80, 0xC0)
    machine: dict[int, dict[int, int]] = {1: dict.fromkeys(tail, 0), 2: dict.fromkeys(tail, 1), 3: dict.fromkeys(tail, 2)}
    machine |= {
        4: dict.fromkeys(range(0xA0, 0xC0), 1),  # after E0: no overlong forms
        5: dict.fromkeys(range(0x80, 0xA0), 1),  # after ED: no surrogates
        6: dict.fromkeys(range(0x90, 0xC0), 2),  # after F0: no overlong forms
        7: dict.fromkeys(range(0x80, 0x90), 2),  # after F4: up to U+10FFFF
    }
    machine[0] = dict.fromkeys(range(0x80), 0) | dict.fromkeys(range(0xC2, 0xE0), 1) | dict.fromkeys(range(0xE0, 0xF0), 2) | dict.fromkeys(range(0xF0, 0xF5), 3)
    machine[0] |= {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    return machine


class StreamDecoder:
    """Ids in, whole characters out; bytes of an unfinished character wait for the next ids."""

    machine = _utf8_machine()

    def __init__(self, bytes_of: dict[int, bytes], split: set[int] | None = None):
        self.bytes_of = bytes_of
        self.split = self.split_tokens(bytes_of) if split is None else split
        self.state, self.held = 0, bytearray()

    @classmethod
    def split_tokens(cls, bytes_of: dict[int, bytes]) -> set[int]:
        """Tokens that don't begin and end between characters; all others leave the machine in state 0."""
        return {i for i, b in bytes_of.items() if cls._run(b) != 0}

    @classmethod
    def _run(cls, data: bytes, state: int = 0) -> int | None:
        for byte in data:
            state = cls.machine[state].get(byte)
            if state is None:
                return None
        return state

    def feed(self, ids: Iterable[int]) -> bytes:
        ids = ids if isinstance(ids, list) else list(ids)
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if not self.state and self.split.isdisjoint(ids):
            return data
        out, held, state = bytearray(), self.held, self.state
        for byte in data:
            following = self.machine[state].get(byte)
            if following is None:
                if held:
                    out += b"\xef\xbf\xbd"
                    held.clear()
                following = self.machine[0].get(byte)
                if following is None:
                    out += b"\xef\xbf\xbd"
                    state = 0
                    continue
            held.append(byte)
            state = following
            if not state:
                out += held
                held.clear()
        self.state = state
        return bytes(out)

    def end(self) -> bytes:
        out = b"\xef\xbf\xbd" if self.held else b""
        self.state, self.held = 0, bytearray()
        return out


class Encoder:
    """Whole texts to ids: the pattern's matches one by one, frequent runs of text by a bounded memo."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        self.transducer = Transducer(load_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.memo = Memo(self._learn, memo)
        self.split = StreamDecoder.split_tokens(self.transducer.bytes_of)

    def _learn(self, chunk: str) -> tuple[tuple[int, ...], str]:
        encode = self.transducer.encode
        ids = tuple(encode(chunk.encode()) if PLAIN(chunk) else chain.from_iterable(encode(p.encode()) for p in self.pieces(chunk)))
        return ids, ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, and the ids as decimal numbers joined by commas."""
        for text in texts:
            found = list(map(self.memo.lookup(), SPACED.findall(text)))
            yield list(chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])

    def decoder(self) -> StreamDecoder:
        return StreamDecoder(self.transducer.bytes_of, self.split)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids in a stream, and return counts and digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, ids_sha, decoded_sha = [], [], []
            for ids, joined in chain.from_iterable(tokens.encode(texts[part]) for part in in_slices(texts)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoder, digest = tokens.decoder(), hashlib.sha256()
                for at in range(0, len(ids), 1 << 16):
                    digest.update(decoder.feed(ids[at : at + (1 << 16)]))
                digest.update(decoder.end())
                decoded_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: ``doc_id, ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in in_slices(texts):
                ids = pa.array([x for x, _ in tokens.encode(texts[part])], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(ids)), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Texts again from ``doc_id, ids``: ``doc_id, text``; a null list of ids is a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in load_ranks(path).items()}
        split = StreamDecoder.split_tokens(bytes_of)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                decoder = StreamDecoder(bytes_of, split)
                texts.append(None if ids is None else (decoder.feed(ids) + decoder.end()).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
