"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate.

Lines with a word are the places of the chain. What a line looks like (length, end, symbols, capitals, digits, variety, repetition,
place) is a set of features with one weight for each label; neighbouring labels have weights too. The weights are fitted by
conditional likelihood on a bounded sample of documents, where clear lines get a label from plain rules and the others stay
open: the gradient is the difference between what the model expects given those labels and without them. Viterbi decoding then
labels all lines of every whole text. A document is kept if content lines hold enough of its words' characters.

Defined results: a null or empty text has no words and fails the base rules; equal lines after the first count as repeated;
repeated rows give equal results; an empty table gives an empty result; other columns are passed on by ``keep`` and ignored by
``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import lean
from .common import read_table, texts_of, tune
from .sampling import hashed_sample
from .shingles import PLACE, WORDS_SQL, mix, word_hashes

CONTENT, BOILERPLATE = 0, 1
#: Documents to fit on at most, lines of all of them together, and rounds of fitting.
SAMPLE, LINES, ROUNDS = 1500, 60_000, 60
#: Share of the characters of words that content lines must hold.
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
#: Number of values of each feature, in the order of `features`.
KINDS = (6, 2, 4, 4, 3, 3, 2, 2, 2)
FIRST = np.concatenate([[0], np.cumsum(KINDS)[:-1]])
WEIGHTS = int(sum(KINDS))


def _level(value: float, *bounds: float) -> int:
    return sum(value >= b for b in bounds)


def features(line: bytes, words: list[bytes], seen: bool, edge: bool) -> tuple[int, ...]:
    """The value of every feature of one line with at least one word."""
    n, size = len(words), max(1, len(line))
    return (
        _level(n, 2, 4, 8, 16, 64),
        words[-1][-1:] in b".!?:;\"'",
        _level((len(line) - len(line.translate(None, SYMBOLS))) / n, 0.02, 0.1, 0.3),
        _level((len(line) - len(line.translate(None, UPPER))) / size, 0.1, 0.3, 0.5),
        _level((len(line) - len(line.translate(None, DIGITS))) / size, 0.1, 0.3),
        _level(len(set(words)) / n, 0.3, 0.6) if n >= 6 else 2,
        seen,
        line.count(b"!!") > 0.2 * n,
        edge,
    )


def clear_label(found: tuple[int, ...]) -> int:
    """The label that plain rules give a clear line; -1 where they leave it open."""
    length, _, symbols, capitals, digits, variety, seen, shouting, _ = found
    if symbols == 3 or capitals == 3 and length or digits == 2 or variety == 0 or seen or shouting:
        return BOILERPLATE
    if length >= 1 and not symbols and capitals <= 1 and variety == 2 and not digits:
        return CONTENT
    return -1


def lines_of(text: bytes) -> list[tuple[bytes, list[bytes], bool]]:
    """Lines with a word, their words, and whether an equal line came before."""
    seen: set[bytes] = set()
    out = []
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            out.append((line, words, line in seen))
            seen.add(line)
    return out


def chain_of(lines: list[tuple[bytes, list[bytes], bool]]) -> list[tuple[int, ...]]:
    last = len(lines) - 1
    return [features(line, words, seen, i in (0, last)) for i, (line, words, seen) in enumerate(lines)]


class Field:
    """Weights of features for the two labels and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.scores = lru_cache(maxsize=50_000)(self._scores)

    def _scores(self, found: tuple[int, ...]) -> tuple[float, float]:
        a, b = self.weights[FIRST + np.array(found, dtype=np.int64)].sum(axis=0)
        return float(a), float(b)

    def viterbi(self, chain: list[tuple[int, ...]]) -> list[int]:
        """The likeliest sequence of labels; content wins ties."""
        if not chain:
            return []
        (cc, cb), (bc, bb) = self.moves.tolist()
        content, boiler = self.scores(chain[0])
        back = []
        for found in chain[1:]:
            a, b = self.scores(found)
            from_b = boiler + bc > content + cc
            to_b = boiler + bb > content + cb
            back.append((from_b, to_b))
            content, boiler = (boiler + bc if from_b else content + cc) + a, (boiler + bb if to_b else content + cb) + b
        label = int(boiler > content)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _expected(emit: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels (document, place, label) and expected numbers of moves, by forward and backward sums."""
    docs, places, _ = emit.shape
    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, places):
        forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
    for t in range(places - 2, -1, -1):
        on = (t + 1 < lengths)[:, None]
        backward[:, t] = np.where(on, np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), 0.0)
    total = np.logaddexp.reduce(forward[np.arange(docs), lengths - 1], axis=1)
    inside = (np.arange(places) < lengths[:, None])[:, :, None]
    labels = np.where(inside, np.exp(np.where(inside, forward + backward - total[:, None, None], -np.inf)), 0.0)
    pairs = forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pairs = np.where(inside[:, 1:, :, None], pairs, -np.inf)
    return labels, np.exp(pairs).sum(axis=(0, 1))


def fit(chains: list[list[tuple[int, ...]]], rounds: int = ROUNDS, rate: float = 0.5, shrink: float = 0.01) -> Field:
    """Weights by gradient ascent on the conditional likelihood of the clear labels; open lines are summed over."""
    chains = sorted((c for c in chains if c), key=len) or [[tuple(0 for _ in KINDS)]]
    weights, moves = np.zeros((WEIGHTS, 2)), np.zeros((2, 2))
    groups = [_padded(group) for group in _alike_long(chains)]
    places = sum(map(len, chains))
    squares = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    for _ in range(rounds):
        slope, turn = np.zeros_like(weights), np.zeros_like(moves)
        for found, barred, lengths in groups:
            emit = weights[found].sum(axis=2)
            free, free_moves = _expected(emit, moves, lengths)
            held, held_moves = _expected(emit + barred, moves, lengths)
            change, flat = (held - free) / places, found.reshape(-1)
            for label in (CONTENT, BOILERPLATE):
                slope[:, label] += np.bincount(flat, np.repeat(change[:, :, label].reshape(-1), len(KINDS)), minlength=WEIGHTS)
            turn += (held_moves - free_moves) / places
        for target, gradient, square in ((weights, slope - shrink * weights / len(KINDS), squares[0]), (moves, turn - shrink * moves, squares[1])):
            square += gradient**2
            target += rate * gradient / np.sqrt(square)
    return Field(weights, moves)


def _alike_long(chains: list[list[tuple[int, ...]]]) -> Iterator[list[list[tuple[int, ...]]]]:
    """Chains in the order of their lengths in groups that padding makes at most half as long again."""
    start = 0
    for i in range(1, len(chains) + 1):
        if i == len(chains) or len(chains[i]) > 1.5 * len(chains[start]):
            yield chains[start:i]
            start = i


def _padded(chains: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the features of every line, what clear labels bar, and lengths."""
    lengths = np.array([len(c) for c in chains])
    found = np.zeros((len(chains), lengths.max(), len(KINDS)), dtype=np.int64)
    labels = np.full(found.shape[:2], -1)
    for i, chain in enumerate(chains):
        found[i, : len(chain)] = np.array(chain)
        labels[i, : len(chain)] = [clear_label(f) for f in chain]
    barred = np.zeros((*labels.shape, 2))
    barred[labels == CONTENT, BOILERPLATE] = barred[labels == BOILERPLATE, CONTENT] = -1e9
    return found + FIRST, barred, lengths


def train(docs: DataFrame, sample: int = SAMPLE, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on whole documents, at most ``sample`` of them with at most ``lines`` lines together; only their features reach the driver.

    Documents are taken in the order of their hashes until they have that many lines; longer ones than that are passed over.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = [chain_of(lines_of(t)) for t in texts_of(batch.column("text"))]
            flat = [[v for f in chain for v in map(int, f)] if len(chain) <= lines else [] for chain in chains]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(flat, pa.list_(pa.int8()))], ["doc_id", "chain"])

    wide = len(KINDS)
    rows = hashed_sample(docs, sample, id_col, text_col).mapInArrow(lean(extract), "doc_id long, chain array<byte>").withColumn("n", F.size("chain") / wide)
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of at most `sample` rows
    chosen = sorted(tuple(r["chain"]) for r in rows.withColumn("upto", F.sum("n").over(before)).filter(F.col("upto") <= lines).collect())
    return fit([[row[i : i + wide] for i in range(0, len(row), wide)] for row in chosen])


def base_counts(text: bytes, lines: list[tuple[bytes, list[bytes], bool]]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = text.split()
    code_points = sum(len(w.decode("utf-8", "replace")) for w in words) if not text.isascii() else len(text) - sum(map(text.count, SPACE_BYTES))
    repeated = 0
    if len(words) >= 4:
        hashes = word_hashes(words)
        count = len(words) - 2
        windows = hashes[:count] * PLACE[0] + hashes[1 : count + 1] * PLACE[1] + hashes[2:] * PLACE[2]
        _, back, times = np.unique(mix(windows), return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[back] > 1)
        covered = np.zeros(len(words), dtype=bool)
        covered[at] = covered[at + 1] = covered[at + 2] = True
        repeated = int(covered.sum())
    return len(words), code_points, len(text) - len(text.translate(None, SYMBOLS)), sum(seen for _, _, seen in lines), repeated


SPACE_BYTES = [SPACE[i : i + 1] for i in range(len(SPACE))]


def verdict(text: bytes, field: Field, share: float = CONTENT_SHARE) -> tuple[int, int, int, int, int, bool, bool, float]:
    """The base counts, base_failed, kept and the share of characters that content lines hold."""
    lines = lines_of(text)
    counts = base_counts(text, lines)
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    labels = field.viterbi(chain_of(lines))
    sizes = [sum(map(len, words)) for _, words, _ in lines]
    content = sum(s for s, label in zip(sizes, labels, strict=True) if label == CONTENT) / max(1, sum(sizes))
    return *counts, failed, not failed and content >= share, content


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every document."""
    weights, moves = field.weights, field.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights, moves)
        for batch in batches:
            rows = [verdict(t, model) for t in texts_of(batch.column("text"))]
            if rows:
                values = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in values[:5]), *(pa.array(v, pa.bool_()) for v in values[5:7]), pa.array(values[7], pa.float64())], ["doc_id", *COLUMNS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def keep(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    weights, moves = field.weights, field.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights, moves)
        for batch in batches:
            yield batch.filter(pa.array([verdict(t, model)[6] for t in texts_of(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


#: The base counts in SQL.
BASE_ORACLE = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS l FROM documents),
  t AS (SELECT doc_id, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w)),
  g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1),
  c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g) GROUP BY doc_id),
  o AS (SELECT doc_id, len(l) AS n_words, length(array_to_string(l, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM o LEFT JOIN c USING (doc_id)"""


def line_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op3_line_rules`` that no fit enters, on its own so that SQL can check it."""
    tune(spark)
    untrained = Field(np.zeros((WEIGHTS, 2)), np.zeros((2, 2)))
    return judge(read_table(spark, sf_dir, "documents"), untrained).drop("kept", "content_share")


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, train(docs))
