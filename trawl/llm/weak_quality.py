"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or abstain on every document. Expectation-maximisation over the counts of all vote
patterns in the whole corpus estimates how often each labeller says what on good and on bad documents, without any given labels
(the model of Dawid and Skene); the labellers overlap, and those that agree with the consensus weigh more. The posterior of a
document's pattern is its soft label. On a bounded sample of documents these labels train a linear scorer of hashed features
(shapes of words, measures of the text in steps), by logistic regression. The scorer judges every whole text.

The number of patterns is at most 3 to the number of labellers, so that counts, never documents, reach the driver; the sample
for the scorer is the parameter ``SAMPLE``.

Defined results: a text without words gets the score 0 and is not kept; repeated rows give equal results; without any documents
the model knows nothing and the result is empty; other columns are passed on by ``keep`` and ignored by ``judge``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import lean, release
from .common import read_table, texts_of, tune
from .sampling import hashed_sample

GOOD, BAD, NONE = 1, 0, 2
#: Documents that the scorer is fitted on.
SAMPLE = 6000
HASHED = 1 << 14
ROUNDS, RATE, SHRINK = 300, 0.1, 1e-4
#: A document is kept if the scorer gives it at least this probability of being good.
THRESHOLD = 0.5
SYMBOLS, UPPER, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
#: Frequent function words of the languages that the labellers know.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for as was with on be by this are or an at from der die das und ist nicht von mit den des ein "
    "eine zu im auf für de la le les et des une un que qui dans pour par sur est au du el los las del se con una es en y al su para".encode().split()
)
_SHAPES = bytes(ord("X") if b in UPPER else ord("0") if b in DIGITS else b if b in b" \t\n\x0b\x0c\r" or 32 < b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else ord("x") for b in range(256))


def measures(text: bytes, words: list[bytes]) -> dict[str, float]:
    """Measures of a text with at least one word."""
    n, size = len(words), sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) if n > 2 else 1
    return {
        "symbols": (len(text) - len(text.translate(None, SYMBOLS))) / n,
        "capitals": (len(text) - len(text.translate(None, UPPER))) / size,
        "digits": (len(text) - len(text.translate(None, DIGITS))) / size,
        "shouts": text.count(b"!!") / n,
        "length": size / n,
        "doubled": sum(map(bytes.__eq__, words, words[1:])) / n,
        "repeated": 1 - triples / max(1, n - 2),
        "function": sum(w in FUNCTION_WORDS for w in words) / n,
        "ended": ended / max(1, len(lines)),
        "bars": text.count(b" | ") / n,
        "n": n,
    }


#: A labeller: measure, bounds below (or above) which it says good and bad, and the words that it needs.
LABELLERS = (
    ("symbols", 0.02, 0.15, 5),
    ("capitals", 0.15, 0.4, 5),
    ("digits", 0.1, 0.4, 5),
    ("shouts", 0.02, 0.15, 5),
    ("doubled", 0.05, 0.3, 10),
    ("repeated", 0.1, 0.5, 20),
    ("function", 0.08, 0.01, 30),
    ("ended", 0.6, 0.1, 20),
    ("bars", 0.02, 0.15, 10),
    ("length", 12.0, 18.0, 5),
)


def votes(found: dict[str, float]) -> tuple[int, ...]:
    out = []
    for name, good, bad, least in LABELLERS:
        value, rising = found[name], good < bad
        if found["n"] < least:
            out.append(NONE)
        elif value <= good if rising else value >= good:
            out.append(GOOD)
        elif value >= bad if rising else value <= bad:
            out.append(BAD)
        else:
            out.append(NONE)
    return tuple(out)


def pattern_code(vote: tuple[int, ...]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v
    return code


def code_votes(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return tuple(out[::-1])


class LabelModel:
    """Probabilities of votes given the class, by expectation-maximisation over counted patterns."""

    def __init__(self, counts: dict[int, int], rounds: int = 200):
        codes = sorted(counts)
        patterns = np.array([code_votes(c) for c in codes], dtype=np.int64).reshape(-1, len(LABELLERS))
        weight = np.array([counts[c] for c in codes], dtype=np.float64)
        said = patterns != NONE
        posterior = ((patterns == GOOD).sum(axis=1) + 1) / (said.sum(axis=1) + 2)  # start from the majority
        posterior = np.where((patterns == BAD).any(axis=1), np.minimum(posterior, 0.4), np.maximum(posterior, 0.6))
        self.prior, self.given = 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
        for _ in range(rounds if len(codes) else 0):
            total = np.array([(weight * (1 - posterior)).sum(), (weight * posterior).sum()])
            self.prior = (total[1] + 1) / (total.sum() + 2)
            for label, part in ((0, weight * (1 - posterior)), (1, weight * posterior)):
                for v in range(3):
                    self.given[label, :, v] = ((part[:, None] * (patterns == v)).sum(axis=0) + 1) / (total[label] + 3)
            posterior, last = self._posterior(patterns), posterior
            if np.abs(posterior - last).max() < 1e-9:
                break

    def _posterior(self, patterns: np.ndarray) -> np.ndarray:
        """An abstention tells nothing: whether a labeller speaks depends on the text's length."""
        places = np.arange(len(LABELLERS))
        spoken = self.given[:, :, :2] / self.given[:, :, :2].sum(axis=2, keepdims=True)
        odds = np.log(spoken[1][places, np.minimum(patterns, 1)]) - np.log(spoken[0][places, np.minimum(patterns, 1)])
        logit = math.log(self.prior / (1 - self.prior)) + np.where(patterns == NONE, 0.0, odds).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def probability(self, code: int) -> float:
        return float(self._posterior(np.array([code_votes(code)]))[0])

    def accuracies(self) -> list[float]:
        """How often each labeller is right when it speaks, by the model."""
        right = self.given[0, :, BAD] * (1 - self.prior) + self.given[1, :, GOOD] * self.prior
        return (right / (self.given[0, :, :2].sum(axis=1) * (1 - self.prior) + self.given[1, :, :2].sum(axis=1) * self.prior)).tolist()


def _place(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % HASHED


def hashed_features(text: bytes, words: list[bytes], found: dict[str, float]) -> tuple[list[int], list[float]]:
    """Places and values of the features of a text, of length 1 in each of two groups: word shapes and stepped measures."""
    shapes: Counter[bytes] = Counter()
    for shape, n in Counter(text.translate(_SHAPES).split()).items():
        shapes[shape[:2] + b"~" + shape[-3:] if len(shape) > 5 else shape] += n
    norm = math.sqrt(sum(n * n for n in shapes.values()))
    places, values = [_place(b"shape " + s) for s in shapes], [n / norm for n in shapes.values()]
    steps = [f"{name} {min(20, int(value * 20))}".encode() for name, value in found.items() if name not in ("n", "length")]
    places += [_place(s) for s in steps]
    values += [1 / math.sqrt(len(steps))] * len(steps)
    return places, values


class Scorer:
    """A linear model of hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        words = text.split()
        if not words:
            return 0.0
        places, values = hashed_features(text, words, measures(text, words))
        logit = self.bias + float(np.dot(self.weights[places], values))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, logit))))


def fit_scorer(rows: list[tuple[list[int], list[float]]], target: np.ndarray) -> Scorer:
    """Logistic regression on soft labels by full gradients with adaptive steps; both classes weigh the same."""
    weights, bias = np.zeros(HASHED), 0.0
    if not rows:
        return Scorer(weights, bias)
    at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    places = np.concatenate([np.array(p, dtype=np.int64) for p, _ in rows])
    values = np.concatenate([np.array(v) for _, v in rows])
    share = np.clip(target.mean(), 0.02, 0.98)
    worth = target / (2 * share) + (1 - target) / (2 * (1 - share))
    squares, square = np.full(HASHED, 1e-8), 1e-8
    for _ in range(ROUNDS):
        logit = bias + np.bincount(at, weights[places] * values, minlength=len(rows))
        error = worth * (target - 1 / (1 + np.exp(-np.clip(logit, -40, 40)))) / len(rows)
        slope = np.bincount(places, error[at] * values, minlength=HASHED) - SHRINK * weights
        squares += slope**2
        weights += RATE * slope / np.sqrt(squares)
        square += error.sum() ** 2
        bias += RATE * error.sum() / math.sqrt(square)
    return Scorer(weights, bias)


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """The label model of all documents and the scorer fitted on at most ``sample`` of them."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            codes = []
            for text in texts_of(batch.column("text")):
                if words := text.split():
                    codes.append(pattern_code(votes(measures(text, words))))
            found = Counter(codes)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["code", "n"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                if words := text.split():
                    found = measures(text, words)
                    rows.append((doc_id, pattern_code(votes(found)), *hashed_features(text, words, found)))
            ids, codes, places, values = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "code", "places", "values"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = texts.select("text").mapInArrow(lean(patterns), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    model = LabelModel({r["code"]: r["n"] for r in counted.collect()})  # at most 3 ** len(LABELLERS) rows
    rows = hashed_sample(docs, sample, id_col, text_col).mapInArrow(lean(extract), "doc_id long, code int, places array<int>, values array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["code"], len(r["places"])))
    return model, fit_scorer([(r["places"], r["values"]) for r in rows], np.array([model.probability(r["code"]) for r in rows]))


def judge(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and verdict of every document: doc_id, score, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scores = [scorer.score(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], ["doc_id", "score", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double, kept boolean")


def keep(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) >= threshold for t in texts_of(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, train(docs)[1])
