"""Words and sets of word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .chunks import Memo

WIDTH = 5
#: The words of a text in SQL, with A-Z in lower case or as they are.
WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOWERED_SQL = WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_rng = np.random.default_rng(20240501)
#: One odd multiplier for each place in a shingle, and one for the number of words.
PLACE = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LENGTH = 0x9E3779B97F4A7C15

_words = Memo(xxhash.xxh3_64_digest, 250_000)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_words.lookup(), words)), dtype=">u8").astype(np.uint64)


def lowered(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: what ``split`` of bytes does."""
    return text.lower().split()


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; one of the whole sequence if there are fewer words, none without words."""
    words = lowered(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes, span = word_hashes(words), min(width, len(words))
    count = len(words) - span + 1
    out = np.full(count, LENGTH * span % (1 << 64), dtype=np.uint64)
    for place in range(span):
        out += hashes[place : place + count] * PLACE[place]
    return np.unique(mix(out))
