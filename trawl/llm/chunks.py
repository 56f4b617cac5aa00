"""Whole texts to ids with the public tokenizer files, piece by piece through a bounded memo.

A text falls into chunks that the tokenizer's own splitting never crosses: a run of non-space characters with the one space
before it, or a run of white space. Frequent chunks are looked up, the others go to the library.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

#: White_Space of Unicode, which the tokenizers' patterns call \s.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
ENDS = r".,!?;:%$&*#|()\-"
#: A plain word that white space or plain punctuation follows, plain punctuation that white space follows, any other run of
#: non-space characters, white space. All but the third are pieces of the tokenizers' patterns; the third holds whole pieces.
SPACED = re.compile(f" ?[{LETTERS}]+(?=[{SPACES}{ENDS}]|$)| ?[{ENDS}]+(?=[{SPACES}]|$)| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BARE = re.compile(f"[{LETTERS}]+(?=[{SPACES}{ENDS}]|$)|[{ENDS}]+(?=[{SPACES}]|$)|[^{SPACES}]+")
WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
#: Entries of the memo of one worker, in two generations.
MEMO = 800_000


class _Young(dict):
    """Keys learnt since the last change of generations; others come from the old ones or are learnt when they are asked for."""

    def __init__(self, learn: Callable, old: dict):
        self.learn, self.old = learn, old

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.learn(key)
        self[key] = found
        return found


class Memo:
    """What has been learnt about frequent keys, in two generations: a full young one becomes the old one.

    A worker serves one stage after the other and keeps the entries of one memo at a time, that in use.
    """

    in_use: Memo | None = None

    def __init__(self, learn: Callable, limit: int):
        self.learn, self.limit = learn, limit // 2
        self.forget()

    def forget(self) -> None:
        self.young = _Young(self.learn, {})

    def lookup(self) -> Callable:
        """What is known of a key, or is learnt now; to be asked for again before the next texts."""
        if Memo.in_use is not self:
            release()
            Memo.in_use = self
        if len(self.young) > self.limit:
            self.young.old = {}
            self.young = _Young(self.learn, dict(self.young))
        return self.young.__getitem__


def release() -> None:
    """Drop what a stage before has left in this worker's memo."""
    if Memo.in_use is not None:
        Memo.in_use.forget()
        Memo.in_use = None
        shed()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that hands free memory back to the system; nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def shed() -> None:
    """Hand back what the allocators of this worker hold beyond what is in use."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, in a worker that hands free memory back after every batch.

    Workers wait between tasks and serve stage after stage; what the largest texts took would else stay with each of them.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            shed()

    return task


#: The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _SHOWN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class ChunkEncoder:
    """Ids of whole texts as little-endian bytes.

    ``spaced`` is false for tokenizers that drop white space and fold case. Plain words, which no step before the model splits or
    changes but for that, go to the library's model at once; other chunks, and texts that hold a special token's opening, go
    through all of the library.
    """

    def __init__(self, path: str, spaced: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.split = (SPACED if spaced else BARE).findall
        self.memo = Memo(self._encode_chunk, memo)

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunk(self, chunk: str) -> bytes:
        if not WORD(chunk):
            return self._batch([chunk])[0]
        word = (chunk if self.spaced else chunk.lower()).encode().decode("latin-1").translate(BYTE_LEVEL)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        get = self.memo.lookup()
        return [self._batch([text])[0] if "<|" in text else b"".join(map(get, self.split(text))) for text in texts]


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool, memo: int = MEMO) -> ChunkEncoder:
    return ChunkEncoder(path, spaced, memo)


def in_slices(texts: list[str], most: int = 4_000_000) -> list[slice]:
    """Neighbouring texts in slices of about ``most`` characters, so that one long text stands alone."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            out.append(slice(start, i))
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out
