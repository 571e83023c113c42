"""Word positions and hashes of whole texts, vectorised over Arrow buffers.

A chunk is a run of whole documents of about ``CHUNK_BYTES`` of UTF-8; one longer document
is a chunk of its own.  Hashes are 64-bit: a word's eight-byte lanes go one after the other
through a mixer that permutes all 64-bit values (words of up to eight bytes and one length never
collide), words beyond ``LONG_WORD`` bytes through a cryptographic digest; windows of words
by joining hashes of half as many, mixed each time.  Equal words have equal hashes in every task.  No
sum of powers is involved, so patterns of few letters are as far apart as any others: a pair of
different words shares a hash with a chance of 2**-64, or 2**-64 for each of their lanes.

Edge cases: null and empty texts are documents without words; a text of any length is one
document, whose arrays take some 40 bytes a byte; an empty batch has no chunk.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: Longer words are hashed by a digest.
LONG_WORD = 256
_LENGTH, _LEFT, _STEP = U64(0xA24BAED4963EE407), U64(0x9E3779B97F4A7C55), U64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a lane that reaches beyond a word's end the bytes that belong to it.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift, multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


#: Which bytes of UTF-8 belong to words.
WS_WORD = np.ones(256, bool)
WS_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Chunk:
    """Whole documents: ``data`` bytes, ``offsets`` of documents, ``rows`` of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row, self.n = data, offsets, first_row, len(offsets) - 1

    def words(self, is_word: np.ndarray = WS_WORD) -> Chunk:
        """Sets starts, ends (bytes, exclusive) of words and word_off, the first word of each document."""
        n = len(self.data)
        m = np.zeros(n + 2, bool)
        m[1:-1] = is_word[self.data]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        start, end = m[1:-1] & ~m[:-2], m[1:-1] & ~m[2:]
        start[cut] = m[1:-1][cut]
        end[cut - 1] = m[1:-1][cut - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.word_off = np.searchsorted(self.starts, self.offsets)
        return self

    def word_hashes(self, lower: bool) -> np.ndarray:
        """64-bit hash of each word's bytes; ``lower`` maps A-Z to a-z."""
        size = self.ends - self.starts
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _LOWER[self.data] if lower else self.data
        lanes = np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))
        h = mix(size.astype(U64) * _LENGTH)
        far = size > LONG_WORD
        todo, at = (np.flatnonzero(~far), 0) if far.any() else (slice(None), 0)
        while len(left := size[todo] - at):
            h[todo] = mix(h[todo] ^ (lanes[self.starts[todo] + at] & _MASKS[np.minimum(left, 8)]))
            at += 8
            todo = np.flatnonzero((size > at) & ~far) if at == 8 else todo[left > 8]
        for i in np.flatnonzero(far).tolist():
            digest = hashlib.blake2b(data[self.starts[i] : self.ends[i]], digest_size=8).digest()
            h[i] = int.from_bytes(digest, "little")
        return h

    def bytes_of(self, doc: int) -> bytes:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes()


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; entry i covers i to i + n - 1."""
    if len(h) < n:
        return np.empty(0, U64)
    width = 1
    while width < n:  # windows of the width and of step more share all but their ends
        step = min(width, n - width)
        h = mix(h[:-step] * _LEFT + mix(h[step:] ^ _STEP))
        width += step
    return mix(h + U64(n))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column


def column_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string column; nulls are empty documents."""
    column = text_array(column)
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n, i + 50_000)
        yield Chunk(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def release() -> None:
    """Gives freed memory back to the system: a worker lives on idle after its task, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def batch_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for b in batches:
        for c in column_chunks(b.column(column), size):
            yield b.slice(c.first_row, c.n), c
            c = None  # the last chunk of a task is not held while it is idle
    b = None
    release()


def doc_of_words(c: Chunk) -> np.ndarray:
    """Document ordinal of each word."""
    return np.repeat(np.arange(c.n), np.diff(c.word_off))


def windows_inside(c: Chunk, n: int) -> np.ndarray:
    """Whether the window of n words that starts at each word ends in the same document."""
    left = np.repeat(c.word_off[1:], np.diff(c.word_off)) - np.arange(len(c.starts))
    return left >= n


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, ..., start + count - 1."""
    if not len(counts) or not counts.sum():
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
