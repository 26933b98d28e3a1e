"""Vectorised word splitting and hashing over Arrow batches (numpy only).

A batch of texts is joined into one byte buffer and cut into words with array
operations, so no Python object is made per word. A word has two independent 64-bit
hashes, made of its bytes eight at a time by a chain of bijective mixers (not linear in the
bytes, so periodic words do not collide); words beyond LONG bytes are hashed by BLAKE2b. `h`
stands for a word where a chance collision only costs time; what has to be exact compares
`h` and `h2` (128 bits) or the bytes. Sequences of words are hashes of word hashes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def give_back() -> None:
    """Returns freed memory to the system. Workers are used again by later stages, where what one batch needed would stay beside theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit multiplicative hash; bijective."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_table(regex_class_excluded: str) -> np.ndarray:
    """Which bytes belong to a word; bytes from 0x80 up always do."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in regex_class_excluded]] = False
    return table


#: Words are runs of anything but blanks: [^\x20\x09-\x0D]+
BLANKS = " \t\n\x0b\x0c\r"
NON_BLANK = byte_table(BLANKS)
#: Words are runs of letters, digits and non-ASCII characters, after lower-casing A-Z:
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words longer than this many bytes are hashed by BLAKE2b.
LONG = 128
#: Bits of the first n bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SEEDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix_other(x: np.ndarray) -> np.ndarray:
    """A second bijective finalizer, with other shifts and factors than mix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(buf: bytes, start: np.ndarray, end: np.ndarray, pair: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two 64-bit hashes of each span of bytes; without `pair` only the first."""
    size = end - start
    mixers = [(mix64, _SEEDS[0]), (_mix_other, _SEEDS[1])][: 1 + pair]
    states = [mix(size.astype(np.uint64) * seed + seed) for mix, seed in mixers]
    if len(start):
        padded = buf + bytes(8)
        eight = np.ndarray((len(buf),), dtype="<u8", buffer=padded, strides=(1,))
        lane = eight[start] & _MASKS[np.minimum(size, 8)]
        states = [mix(h ^ (lane * seed)) for h, (mix, seed) in zip(states, mixers, strict=True)]
        j, todo = 8, np.flatnonzero((size > 8) & (size <= LONG))
        while len(todo):
            left = size[todo] - j
            lane = eight[start[todo] + j] & _MASKS[np.minimum(left, 8)]
            for h, (mix, seed) in zip(states, mixers, strict=True):
                h[todo] = mix(h[todo] ^ (lane * seed))
            j += 8
            todo = todo[left > 8]
        for i in np.flatnonzero(size > LONG).tolist():
            digest = np.frombuffer(hashlib.blake2b(memoryview(buf)[start[i] : end[i]], digest_size=16).digest(), dtype="<u8")
            for h, x in zip(states, digest, strict=False):
                h[i] = x
    return (states[0], states[1] if pair else None)


class Words:
    """Words of several texts: `start`, `end` (bytes in `buf`), `h` and `h2` (hashes; h2 only with `pair`), `first` (word index where
    each text begins)."""

    __slots__ = ("buf", "end", "first", "h", "h2", "offsets", "plain", "start")

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool = False, pair: bool = False):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=self.offsets[1:])
        joined = b"\n".join(texts) + b"\n"
        self.buf = b = np.frombuffer(joined, dtype=np.uint8)
        inside = table[b]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(b) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.plain = joined.translate(_FOLD) if lower else joined
        self.h, self.h2 = hash_spans(self.plain, self.start, self.end, pair)
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def same(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """Whether the bytes (lower-cased, if words are) of words i and the other's words j are equal."""
        size = self.end[i] - self.start[i]
        out = size == other.end[j] - other.start[j]
        a, b = (np.ndarray((len(w.buf),), dtype="<u8", buffer=w.plain + bytes(8), strides=(1,)) for w in (self, other))
        at, todo = 0, np.flatnonzero(out)
        while len(todo):
            left = size[todo] - at
            mask = _MASKS[np.minimum(left, 8)]
            equal = (a[self.start[i[todo]] + at] & mask) == (b[other.start[j[todo]] + at] & mask)
            out[todo[~equal]] = False
            at += 8
            todo = todo[equal & (left > 8)]
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (also across texts: callers cut)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    acc = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        acc *= np.uint64(0xA0761D6478BD642F)
        acc += h[j : len(h) - k + 1 + j]
    acc += np.uint64(k)
    return mix64(acc)


def shingles(words: np.ndarray, runs_k: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one text from its word hashes; a shorter text is one shingle, no word none."""
    if len(words) >= k:
        return np.unique(runs_k)
    return runs(words, len(words)) if len(words) else np.zeros(0, dtype=np.uint64)


class Texts:
    """UTF-8 bytes of a string column, made as they are asked for; null gives no bytes."""

    def __init__(self, column: pa.Array):
        self.column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
        self.sizes = pc.fill_null(pc.binary_length(self.column), 0).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at):
        if isinstance(at, slice):
            lo, hi, _ = at.indices(len(self))
            return [x or b"" for x in self.column.slice(lo, hi - lo).to_pylist()]
        return self.column[at].as_py() or b""


def texts_of(column: pa.Array) -> Texts:
    return Texts(column)


def chunks(texts: list[bytes] | Texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text stands alone."""
    lo, size = 0, 0
    for i, n in enumerate(texts.sizes.tolist() if isinstance(texts, Texts) else map(len, texts)):
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)
