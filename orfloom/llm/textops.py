"""Vectorised word splitting and hashing over batches of whole texts.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  All of those are
ASCII, so splitting UTF-8 bytes gives the same words as splitting code points.
Texts are worked on in chunks of a few MB, so that memory is bounded by the
chunk (or by the one longest text) and not by the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once.
CHUNK_BYTES = 3 << 19
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """The words of a chunk of texts, in order."""

    buf: np.ndarray  # bytes of the chunk, a space between texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # 64-bit hash of each word
    bound: np.ndarray  # words of text d: bound[d] to bound[d + 1]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by one space."""
        return b" ".join(self.buf[self.start[a] : self.end[b - 1]].tobytes().split()) if a < b else b""


def chunks(texts, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) of consecutive chunks; null is empty."""
    first, got, held = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"")
        if got and held + len(b) > size:
            yield first, got
            first, got, held = i, [], 0
        got.append(b)
        held += len(b) + 1
    if got:
        yield first, got


def split_words(texts: list[bytes], lower: bool = False, seed: int = 0, space: np.ndarray = _SPACE) -> Words:
    """The words of the texts with their hashes; space says for each byte whether it separates words (0x20 must)."""
    raw = b" ".join(texts) + b" " * 16
    buf = np.frombuffer(raw, np.uint8)
    if lower:
        buf = _LOWER[buf]
    inside = ~space[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    bound = np.searchsorted(start, begins)
    bound[-1] = len(start)
    return Words(buf, start, end, word_hashes(buf, start, end, seed), bound)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each slice of the bytes; buf goes on for 16 bytes after the last."""
    n = (end - start).astype(np.int64)
    h = n.astype(np.uint64) * _M1 + np.uint64(seed)
    eight = np.ndarray((len(buf) - 8,), "<u8", buffer=buf.data, strides=(1,))
    todo, at, left = None, start, n
    for k in range(0, LONG_WORD, 8):
        if todo is not None or k:
            keep = np.flatnonzero(left > 8)
            todo = keep if todo is None else todo[keep]
            at, left = at[keep] + 8, left[keep] - 8
            if not len(todo):
                break
        v = eight[at] & _MASK[np.minimum(left, 8)]
        if todo is None:
            h = mix(h ^ v)
        else:
            h[todo] = mix((h[todo] + _M1) ^ v)
    raw = buf.data
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = np.uint64(xxhash.xxh64_intdigest(bytes(raw[start[i] : end[i]]), seed))
    return h


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n words that begin at each word, whether all n lie in one text)."""
    total = len(w.hash)
    h = np.zeros(total, np.uint64)
    if total >= n:
        g = w.hash[: total - n + 1].copy()
        for k in range(1, n):
            g = mix(g * _M1 + w.hash[k : total - n + 1 + k])
        h[: total - n + 1] = g
    ok = np.zeros(total, bool)
    for d in range(len(w.bound) - 1):
        a, b = w.bound[d], w.bound[d + 1]
        if b - a >= n:
            ok[a : b - n + 1] = True
    return h, ok


def whole_hash(h: np.ndarray) -> int:
    """Hash of a whole sequence that is shorter than a shingle."""
    return xxhash.xxh64_intdigest(h.tobytes(), len(h) + 1)


def lean(rows):
    """rows, with freed memory given back to the system when its task ends: workers wait idle between tasks."""

    def run(batches):
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to trim
            pass

    return run
