"""Vectorised splitting and hashing of Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D. Words get 64-bit hashes, windows of words hashes built from
those by doubling. Texts are worked on in chunks of about CHUNK bytes, so memory depends on the longest text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of terms (letters, digits, non-ASCII), lower-cased; all others part terms.
TERM = np.full(256, 32, np.uint8)
TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
TERM[65:91] = np.arange(97, 123)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _tables or len(_tables["up"]) < n:
        n = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair64(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Ordered combination of two hash arrays; lanes are independent."""
    odd = np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[lane])
    return mix64(a * odd + (b ^ np.uint64(lane)) + (b << np.uint64(7)))


@dataclass
class Words:
    data: np.ndarray  # bytes of the chunk
    starts: np.ndarray  # of each word
    ends: np.ndarray
    ptr: np.ndarray  # words of row r: ptr[r] to ptr[r + 1]
    offsets: np.ndarray  # bytes of row r
    hashes: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def word_chunks(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of chunk after chunk; null texts have no words.

    lower: A-Z count as a-z; table: bytes are first replaced by the table's.
    """
    table = _LOWER if lower else table
    offsets, raw = _buffers(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, hi, split_words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> Words:
    if table is not None:
        data = table[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), offsets, none.astype(np.uint64))
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets, hash_spans(data, starts, ends))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    n = len(data)
    up, down = _powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
    return mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of so many consecutive words, across rows too; callers mask those that cross a row's end."""
    done, built, width, level = None, 0, 1, hashes
    rest = size
    while rest:
        if rest & 1:
            if done is None:
                done, built = level, width
            else:
                m = len(hashes) - built - width + 1
                done = pair64(done[: max(m, 0)], level[built : built + max(m, 0)], lane)
                built += width
        rest >>= 1
        if rest:
            m = max(len(hashes) - 2 * width + 1, 0)
            level = pair64(level[:m], level[width : width + m], lane)
            width *= 2
    return done[: max(len(hashes) - size + 1, 0)]


def whole(ptr: np.ndarray, size: int) -> np.ndarray:
    """Which word positions start a window of that size within their row."""
    n = int(ptr[-1])
    fits = np.zeros(n + 1, np.int64)
    last = np.maximum(ptr[1:] - size + 1, ptr[:-1])
    np.add.at(fits, ptr[:-1], 1)
    np.add.at(fits, last, -1)
    return np.cumsum(fits[:n]) > 0


def minimizers(hashes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each start the leftmost of the span positions from there that has the least hash."""
    best = np.arange(len(hashes))
    width = 1
    while width < span and len(starts):
        step = min(width, span - width)
        m = max(len(hashes) - step, 0)
        left, right = best[:m], best[step:]
        best = np.concatenate([np.where(hashes[right] < hashes[left], right, left), best[m:]])
        width += step
    return best[starts]
