"""Vectorised words of Arrow text columns: boundaries and 64-bit hashes, without a Python object a word.

A word is a maximal run of bytes outside {0x20, 0x09..0x0D}. Its hash takes eight bytes a round with the rounds of XXH64, for all words at once;
long words go to XXH64 itself. No arithmetic of the bytes' places is involved, so no rearrangement of equal parts cancels out.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SEGMENT = 1 << 20
#: Bytes of a word from which on XXH64 is called for it.
LONG = 160
SEED, OTHER_SEED = 0x5851F42D4C957F2D, 0x14057B7EF767814F
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
SYMBOL = np.zeros(256, np.int32)
SYMBOL[list(b"#*$%&|<>")] = 1


_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What a worker keeps between the tasks of one operator."""
    return _kept.setdefault(name, {})


def tidy(run: Callable, keeps: str = "") -> Callable:
    """A task's function that first drops what other operators kept in this worker, and gives memory back at its end."""

    @functools.wraps(run)
    def whole(*arguments):
        for name, held in _kept.items():
            if name != keeps:
                held.clear()
        try:
            yield from run(*arguments)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SEGMENT that end at a row's end or at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + SEGMENT)
        if to < end:
            row_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row_end > at + SEGMENT // 2:
                to = row_end
            else:
                row_end = int(offsets[np.searchsorted(offsets, to, "left")])
                while to < row_end:
                    near = np.flatnonzero(SPACE[data[to : min(row_end, to + 4096)]])
                    if len(near):
                        to += int(near[0])
                        break
                    to = min(row_end, to + 4096)
        yield at, to
        at = to


@dataclass
class Words:
    start: np.ndarray  # byte offset in the data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row, and the end: index of its first word
    check: np.ndarray | None = None  # a second hash, independent of the first

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(part: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Of byte ranges of one segment; also tells ranges of different length apart."""
    lanes = np.ndarray((len(part) + 1,), "<u8", np.concatenate((part, np.zeros(8, np.uint8))), strides=(1,))
    h = length.astype(np.uint64) * P5 + np.uint64(seed)
    live, rest, at = slice(None), length, start
    for k in range(LONG // 8):
        k1 = lanes[at] & LOW_BYTES[np.minimum(rest, 8)]
        h[live] = _rotated(h[live] ^ (_rotated(k1 * P2, 31) * P1), 27) * P1 + P4
        more = np.flatnonzero(rest > 8)
        if not len(more):
            break
        live = more if k == 0 else live[more]
        rest, at = rest[more] - 8, at[more] + 8
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(part[start[i] : start[i] + length[i]].tobytes(), seed)
    return h


def words(data: np.ndarray, offsets: np.ndarray, check: bool = False) -> Words:
    """Words of rows that lie one behind the other."""
    starts, ends, found, checks = [], [], [], []
    for at, to in segments(data, offsets):
        part = data[at:to]
        solid = ~SPACE[part]
        cut = np.zeros(to - at + 1, bool)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        cut[inside] = True
        cut[0] = cut[-1] = True
        s = np.flatnonzero(solid & (cut[:-1] | ~np.concatenate(([False], solid[:-1]))))
        e = np.flatnonzero(solid & (cut[1:] | ~np.concatenate((solid[1:], [False])))) + 1
        starts.append(s + at)
        ends.append(e + at)
        found.append(hashes(part, s, e - s))
        if check:
            checks.append(hashes(part, s, e - s, OTHER_SEED))
    if not starts:
        none, nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(none, none, nothing, np.zeros(len(offsets), np.int64), nothing if check else None)
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(found), np.searchsorted(start, offsets, "left"), np.concatenate(checks) if check else None)


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, start + length)."""
    begun = np.cumsum(np.bincount(start, minlength=n)[:n]) if n else np.zeros(0, np.int64)
    ended = np.zeros(n, np.int64)
    ended[length:] = begun[: max(0, n - length)]
    return begun > ended


def window_hash(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Of each `width` consecutive hashes, in their order; window i begins at place i."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt))
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
