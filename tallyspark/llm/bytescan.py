"""Vectorised scans of UTF-8 text columns: words, lines and their 64-bit hashes.

All functions work on the value buffer of an Arrow string column, so no Python object is made per
word. White space is the bytes 0x20 and 0x09-0x0D; these never occur inside a multi-byte character.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: Bytes of text that are scanned at once; a longer single text is scanned alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of rolling hashes, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, U64)
            steps[0] = U64(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], offsets - first


@dataclass
class Scan:
    """Some whole texts: rows first..last of a column."""

    first: int
    last: int
    raw: np.ndarray
    offsets: np.ndarray
    lower: bool = False

    def __post_init__(self) -> None:
        if self.lower:
            upper = (self.raw >= 65) & (self.raw <= 90)
            self.raw = self.raw + (upper * np.uint8(32))
        raw, n = self.raw, len(self.raw)
        inside = ~SPACE[raw]
        self.inside = inside
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[self.offsets] = False
        #: Byte positions of the words, and the index of each text's first word.
        self.starts = np.flatnonzero(inside & ~before[:n])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self._prefix = None

    @property
    def rows(self) -> int:
        return self.last - self.first

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.raw)
            power, _ = powers(n + 1)
            sums = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.raw] * power[:n], out=sums[1:])
            self._prefix = sums
        return self._prefix

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, the same wherever they stand."""
        sums = self.prefix()
        _, inverse = powers(len(self.raw) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def owner(self, bounds: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(bounds))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the \\n-split lines, and the index of each text's first line."""
        breaks = np.flatnonzero(self.raw == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        # a text starts at its offset; a break at a text's last byte opens an empty line there
        owner = np.concatenate([np.arange(self.rows), np.searchsorted(self.offsets, breaks, "right") - 1])
        order = np.lexsort((np.concatenate([self.offsets[:-1], breaks + 1]), owner))
        starts = np.concatenate([self.offsets[:-1], breaks + 1])[order]
        owner = owner[order]
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        tail = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
        ends[tail] = self.offsets[1:][owner[tail]]
        return starts, ends, np.searchsorted(owner, np.arange(self.rows + 1))


def scans(column, lower: bool = False) -> Iterator[Scan]:
    """The column's texts in groups of about CHUNK bytes."""
    raw, offsets = text_buffer(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Scan(first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower)
        first = last


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, their first words, and each text's bounds among them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    edges = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], counts) + np.repeat(bounds[:-1], counts)
    out = np.zeros(len(at), U64)
    for k in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[at + k]
    return mix(out), at, edges


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over keys: those that occur twice or more, and those equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order], later[order] = twice, same
    return many, later
