"""Words, lines and n-grams of whole Arrow text columns as numpy arrays.

A text is a run of bytes in the column's buffer. White space is the six ASCII
characters of ``[\\x20\\x09-\\x0D]``; none of them occurs inside a multi-byte
character, so words can be cut on bytes. Nothing here shortens a text: a column
is only cut between texts, to bound the memory of the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def cut(column: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``most_bytes`` each (a longer text is a run of its own), with their first row."""
    column = pc.fill_null(column, "")
    lengths = np.asarray(pc.binary_length(column), np.int64)
    piece = (np.cumsum(lengths) - lengths) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(column)] if len(column) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield a, column.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one more entry for the end)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    starts: np.ndarray  # byte where each word begins
    stops: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry for the end
    hashes: np.ndarray  # uint64

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows, and how many each text has; windows do not cross texts."""
        return windows(self.hashes, self.first, n)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    held = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][held], offsets[1:][held] - 1
    begins[heads], ends[tails] = inside[heads], inside[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths = stops - starts
    if not len(starts):
        return Words(starts, stops, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    place = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64), dtype=np.uint64)
    at = np.arange(int(lengths.sum())) - np.repeat(place, lengths)
    hashes = mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[at], place))
    return Words(starts, stops, np.searchsorted(starts, offsets), hashes)


def windows(items: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring items that lie in one text, and their number for each text."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    if n == 1:
        return items, counts
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    begin = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    found = np.zeros(len(begin), np.uint64)
    for k in range(n):
        found = found * np.uint64(0xD6E8FEB86659FD93) + items[begin + k]
    return mix(found + np.uint64(n)), counts


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``counts`` of them for each text; each sum depends on its own values only."""
    out = np.zeros(len(counts), values.dtype if values.dtype != bool else np.int64)
    held = counts > 0
    if held.any():
        out[held] = np.add.reduceat(values, (np.cumsum(counts) - counts)[held], dtype=out.dtype)
    return out
