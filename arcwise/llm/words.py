"""Words of many texts at once, as numpy arrays over Arrow's own bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What separates words, for Spark's own functions.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            more = min(k, max(n - k, 1 << 16))
            self.up = np.concatenate([self.up, self.up[:more] * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down[:more] * _U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)
_BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """The words of some consecutive texts: byte bounds, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one entry for each text and one more

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _BYTE_POWERS.take(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.take(_BYTE_VALUES, self.data, out=sums[1:])
        sums[1:] *= up[:-1]
        np.cumsum(sums[1:], out=sums[1:])
        return _mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``size`` words of one text, and a hash of each."""
        if len(hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.take(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text[: len(hashes) - size + 1] == text[size - 1 :])
        return at, _mix((sums[at + size] - sums[at]) * down[at] + _U(size))


def find_words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACE) -> Words:
    """Words of the texts that lie in ``data`` between consecutive ``bounds``; ``between`` marks the bytes that separate words."""
    space = between[data]
    solid = ~space
    opens = solid.copy()
    opens[1:] &= space[:-1]
    inner = bounds[:-1][(bounds[:-1] < len(data)) & (np.diff(bounds) > 0)]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= space[1:]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    closes[last] = solid[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def in_units(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text (a longer text is one
    of its own), with the text's bytes and bounds. The text is the column ``text``."""
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to
