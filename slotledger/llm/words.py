"""Words of whole texts as arrays of hashes, for use inside tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D. They are hashed
with SipHash (64 bits, fixed key); everything above a word is arithmetic on
whole arrays, so the cost per word is a few dozen nanoseconds. Texts are taken
in chunks of bounded size; a single longer text is a chunk of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# The helpers travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 4 << 20


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def chunks(blobs: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` bytes, or one text."""
    start, size = 0, 0
    for at, blob in enumerate(blobs):
        if size and size + len(blob) > limit:
            yield start, at
            start, size = at, 0
        size += len(blob)
    if start < len(blobs):
        yield start, len(blobs)


class Words:
    """Words of some texts, one after the other."""

    def __init__(self, blobs: list[bytes], lower: bool = False):
        lists = [(b.lower() if lower else b).split() for b in blobs]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat: list[bytes] = list(chain.from_iterable(lists))
        self.lists = lists
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def hashes(self) -> np.ndarray:
        if not self.flat:
            return np.empty(0, np.uint64)
        return pd.util.hash_array(np.array(self.flat, dtype=object), categorize=False)

    def documents(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def fits(self, k: int) -> np.ndarray:
        """Whether ``k`` words of one text start at each of the first len - k + 1 words."""
        n = len(self.flat) - k + 1
        if n <= 0:
            return np.empty(0, bool)
        return np.arange(n) + k <= np.repeat(self.ends, self.counts)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on, put together from doubled lengths."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    out, length, power, size = None, 0, hashes, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = len(hashes) - length - size + 1
                out = _pair(out[:n], power[length : length + n])
            length += size
        rest >>= 1
        if rest:
            power = _pair(power[: len(power) - size], power[size:])
            size *= 2
    return out[: len(hashes) - k + 1]
