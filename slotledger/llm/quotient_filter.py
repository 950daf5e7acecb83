"""Counting quotient filters of packed n-grams: sorted, compact, without loss.

An n-gram of word ids is packed into columns of ``per_column`` ids each, as wide as these
need, 64 bits at most. The first column is permuted within its width by a bijection that
depends on the others (``scatter``), so its leading bits spread evenly and the n-gram can
be got back (``gather``). A filter holds n-grams whose permuted first columns share their
leading ``range_bits``:

- the quotient, the next ``q`` bits, as one bit a slot: entry ``i`` sets bit
  ``quotient + i``, so the zeros between the bits tell the buckets apart;
- the remainder, all further bits, and the other columns, in as many bytes as they need;
- the count in a byte, and counts of 255 and more in a list of their own.

Entries are in order, so filters of one range are merged by one pass over sorted runs.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

from slotledger.llm.words import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADER = "<qiiq"
LARGE = 255
U = np.uint64


#: Odd factors of the permutation.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def permuted(x: np.ndarray, width: int) -> np.ndarray:
    """A bijection of the numbers below ``2**width``."""
    mask, half = U((1 << width) - 1), U((width + 1) // 2)
    for factor in FACTORS:
        x = ((x ^ (x >> half)) * U(factor)) & mask
    return x ^ (x >> half)


def restored(x: np.ndarray, width: int) -> np.ndarray:
    """``y`` with ``permuted(y, width) == x``: such a shift undoes itself, a factor has an inverse."""
    mask, half = U((1 << width) - 1), U((width + 1) // 2)
    for factor in FACTORS[::-1]:
        x = ((x ^ (x >> half)) * U(pow(factor, -1, 1 << 64))) & mask
    return x ^ (x >> half)


def _salt(others: np.ndarray) -> np.ndarray:
    """A number for each row that depends on all columns but the first."""
    salt = np.full(len(others), 0x9E3779B97F4A7C15, U)
    for column in others.T:
        salt = mix(salt ^ column)
    return salt


class Packing:
    """``k`` word ids below ``2**bits`` in as few 64-bit columns as hold them."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits = k, bits
        self.per_column = min(k, 64 // bits)
        self.columns = -(-k // self.per_column)
        self.width = self.per_column * bits  # of the first column

    def column_bytes(self) -> list[int]:
        """Bytes of each column after the first."""
        held = (min(self.per_column, self.k - i * self.per_column) for i in range(1, self.columns))
        return [-(-n * self.bits // 8) for n in held]

    def scatter(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Permuted keys (rows of columns) of the n-grams that start at ``starts``."""
        keys = np.zeros((len(starts), self.columns), U)
        for i in range(self.k):
            column = keys[:, i // self.per_column]
            column <<= U(self.bits)
            column |= words[starts + i].astype(U)
        salt = _salt(keys[:, 1:]) & U((1 << self.width) - 1)
        keys[:, 0] = permuted(keys[:, 0] ^ salt, self.width)
        return keys

    def gather(self, keys: np.ndarray) -> np.ndarray:
        """Word ids of permuted keys."""
        keys = keys.copy()
        salt = _salt(keys[:, 1:]) & U((1 << self.width) - 1)
        keys[:, 0] = restored(keys[:, 0], self.width) ^ salt
        words = np.empty((len(keys), self.k), np.int64)
        for i in range(self.k - 1, -1, -1):
            column = keys[:, i // self.per_column]
            words[:, i] = (column & U((1 << self.bits) - 1)).astype(np.int64)
            column >>= U(self.bits)
        return words


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    counts = np.ones(len(keys), np.int64) if counts is None else counts
    if not len(keys):
        return keys, counts
    first = keys[:, 0]
    # A stable sort merges runs that are already in order.
    order = np.argsort(first, kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    starts = np.flatnonzero(new)
    return keys[starts], np.add.reduceat(counts, starts)


def _low_bytes(column: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), 8)[:, :size]


def pack(keys: np.ndarray, counts: np.ndarray, range_bits: int, packing: Packing) -> bytes:
    """The filter of distinct keys in order, all of one range."""
    n = len(keys)
    wide = packing.width - range_bits
    remainder_bytes = min(8, max(1, -(-(wide - max(n - 1, 1).bit_length()) // 8)))
    q = max(0, wide - 8 * remainder_bytes)
    quotient = (keys[:, 0] >> U(8 * remainder_bytes)) & U((1 << q) - 1) if q else np.zeros(n, U)
    slots = np.zeros(n + (1 << q), bool)
    slots[quotient.astype(np.int64) + np.arange(n)] = True
    others = [_low_bytes(keys[:, i], size) for i, size in enumerate(packing.column_bytes(), 1)]
    large = counts >= LARGE
    return b"".join(
        [
            struct.pack(HEADER, n, q, remainder_bytes, int(large.sum())),
            np.packbits(slots).tobytes(),
            _low_bytes(keys[:, 0], remainder_bytes).tobytes(),
            *(column.tobytes() for column in others),
            np.minimum(counts, LARGE).astype(np.uint8).tobytes(),
            counts[large].astype(np.int64).tobytes(),
        ]
    )


def unpack(blob: bytes, part: int, range_bits: int, packing: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a filter of range ``part``."""
    n, q, remainder_bytes, n_large = struct.unpack_from(HEADER, blob)
    at = struct.calcsize(HEADER)

    def take(size: int, kind: type = np.uint8) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at - size)

    def column(size: int) -> np.ndarray:
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :size] = take(n * size).reshape(n, size)
        return whole.view(U)[:, 0]

    slots = np.unpackbits(take((n + (1 << q) + 7) // 8))
    quotient = (np.flatnonzero(slots) - np.arange(n)).astype(U)
    keys = np.empty((n, packing.columns), U)
    keys[:, 0] = column(remainder_bytes)
    if q:
        keys[:, 0] |= quotient << U(8 * remainder_bytes)
    if range_bits:
        # The top bits of the remainder's last byte may be those of the range already.
        keys[:, 0] |= U(part) << U(packing.width - range_bits)
    for i, size in enumerate(packing.column_bytes(), 1):
        keys[:, i] = column(size)
    counts = take(n).astype(np.int64)
    counts[counts == LARGE] = take(n_large * 8, np.int64)
    return keys, counts


def filters(
    keys: np.ndarray, counts: np.ndarray, range_bits: int, packing: Packing
) -> Iterator[tuple[int, bytes]]:
    """A filter for each range that occurs, of distinct keys in order."""
    if not len(keys):
        return
    range_bits = min(range_bits, packing.width)
    parts = keys[:, 0] >> U(packing.width - range_bits) if range_bits else np.zeros(len(keys), U)
    starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(parts[start]), pack(keys[start:stop], counts[start:stop], range_bits, packing)


def merged(
    blobs: list[bytes], part: int, range_bits: int, packing: Packing
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of filters of one range."""
    range_bits = min(range_bits, packing.width)
    keys, counts = zip(*(unpack(blob, part, range_bits, packing) for blob in blobs), strict=True)
    return summed(np.concatenate(keys), np.concatenate(counts))
