"""Range asymmetric numeral system for token ids, on whole arrays.

A block is coded on its own by ``lanes`` interleaved coders with one shared,
static frequency table (frequencies sum to 2**20). States are 64 bits wide and
give off 32 bits at a time. Symbol i belongs to lane i mod lanes.

Layout of a block, little-endian: magic ``SLR1``; number of symbols, lanes,
steps between checkpoints and number of 32-bit words (u32 each); CRC-32 of the
symbols as u32 and of everything after this field (u32 each); for each
checkpoint its offset into the words (u32) and the state of every lane (u64);
the words. The first checkpoint is the start; decoding may begin at any of them.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"SLR1"
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
HEADER = "<4sIIIIII"


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**20; every symbol that occurs has at least one."""
    counts = np.asarray(counts, np.float64)
    total, scale = counts.sum(), 1 << SCALE_BITS
    used = counts > 0
    if not used.any():
        return np.zeros(len(counts), np.uint32)
    if used.sum() > scale:
        raise ValueError("more symbols than the table has places")
    freq = np.where(used, np.maximum(np.floor(counts / total * (scale - used.sum())), 1), 0).astype(np.int64)
    spare = scale - int(freq.sum())
    if spare > 0:
        freq[int(counts.argmax())] += spare
    while spare < 0:
        over = np.flatnonzero(freq > 1)
        cut = over[np.argsort(-freq[over], kind="stable")][:-spare]
        freq[cut] -= 1
        spare = scale - int(freq.sum())
    return freq.astype(np.uint32)


class Table:
    """Frequencies, their running sums, and the symbol at each of the 2**20 places."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def crc_of(symbols: np.ndarray) -> int:
    return zlib.crc32(np.asarray(symbols).astype("<u4").tobytes())


def encode_block(symbols: np.ndarray, table: Table, lanes: int = 1024, every: int = 128) -> bytes:
    n = len(symbols)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, renew = np.uint64(SCALE_BITS), np.uint64(32)
    words: list[np.ndarray] = []
    states: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        part = symbols[step * lanes : (step + 1) * lanes]
        freq, start = table.freq[part], table.start[part]
        x = state[: len(part)]
        full = x >= freq << np.uint64(63 - SCALE_BITS)
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> renew, x)
        state[: len(part)] = ((x // freq) << bits) + x % freq + start
        if step % every == 0:
            states.append((step, state.copy()))
    words.reverse()
    sizes = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    stream = np.concatenate(words).astype("<u4") if words else np.empty(0, "<u4")
    body = b"".join(
        struct.pack("<I", int(offsets[step])) + held.astype("<u8").tobytes() for step, held in reversed(states)
    ) + stream.tobytes()
    return struct.pack(HEADER, MAGIC, n, lanes, every, len(stream), crc_of(symbols), zlib.crc32(body)) + body


def decode_block(blob: bytes, table: Table, first: int = 0) -> np.ndarray:
    """Symbols from checkpoint ``first`` on; all of them, checked by their CRC, if it is 0."""
    magic, n, lanes, every, n_words, crc, body_crc = struct.unpack_from(HEADER, blob)
    body = memoryview(blob)[struct.calcsize(HEADER) :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    if not n:
        return np.empty(0, np.uint32)
    steps = -(-n // lanes)
    checkpoints = -(-steps // every)
    width = 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, checkpoints * width)
    at = int(np.frombuffer(body, "<u4", 1, first * width)[0])
    state = np.frombuffer(body, "<u8", lanes, first * width + 4).astype(np.uint64)
    begin = first * every * lanes
    out = np.empty(n - begin, np.uint32)
    mask, bits, renew = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for step in range(first * every, steps):
        size = min(lanes, n - step * lanes)
        x = state[:size]
        place = x & mask
        symbol = table.symbol[place]
        out[step * lanes - begin : step * lanes - begin + size] = symbol
        x = table.freq[symbol] * (x >> bits) + place - table.start[symbol]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << renew) | words[at : at + len(need)]
        at += len(need)
        state[:size] = x
    if not first and crc_of(out) != crc:
        raise ValueError("damaged symbols")
    return out
