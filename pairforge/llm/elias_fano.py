"""Elias-Fano coding of non-decreasing integers, and a two-level n-gram trie on it.

A sequence of n values below u takes about 2 + log2(u / n) bits a value: the
low bits are packed, the high bits are unary counts in a bit vector. Every
``STEP``-th value's place in that vector is stored, so any block is decoded
alone; searches touch the blocks that can hold the answer only.
"""

from __future__ import annotations

import struct
import tempfile

import numpy as np

STEP = 4096
U64 = np.uint64


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    out = []
    for i in range(0, len(values), 65536):  # a multiple of 8 values fills whole bytes
        be = values[i:i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(be, axis=1)[:, 64 - bits:].reshape(-1)).tobytes())
    return b"".join(out)


def _unpack(data: np.ndarray, bits: int, start: int, count: int) -> np.ndarray:
    if not bits or not count:
        return np.zeros(count, np.uint64)
    a, b = start * bits, (start + count) * bits
    flat = np.unpackbits(data[a // 8:(b + 7) // 8])[a % 8:a % 8 + count * bits].reshape(count, bits)
    full = np.zeros((count, 64), np.uint8)
    full[:, 64 - bits:] = flat
    return np.packbits(full, axis=1).view(">u8").reshape(-1).astype(np.uint64)


class EliasFano:
    """Read access to a coded sequence in a byte buffer (also a memory map)."""

    def __init__(self, data: np.ndarray):
        self.n, self.bits, lows, highs = struct.unpack("<QQQQ", data[:32].tobytes())
        at = 32
        marks = -(-self.n // STEP)
        self.places = np.frombuffer(data[at:at + 8 * marks].tobytes(), "<u8")
        self.firsts = np.frombuffer(data[at + 8 * marks:at + 16 * marks].tobytes(), "<u8")
        at += 16 * marks
        self.low, self.high = data[at:at + lows], data[at + lows:at + lows + highs]
        self.size = at + lows + highs

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        values = values.astype(np.uint64)
        bits = min(63, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
        place = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[place] = 1
        high = np.packbits(high).tobytes()
        low = _pack(values & U64((1 << bits) - 1), bits)
        return (struct.pack("<QQQQ", n, bits, len(low), len(high)) + place[::STEP].astype("<u8").tobytes()
                + values[::STEP].astype("<u8").tobytes() + low + high)

    def block(self, b: int) -> np.ndarray:
        """Values ``b * STEP`` up to the next block."""
        start, count = b * STEP, min(STEP, self.n - b * STEP)
        place = int(self.places[b])
        end = int(self.places[b + 1]) if b + 1 < len(self.places) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[place // 8:(end + 7) // 8])) + place // 8 * 8
        ones = ones[ones >= place][:count]
        high = (ones - np.arange(start, start + count)).astype(np.uint64)
        return (high << U64(self.bits)) | _unpack(self.low, self.bits, start, count)

    def all(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.places))] or [np.empty(0, np.uint64)])

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending queries: index of the first value at or above each (n if none), and that value."""
        at, value = np.full(len(queries), self.n, np.int64), np.zeros(len(queries), np.uint64)
        # Block in which the successor lies, or the one before the block that starts with it.
        home = np.maximum(np.searchsorted(self.firsts, queries, side="left") - 1, 0)
        for b in np.unique(home) if self.n else ():
            lo, hi = np.searchsorted(home, [b, b + 1])
            own = self.block(int(b))
            i = np.searchsorted(own, queries[lo:hi])
            inside = i < len(own)
            at[lo:hi] = b * STEP + i
            value[lo:hi] = own[np.minimum(i, len(own) - 1)]
            if not inside.all() and b + 1 < len(self.firsts):
                value[lo:hi][~inside] = self.firsts[b + 1]
        return at, value


def pack_ascending(values: np.ndarray) -> bytes:
    """Any non-decreasing 64-bit integers: the first one, then the differences from it."""
    first = int(values[0]) if len(values) else 0
    return struct.pack("<Q", first) + EliasFano.encode(values - U64(first), int(values[-1]) - first + 1 if len(values) else 1)


def unpack_ascending(data: bytes) -> np.ndarray:
    return EliasFano(np.frombuffer(data, np.uint8)[8:]).all() + U64(struct.unpack("<Q", data[:8])[0])


def pack_small(values: np.ndarray, limit: int) -> bytes:
    """Integers below ``limit`` in as many bits as the limit needs."""
    bits = max(1, (limit - 1).bit_length())
    return bytes([bits]) + _pack(values, bits)


def unpack_small(data: bytes, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)[1:]
    out = [_unpack(raw, data[0], i, min(65536, count - i)) for i in range(0, count, 65536)]
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


SUCCESSOR_BITS = 24
LEVELS = 65_535
FLOOR = -24.0


def quantise(log10p: np.ndarray) -> np.ndarray:
    """16-bit codes of log10 probabilities from ``FLOOR`` to 0."""
    return np.round((np.clip(log10p, FLOOR, 0) - FLOOR) / -FLOOR * LEVELS).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / LEVELS * -FLOOR + FLOOR


class Trie:
    """Contexts, pointers to their successors, successors relative to their context, quantised probabilities.

    Built from ascending keys (context code << 24 | successor code) and log10
    probabilities; the levels are one byte string, memory-mapped from an
    unlinked temporary file while it is queried.
    """

    @staticmethod
    def build(keys: np.ndarray, log10p: np.ndarray) -> bytes:
        ctx = keys >> U64(SUCCESSOR_BITS)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(keys) else np.empty(0, np.int64)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))).astype(np.uint64)
        rel = (rank << U64(SUCCESSOR_BITS)) | (keys & U64((1 << SUCCESSOR_BITS) - 1))
        parts = [EliasFano.encode(ctx[first], 1 << 24), EliasFano.encode(np.append(first, len(keys)), len(keys) + 1),
                 EliasFano.encode(rel, max(1, len(first)) << SUCCESSOR_BITS), quantise(log10p).tobytes()]
        return struct.pack("<QQQQ", *map(len, parts)) + b"".join(parts)

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        self.map = np.memmap(self.file, np.uint8, "r")
        a, b, c, d = struct.unpack("<QQQQ", self.map[:32].tobytes())
        self.contexts, self.pointers = EliasFano(self.map[32:32 + a]), EliasFano(self.map[32 + a:32 + a + b])
        self.successors = EliasFano(self.map[32 + a + b:32 + a + b + c])
        self.codes = self.map[32 + a + b + c:32 + a + b + c + d].view("<u2")

    def close(self) -> None:
        self.map = self.codes = self.contexts = self.pointers = self.successors = None
        self.file.close()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending keys: whether the n-gram is stored, and its log10 probability (0 where not)."""
        ctx = keys >> U64(SUCCESSOR_BITS)
        rank, value = self.contexts.successor(ctx)
        known = (rank < self.contexts.n) & (value == ctx)
        # The search goes on inside the context's own range only.
        rel = (rank[known].astype(np.uint64) << U64(SUCCESSOR_BITS)) | (keys[known] & U64((1 << SUCCESSOR_BITS) - 1))
        at, got = self.successors.successor(rel)
        ends = self.pointers.all()
        r = rank[known]
        hit = (at < self.successors.n) & (got == rel) & (at >= ends[r].astype(np.int64)) & (at < ends[r + 1].astype(np.int64))
        found, p = np.zeros(len(keys), bool), np.zeros(len(keys))
        where = np.flatnonzero(known)[hit]
        found[where] = True
        p[where] = restore(np.asarray(self.codes[at[hit]]))
        return found, p
