"""Vectorised word splitting and hashing of many texts at once.

Texts are joined as UTF-8 into one byte array, each followed by a space, so
word boundaries, word hashes and windows come from a few numpy passes over
the bytes instead of Python loops over words. A-Z is lower-cased; all other
characters are kept as they are.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# After lower-casing: digits, a-z and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True
# Everything but space and the controls 9-13.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = False
NONSPACE[9:14] = False

_R = np.random.default_rng(20240607)
BYTE_CODE = _R.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = U64(0x9E3779B97F4A7C15)
POSITION_CODE = _R.integers(0, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, STEP, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def chunks(texts, max_bytes: int = 2_000_000):
    """Cut a list of texts into runs of about ``max_bytes`` UTF-8 bytes: (first index, list of bytes).

    A text is never split; one larger than the bound forms its own run. None counts as empty.
    """
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if part and size + len(b) > max_bytes:
            yield start, part
            start, size, part = i, 0, []
        part.append(b)
        size += len(b) + 1
    if part:
        yield start, part


class Words:
    """The words of a run of texts.

    ``start``/``end``: byte positions in ``raw``; ``hash``: 64-bit word
    hashes; ``first``: for each text the index of its first word, plus the
    total at the end.
    """

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        self.raw = b" ".join(texts) + b" "
        buf = LOWER[np.frombuffer(self.raw, dtype=np.uint8)]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        inside = word_bytes[buf]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.buf = buf
        length = self.end - self.start
        if len(length) == 0:
            self.hash = np.empty(0, dtype=np.uint64)
            return
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
        codes = BYTE_CODE[buf[inside]] * _powers(int(length.max()))[place]
        self.hash = mix(np.add.reduceat(codes, at) + length.astype(np.uint64) * STEP)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def windows(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (over text borders too; the caller masks those)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(m, U64(n), dtype=np.uint64)
    step = U64(0xD6E8FEB86659FD93)
    for k in range(n):
        out = out * step + word_hash[k:k + m]
    return mix(out)
