"""Words and rolling word k-gram hashes of many texts at once, as numpy arrays.

A word is a run of bytes 0-9, a-z or any non-ASCII character, after
lower-casing.  Hashes are Karp-Rabin polynomials modulo 2**64 over a fixed
random byte table; whoever joins on them also compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 22
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE, GRAM_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of ``texts``: bytes, start, end, text number and hash of each."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        inside = IS_WORD[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.r_[0, edge] if len(buf) and inside[0] else edge
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.n) - self.n
        size = self.end - self.start
        if len(size):
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            self.hash = mix(np.add.reduceat(
                BYTES[buf[inside]] * powers(BASE, int(size.max()))[place], at))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of all k-grams inside one text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = np.zeros(m, np.uint64)
        for j, p in enumerate(powers(GRAM_BASE, k)):
            g += self.hash[j:j + m] * p
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1:])
        return mix(g[at]), at

    def gram(self, i: int, k: int) -> str:
        return b" ".join(self.raw[a:b] for a, b in zip(self.start[i:i + k].tolist(), self.end[i:i + k].tolist())
                         ).decode("utf-8", "replace")


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Membership:
    """A bitmap over hashes: false for nearly all hashes that are not in it.

    Its size is fixed (``1 << bits``), so it can be sent to every task however
    large the other side of the join is; the join itself comes after it.
    """

    def __init__(self, bits: int, packed: bytes | None = None):
        self.bits = bits
        self.packed = np.zeros(1 << bits - 3, np.uint8) if packed is None else np.frombuffer(packed, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return self.packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0
