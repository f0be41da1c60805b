"""Minimal perfect hash functions over 96-bit keys, one for each shard, as arrays.

Every level is a bit array of about one bit a key: keys that fall alone on a bit of it take that bit, the others go on to
the next level. The number of a key is the number of bits set before its own, so that n keys have the numbers 0 to
n - 1, in some three bits a key, and all steps are array operations.
"""

from __future__ import annotations

import numpy as np

#: Levels before what is left (none, in all likelihood) is kept as a sorted list.
MAX_LEVELS = 48


def mixed(k0: np.ndarray, k1: np.ndarray, level: int) -> np.ndarray:
    """64 bits of each key (uint64, uint32), others at each level."""
    with np.errstate(over="ignore"):
        x = k0 ^ (k1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """levels: bit arrays as 64-bit words; left: keys beyond the last level, sorted by (k0, k1)."""

    def __init__(self, levels: list[np.ndarray], left0: np.ndarray, left1: np.ndarray):
        self.sizes = [len(w) * 64 for w in levels]
        self.words = np.concatenate([*levels, np.zeros(0, np.uint64)])
        self.left0, self.left1 = left0, left1
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    @classmethod
    def build(cls, k0: np.ndarray, k1: np.ndarray) -> PerfectHash:
        """Over distinct keys."""
        levels = []
        for level in range(MAX_LEVELS):
            if not len(k0):
                break
            bits = (len(k0) + 63) // 64 * 64
            at = mixed(k0, k1, level) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at.astype(np.int64)]
            k0, k1 = k0[rest], k1[rest]
        order = np.lexsort((k1, k0))
        return cls(levels, k0[order], k1[order])

    def __call__(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Numbers of the keys; a key that was not built in has -1 or the number of another."""
        out = np.full(len(k0), -1, np.int64)
        rows, offset = np.arange(len(k0)), 0
        for level, bits in enumerate(self.sizes):
            if not len(rows):
                return out
            at = (mixed(k0[rows], k1[rows], level) % np.uint64(bits)).astype(np.int64) + offset
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[rows[hit]] = self.before[at[hit] >> 6] + below
            rows, offset = rows[~hit], offset + bits
        for row in rows if len(self.left0) else ():
            lo = np.searchsorted(self.left0, k0[row])
            while lo < len(self.left0) and self.left0[lo] == k0[row]:
                if self.left1[lo] == k1[row]:
                    out[row] = self.before[-1] + lo
                lo += 1
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *(b // 64 for b in self.sizes), len(self.left0)], "<u8")
        return head.tobytes() + self.words.tobytes() + self.left0.tobytes() + self.left1.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        levels = int(np.frombuffer(raw, "<u8", 1)[0])
        words, left = np.split(np.frombuffer(raw, "<u8", levels + 1, 8).astype(np.int64), [levels])
        total, left = int(words.sum()), int(left[0])
        body = np.frombuffer(raw, "<u8", total + left, 8 * (levels + 2))
        each = np.split(body[:total], np.cumsum(words)[:-1]) if levels else []
        return cls(each, body[total:], np.frombuffer(raw, "<u4", left, 8 * (levels + 2 + total + left)))
