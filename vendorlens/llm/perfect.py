"""Minimal perfect hashing of 64-bit keys with numpy: bit arrays in levels, each as long as twice the keys that are left.

A key sets the bit that its hash of the level names; where several keys meet, the bit stays clear and they go on to the next level. The number of a
key is the rank of its bit among all set bits. About 4 bits a key, and 1 for the ranks.
"""

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    """A mixing of 64 bits that depends on the level."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(level + 1) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """``bits``: all levels, one after another, as 64-bit words; ``starts``: the first word of each level, and the end; ``ranks``: set bits before each word."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray):
        self.bits, self.starts = bits, starts
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """Of distinct keys."""
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
            words = (2 * len(left) + 63) // 64
            at = _hash(left, len(levels)) % np.uint64(64 * words)
            met = np.bincount(at.astype(np.int64), minlength=64 * words)
            levels.append(np.packbits(met == 1, bitorder="little").view("<u8"))
            left = left[met[at.astype(np.int64)] > 1]
        return cls(np.concatenate([*levels, np.zeros(0, "<u8")]), np.cumsum([0, *map(len, levels)]))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not built in has any number, or -1."""
        keys = np.asarray(keys, np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (low, high) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist())):
            at = _hash(keys[open_], level) % np.uint64(64 * (high - low))
            word, bit = low + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = (self.ranks[word] + np.bitwise_count(below))[found]
            open_ = open_[~found]
        return out

    def packed(self) -> tuple[bytes, bytes]:
        return self.bits.astype("<u8").tobytes(), np.asarray(self.starts, "<i8").tobytes()

    @classmethod
    def unpacked(cls, bits: bytes, starts: bytes) -> "PerfectHash":
        return cls(np.frombuffer(bits, "<u8"), np.frombuffer(starts, "<i8"))
