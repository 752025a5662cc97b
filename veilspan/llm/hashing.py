"""Hashes of words and of byte strings, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", BASE), ("down", INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer with good high and low bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Batch:
    """The texts' bytes in one array, a space after each; and their words."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        self.n = len(texts)
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if fold:
            self.buf = FOLD[self.buf]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the text) of every word, in order."""
        space = SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        up, down = powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(VALUES[self.buf] * up[:-1], out=total[1:])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h), np.searchsorted(self.starts, start, "right") - 1
