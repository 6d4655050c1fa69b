"""A minimal perfect hash over pairs of 64-bit lanes, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mix64

_ODD = 0x9E3779B97F4A7C15
#: Places of a level for each key that is left, and levels at most.
ROOM, MOST = 2, 48


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = (level + 1) * _ODD % 2**64
    return (mix64(mix64(a + np.uint64(seed)) ^ (b + np.uint64(seed ^ _ODD))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys.

    Each level throws the keys that are left at about twice as many places; those that are alone at theirs stay, the others
    go on to the next level. A slot is the rank of a key's place among all that are taken. A slot remembers its key, so that
    ``slots`` tells a key that isn't in the table (-1) from one that is. Keys that no level parts are listed apart.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        n = len(a)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = np.arange(n), 0
        while len(left) and len(self.levels) < MOST:
            size = max(2, ROOM * len(left))
            at = _places(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.rest = {(x, y): taken + k for k, (x, y) in enumerate(zip(a[left].tolist(), b[left].tolist()))}
        self.a, self.b = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        to = self._raw(a, b)
        self.a[to], self.b[to] = a, b

    def _raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for k, (alone, rank) in enumerate(self.levels):
            at = _places(a[left], b[left], k, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        for k in left if self.rest else ():
            out[k] = self.rest.get((int(a[k]), int(b[k])), -1)
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where the key that the slot remembers is another one."""
        out = self._raw(a, b)
        if not len(self.a):
            return out
        return np.where((out >= 0) & (self.a[out] == a) & (self.b[out] == b), out, -1)
