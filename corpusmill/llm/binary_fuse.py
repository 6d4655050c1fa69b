"""Static 3-wise binary fuse filters over 64-bit keys, built and probed with numpy."""

from __future__ import annotations

import math

import numpy as np

from .common import mix64


class BinaryFuse8:
    """A static set of 64-bit keys with one byte a slot: no false negatives, about 1/256 false positives.

    Each key owns three slots in three neighbouring segments; a slot array is solved so that the XOR of a key's slots is
    its fingerprint. Slots are peeled in waves: all slots that hold one key go together, and are assigned in reverse.
    """

    def __init__(self, seed: int, segment: int, count: int, slots: np.ndarray):
        self.seed, self.segment, self.count, self.slots = seed, segment, count, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        low = np.uint64(segment - 1)
        start = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
        second = (start + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
        third = (start + np.uint64(2 * segment)) ^ (h & low)
        prints = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).astype(np.uint8)
        return np.stack([start, second, third]).astype(np.int64), prints

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(np.asarray(keys, dtype=np.int64).view(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = 1.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, math.ceil(n * factor / segment) - 2 + 1)
        for seed in range(1, 200):
            if (slots := cls._solve(keys, seed, segment, count)) is not None:
                return cls(seed, segment, count, slots)
            count += seed % 4 == 0
        raise RuntimeError("no seed solves the filter")

    @classmethod
    def _solve(cls, keys: np.ndarray, seed: int, segment: int, count: int) -> np.ndarray | None:
        places, prints = cls._places(keys, seed, segment, count)
        size = (count + 2) * segment
        degree = np.bincount(places.ravel(), minlength=size)
        holds = np.zeros(size, dtype=np.int64)
        for row in places:
            np.bitwise_xor.at(holds, row, np.arange(len(keys)))
        ready, waves, left = np.flatnonzero(degree == 1), [], len(keys)
        while len(ready):
            who, first = np.unique(holds[ready], return_index=True)
            waves.append((who, ready[first]))
            left -= len(who)
            touched = places[:, who]
            np.subtract.at(degree, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(holds, row, who)
            near = np.unique(touched)
            ready = near[degree[near] == 1]
        if left:
            return None
        slots = np.zeros(size, dtype=np.uint8)
        for who, slot in reversed(waves):
            a, b, c = places[:, who]
            slots[slot] = 0
            slots[slot] = prints[who] ^ slots[a] ^ slots[b] ^ slots[c]
        return slots

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
        (a, b, c), prints = self._places(keys, self.seed, self.segment, self.count)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == prints
