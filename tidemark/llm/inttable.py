"""A read-only hash table of 64-bit integers that answers whole numpy arrays of keys."""

from __future__ import annotations

import numpy as np

_EMPTY = np.int64(-(1 << 62))


class IntTable:
    """value of each key, -1 for an unknown one. Keys are distinct and above -2**62, values not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int64)
        left, self.depth = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(left):
            at = (slot[left] + self.depth) & self.mask
            free = self.keys[at] == _EMPTY
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)
            self.depth += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        for d in range(1, self.depth):
            if not len(left):
                break
            at = (slot[left] + d) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (held != _EMPTY)]
        return out
