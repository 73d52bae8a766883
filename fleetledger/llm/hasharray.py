"""Sorted hash arrays: 64-bit keys in hash order, found by their leading bits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fleetledger.llm.words import mix


@dataclass
class HashArray:
    """hashes: sorted; index: where each value of the leading bits begins; values: a row per key, in that order."""

    hashes: np.ndarray
    index: np.ndarray
    bits: int
    values: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = mix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(4, min(22, int(len(keys)).bit_length()))
        index = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return cls(hashes, index.astype(np.int32), bits, values[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        row = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return row
        wanted = mix(keys.astype(np.uint64))
        place = self.index[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = place[left]
            inside = at < len(self.hashes)
            left, at = left[inside], at[inside]
            here, goal = self.hashes[at], wanted[left]
            hit = here == goal
            row[left[hit]] = at[hit]
            left = left[here < goal]
            place[left] += 1
        return row
