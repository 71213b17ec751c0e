"""Ids of stretches of text, kept in a table of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .textgrid import slice_hashes

SLOTS, KEPT_IDS = 1 << 20, 1 << 22


class StretchTable:
    """Ids of stretches by their hash. Each hash has one slot; a newcomer takes it over, and what was there is encoded anew when it comes again."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = (np.zeros(SLOTS, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(KEPT_IDS, np.uint32), 0

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these stretches, and how many each has."""
        raise NotImplementedError

    def encode_stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the stretches among them."""
        code, keys = pd.factorize(slice_hashes(data, starts, ends).view(np.int64) | 1)
        slot = keys >> 1 & SLOTS - 1
        new = np.flatnonzero(self.keys[slot] != keys)
        first, size, ids = self.first[slot], self.size[slot], self.ids
        if len(new):
            at = np.zeros(len(keys), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]  # where each stretch occurs first
            whole = data.tobytes()
            flat, sizes = self.encode_new([whole[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            if self.used + len(flat) <= len(self.ids):
                begin = self.used
                self.ids[begin:begin + len(flat)] = flat
                self.used += len(flat)
            else:  # a full table starts over; this call still reads the old one
                begin, ids = len(self.ids), np.concatenate([self.ids, flat.astype(np.uint32)])
                self.clear()
            first[new], size[new] = begin + np.cumsum(sizes) - sizes, sizes
            if begin < KEPT_IDS:
                self.keys[slot[new]], self.first[slot[new]], self.size[slot[new]] = keys[new], first[new], sizes
        first, size = first[code], size[code]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        return ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto
