"""Merging pairs of neighbouring symbols in the order of their ranks."""

from __future__ import annotations

import heapq

import numpy as np

NONE, LONG_SLICE, SLOTS = 1 << 40, 192, 1 << 21


class PairMerges:
    """The table of pairs: symbols a and b join to ``into``, those of the least ``rank`` first."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray, into: np.ndarray) -> None:
        key = a << 20 | b
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.rank, self.into = np.append(rank[order], NONE), np.append(into[order], -1)
        # a row for most keys by a hash; keys that share a slot with another are searched for
        slot = self.slot(self.key[:-1])
        self.at_slot = np.full(SLOTS, len(self.key) - 1)
        self.at_slot[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=SLOTS) > 1
        self.pairs = dict(zip(key.tolist(), zip(rank.tolist(), into.tolist())))

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x2545F4914F6CDD1D >> 40) & SLOTS - 1

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each pair; the last row if there is none."""
        key = a << 20 | b
        slot = self.slot(key)
        at = self.at_slot[slot]
        wrong = np.flatnonzero(self.key[at] != key)
        at[wrong] = len(self.key) - 1
        again = wrong[self.crowded[slot[wrong]]]
        if len(again):
            found = np.searchsorted(self.key, key[again])
            at[again] = np.where(self.key[found] == key[again], found, len(self.key) - 1)
        return at

    def merge_one(self, ids: list[int]) -> list[int]:
        """A long slice alone, with a heap of its pairs."""
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := self.pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = into, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := self.pairs.get(ids[left] << 20 | ids[right])):
                    heapq.heappush(heap, (p[0], left, ids[left], ids[right], p[1]))
        return [x for x in ids if x >= 0]

    def merge_short(self, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Short slices together: in each round every slice merges its leftmost pair of the least rank."""
        done_ids, done_owner, none = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(self.key) - 1
        row, at = np.full(len(ids), none), np.arange(len(ids))
        while len(ids):
            # only pairs beside a merge are looked up again
            row[at] = none
            at = np.concatenate([at, at - 1])
            at = at[(at >= 0) & (at < len(ids) - 1)]
            at = at[owner[at] == owner[at + 1]]
            row[at] = self.find(ids[at], ids[at + 1])
            rank = self.rank[row]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(ids)))
            over = np.repeat(least == NONE, count)
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
            hit = np.flatnonzero((rank == np.repeat(least, count)) & ~over)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
            ids[hit] = self.into[row[hit]]
            stay = ~over
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            ids, owner, row = ids[stay], owner[stay], row[stay]
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return all_ids[np.argsort(all_owner, kind="stable")], np.bincount(all_owner, minlength=n)

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges, and how many each slice has; ``ids`` holds the slices' first symbols one after another."""
        n, big = len(sizes), sizes > LONG_SLICE
        owner = np.repeat(np.arange(n), sizes)
        if not big.any():
            return self.merge_short(ids.copy(), owner, n)
        of = big[owner]
        short, short_sizes = self.merge_short(ids[~of], owner[~of], n)
        upto = np.cumsum(sizes)
        long = {i: self.merge_one(ids[upto[i] - sizes[i]:upto[i]].tolist()) for i in np.flatnonzero(big).tolist()}
        out_sizes = short_sizes
        out_sizes[list(long)] = [len(x) for x in long.values()]
        out, from_long = np.zeros(int(out_sizes.sum()), np.int64), np.repeat(big, out_sizes)
        out[~from_long], out[from_long] = short, [x for o in long.values() for x in o]
        return out, out_sizes
