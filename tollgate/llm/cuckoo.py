"""A cuckoo-filter index over 256-bit digests, vectorised with numpy.

Two candidate buckets of four 16-bit fingerprints each; every filled slot points at the stored
key, so a fingerprint hit is verified against the whole digest and a full filter is rebuilt
at twice the size from the stored keys.  Digests can be inserted, counted and deleted.
"""

from __future__ import annotations

import numpy as np

from tollgate.llm.textvec import mix

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests of one shard.  Keys are rows of a (n, 4) uint64 array (a SHA-256 digest)."""

    def __init__(self, capacity: int = 1024, max_kicks: int = MAX_KICKS):
        self.max_kicks = max_kicks
        self.resizes = 0
        self.keys = np.zeros((0, 4), np.uint64)
        self.live = np.zeros(0, bool)
        self._clear(max(4, 1 << int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.8 + 1)))))

    def _clear(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), np.uint16)  # 0: empty
        self.slot_key = np.full((buckets, SLOTS), -1, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket); either bucket leads to the other by the fingerprint alone."""
        prints = (keys[:, 0] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mix(keys[:, 1]) & self.mask
        return prints, first.astype(np.int64), self._other(first.astype(np.int64), prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ mix(prints.astype(np.uint64))) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key's stored content, -1 if it isn't live.  A filter hit counts only if the digest agrees."""
        found = np.full(len(keys), -1, np.int64)
        if not len(keys) or not len(self.keys):
            return found
        prints, a, b = self._places(keys)
        for bucket in (a, b):
            hit = self.prints[bucket] == prints[:, None]
            for s in range(SLOTS):
                rows = np.flatnonzero(hit[:, s] & (found < 0))
                at = self.slot_key[bucket[rows], s]
                same = (self.keys[at] == keys[rows]).all(axis=1) & (at >= 0)
                found[rows[same]] = at[same]
        return found

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Make each key live (keys distinct within the call); returns the positions of their stored content."""
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.keys) + np.arange(len(new))
        self.keys = np.concatenate([self.keys, keys[new]])
        self.live = np.concatenate([self.live, np.ones(len(new), bool)])
        if not self._place(at[new]):
            self._grow()
        return at

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Forget keys; returns which of them were live."""
        at = self.find(keys)
        gone = at[at >= 0]
        self.live[gone] = False
        if len(gone):
            _, a, b = self._places(self.keys[gone])
            for bucket in (a, b):
                for s in range(SLOTS):
                    rows = np.flatnonzero(self.slot_key[bucket, s] == gone)
                    self.prints[bucket[rows], s] = 0
                    self.slot_key[bucket[rows], s] = -1
        return at >= 0

    def _grow(self) -> None:
        """Overflow: double the buckets and place every live stored key again, until all fit."""
        while True:
            self.resizes += 1
            self._clear(2 * len(self.prints))
            if self._place(np.flatnonzero(self.live)):
                return

    def _place(self, at: np.ndarray) -> bool:
        """Place stored keys in rounds: free slots first, then one eviction per bucket; False if some stay homeless."""
        if len(at) > 0.95 * self.prints.size:
            return False
        prints, bucket, other = self._places(self.keys[at])
        # the emptier bucket first
        load = (self.prints != 0).sum(axis=1)
        bucket = np.where(load[bucket] <= load[other], bucket, other)
        for kick in range(self.max_kicks):
            if not len(at):
                return True
            order = np.argsort(bucket, kind="stable")
            at, prints, bucket = at[order], prints[order], bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            empty = self.prints[bucket] == 0
            fits = rank < empty.sum(axis=1)
            slot = np.argmax((np.cumsum(empty, axis=1) == (rank + 1)[:, None]) & empty, axis=1)
            self.prints[bucket[fits], slot[fits]] = prints[fits]
            self.slot_key[bucket[fits], slot[fits]] = at[fits]
            at, prints, bucket = at[~fits], prints[~fits], bucket[~fits]
            if not len(at):
                return True
            # the first homeless key of each (now full) bucket evicts a resident, which moves to its other bucket
            lead = np.r_[True, bucket[1:] != bucket[:-1]]
            slot = ((at[lead] + kick) % SLOTS).astype(np.int64)
            b = bucket[lead]
            out_at, out_print = self.slot_key[b, slot].copy(), self.prints[b, slot].copy()
            self.slot_key[b, slot], self.prints[b, slot] = at[lead], prints[lead]
            stay = ~lead
            at = np.concatenate([at[stay], out_at])
            bucket = np.concatenate([self._other(bucket[stay], prints[stay]), self._other(b, out_print)])
            prints = np.concatenate([prints[stay], out_print])
        return False
