"""Words and n-grams of Arrow text columns, interned in an open-addressed NumPy table.

Words are runs of ASCII letters (lower-cased), digits and bytes of non-ASCII characters.  The kept text of a slice is its words with
one space between, so that an n-gram is a span of it.  A table is made per chunk of words: keys are xxhash64 values, a hit is
verified by its bytes, probing is linear, and every occurrence learns the slot of its n-gram.  Chunks bound
the memory whatever the length of a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tollgate.llm.textvec import buffers

CHUNK_WORDS = 1 << 16
#: bytes as they are kept: A-Z lower-cased, what isn't part of a word as a space
_KEPT = np.full(256, 32, np.uint8)
for _lo, _hi, _to in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x61), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x80)):
    _KEPT[_lo:_hi] = np.arange(_to, _to + _hi - _lo)
_MASK = np.array([0, *((1 << (8 * n)) - 1 for n in range(1, 9))], np.uint64)
#: fixed values of xxhash64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def kept_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): words of a text column in kept form; words first[i]:first[i+1] are row i's."""
    raw, offsets = buffers(column)
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = _KEPT[raw]
    inside = low != 32
    head = np.zeros(len(raw) + 1, bool)
    head[offsets] = True
    begins = inside & head[:-1]
    begins[0] = inside[0]
    begins[1:] |= inside[1:] & ~inside[:-1]
    stops = inside & head[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    # of what is between words one byte stays
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.cumsum(keep) - 1
    at = place[starts]
    return low[keep], at, at + (ends - starts), first


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, little-endian; zeros after the end."""
    x = np.zeros(len(raw) + 8, np.uint64)
    x[: len(raw)] = raw
    x[:-1] |= x[1:] << np.uint64(8)
    x[:-2] |= x[2:] << np.uint64(16)
    x[:-4] |= x[4:] << np.uint64(32)
    return x


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(raw: np.ndarray, lane: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxhash64 of byte spans: short ones together, those of 32 bytes and more by the library."""
    h = sizes.astype(np.uint64) + (_P5 + np.uint64(seed))
    for done in (0, 8, 16):
        rows = np.flatnonzero((sizes >= done + 8) & (sizes < 32))
        if len(rows):
            part = h[rows] ^ (_turn(lane[starts[rows] + done] * _P2, 31) * _P1)
            h[rows] = _turn(part, 27) * _P1 + _P4
    at, rest = starts + (sizes & ~7), sizes & 7
    rows = np.flatnonzero((rest >= 4) & (sizes < 32))
    if len(rows):
        h[rows] = _turn(h[rows] ^ ((lane[at[rows]] & _MASK[4]) * _P1), 23) * _P2 + _P3
        at[rows] += 4
    rest = rest & 3
    for done in (0, 1, 2):
        rows = np.flatnonzero((rest > done) & (sizes < 32))
        if len(rows):
            h[rows] = _turn(h[rows] ^ ((lane[at[rows] + done] & _MASK[1]) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(sizes >= 32)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        h[long] = np.fromiter((xxhash.xxh64_intdigest(view[a: a + n], seed) for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)),
                              np.uint64, len(long))
    return h


def same_bytes(raw: np.ndarray, lane: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold equal bytes."""
    same = ((lane[a] ^ lane[b]) & _MASK[np.minimum(sizes, 8)]) == 0
    rows, at = np.flatnonzero(same & (sizes > 8)), 8
    while len(rows) and at < 64:
        off = np.minimum(at, sizes[rows] - 8)
        ok = lane[a[rows] + off] == lane[b[rows] + off]
        same[rows[~ok]] = False
        at += 8
        rows = rows[ok & (sizes[rows] > at)]
    for i in rows.tolist():  # few: spans of more than 64 bytes
        n = int(sizes[i])
        same[i] = np.array_equal(raw[a[i]: a[i] + n], raw[b[i]: b[i] + n])
    return same


def _crc_tables() -> np.ndarray:
    """CRC-32 of eight bytes, by two bytes at a time: row k for the k-th two, the others 0."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    step = lambda x: byte[x & 0xFF] ^ (x >> np.uint32(8))
    out = np.empty((4, 1 << 16), np.uint32)
    out[3] = step(step(np.arange(1 << 16, dtype=np.uint32)))
    for k in (2, 1, 0):
        out[k] = step(step(out[k + 1]))
    return out.astype(np.uint64)


_CRC = _crc_tables()
_ONES = np.uint64(0xFFFFFFFF)


def _crc_of_eight(x: np.ndarray) -> np.ndarray:
    two = np.uint64(0xFFFF)
    return _CRC[0][x & two] ^ _CRC[1][(x >> np.uint64(16)) & two] ^ _CRC[2][(x >> np.uint64(32)) & two] ^ _CRC[3][x >> np.uint64(48)]


def crc32(raw: np.ndarray, lane: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, eight bytes a step after a shorter first one; spans of more than 256 bytes by zlib."""
    odd = (sizes & 7).astype(np.uint64)
    # a shorter first step stands behind zeros, which leave a state of zero as it is
    head = ((lane[starts] ^ _ONES) & _MASK[sizes & 7]) << ((np.uint64(64) - np.uint64(8) * odd) & np.uint64(63))
    state = _crc_of_eight(head) ^ (_ONES >> (np.uint64(8) * odd))
    at, rows, left = starts + (sizes & 7), np.flatnonzero((sizes >= 8) & (sizes <= 256)), sizes >> 3
    done = 0
    while len(rows):
        state[rows] = _crc_of_eight(lane[at[rows] + 8 * done] ^ state[rows])
        done += 1
        rows = rows[left[rows] > done]
    state ^= _ONES
    long = np.flatnonzero(sizes > 256)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        state[long] = np.fromiter((zlib.crc32(view[a: a + n]) for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)), np.uint64, len(long))
    return state


class GramTable:
    """Open-addressed table of the n-grams of a chunk.

    ``slot``: each occurrence's; ``owner``: per slot the first occurrence found there, -1 for a free one; ``count``: per slot its
    occurrences.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashed=xxh64):
        lane = lanes(raw)
        self.raw, self.lane, self.starts, self.sizes = raw, lane, starts, sizes
        n = len(starts)
        width = 1 << max(4, int(2 * n - 1).bit_length()) if n else 16
        key = hashed(raw, lane, starts, sizes)
        at = (key & np.uint64(width - 1)).astype(np.int64)
        self.owner = np.full(width, -1, np.int32)
        self.slot = np.empty(n, np.int64)
        waiting = np.arange(n)
        while len(waiting):
            here = at[waiting]
            free = self.owner[here] < 0
            self.owner[here[free]] = waiting[free]
            own = self.owner[here]
            found = own == waiting
            hit = np.flatnonzero(~found & (key[own] == key[waiting]) & (sizes[own] == sizes[waiting]))
            if len(hit):
                found[hit] = same_bytes(raw, lane, starts[own[hit]], starts[waiting[hit]], sizes[waiting[hit]])
            self.slot[waiting[found]] = here[found]
            waiting = waiting[~found]
            at[waiting] = (at[waiting] + 1) & (width - 1)
        self.count = np.bincount(self.slot, minlength=width)
        self.used = np.flatnonzero(self.owner >= 0)

    def crcs(self) -> np.ndarray:
        """Per slot the CRC-32 of its n-gram, taken once; 0 in free ones."""
        own = self.owner[self.used]
        out = np.zeros(len(self.owner), np.int64)
        out[self.used] = crc32(self.raw, self.lane, self.starts[own], self.sizes[own]).astype(np.int64)
        return out


def gram_chunks(words: tuple[np.ndarray, ...], most: int, chunk: int = CHUNK_WORDS) -> Iterator[tuple[np.ndarray, GramTable]]:
    """(row, table) of each chunk of ``kept_words``: the table of all runs of 1 to ``most`` words that begin in it, and each occurrence's row."""
    raw, starts, ends, first = words
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[row + 1]  # where the words of a word's row end
    for lo in range(0, len(starts), chunk):
        hi = min(lo + chunk, len(starts))
        left = last[lo:hi] - np.arange(lo, hi)  # words of the row from each word on
        begins = [np.flatnonzero(left >= k) + lo for k in range(1, most + 1)]
        word = np.concatenate(begins)
        size = np.repeat(np.arange(1, most + 1), [len(x) for x in begins])
        a, z = int(starts[lo]), int(ends[min(hi + most - 1, len(ends)) - 1])
        begin = starts[word]
        yield row[word], GramTable(raw[a:z], begin - a, ends[word + size - 1] - begin)
