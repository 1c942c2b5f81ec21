"""Vectorised views of Arrow text columns: bytes, word boundaries, word and shingle hashes (numpy, no row loop)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty.  offsets[i]:offsets[i+1] are row i's UTF-8 bytes."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept per worker and grown on demand."""
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of maximal runs of non-space bytes; words first[i]:first[i+1] belong to row i."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before = np.empty(len(raw), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before[inner] = True
    after = np.empty(len(raw), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((mix(raw.astype(np.uint64) + np.uint64(1))) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of ``width`` consecutive words of a row; a shorter row has one, of all its words."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(counts)), n)
    at = first[row] + (np.arange(out_first[-1]) - out_first[row])
    have = np.minimum(counts[row], width)
    acc = have.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(width):
        there = have > k
        acc = np.where(there, mix(acc + word[np.minimum(at + k, max(len(word) - 1, 0))] * np.uint64(2 * k + 3)), acc) \
            if len(word) else acc
    return acc, out_first
