"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token is a linked list of tokens, at first its bytes.  Adjoining pairs that merge wait in buckets, one per merge rank, as the
list position of their left token; a hierarchy of 64-bit bitmaps marks the buckets in use, so that the next rank is found by
three find-first-set steps.  Entries are never searched for: one whose pair has changed is skipped when its turn comes.  The
least rank goes first, of equal ones the leftmost, as in the library.  Pre-tokens don't touch each other, so all new ones of a slice
share a queue, and a bucket is worked off at once with numpy.  Every merge costs a bounded number of steps, so the time
for a pre-token grows with its length only, however long it is.

Pre-tokens are split by the vocabulary's pattern (vectorised for simple scripts, by ``regex`` for texts with others), and a worker
keeps the ids of those it has met, found again by hash and characters.

Defined cases: null counts as empty; an empty text has no ids; texts of any length are split whole; rows repeated whole are
encoded each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.bpe import KNOWN_WORDS, UNKNOWN, WordIds, _classes, split_words
from tollgate.llm.common import prepare, slices, table


#: Positions of a bucket that are worked off at once.
BUCKET = 1 << 14


class RankQueue:
    """Buckets of list positions by rank; ``least()`` is the smallest rank with any, by find-first-set on three bitmap levels."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[i >> 6] |= 1 << (i & 63)
        self.top |= 1 << (i >> 6)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into its rank's bucket, but for those of rank -1 (no merge)."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [*(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        at = 0
        for cut, rank in zip(cuts, ranks[np.array(cuts) - 1].tolist(), strict=True):
            if rank >= 0:
                self.push(rank, positions[at:cut])
            at = cut

    def least(self) -> int:
        """-1 if the queue is empty."""
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        i = i << 6 | (word & -word).bit_length() - 1
        word = self.low[i]
        return i << 6 | (word & -word).bit_length() - 1

    def pop(self, rank: int) -> np.ndarray:
        """All positions of a rank's bucket, from the left."""
        bucket = self.buckets.pop(rank)
        i = rank >> 6
        self.low[i] &= ~(1 << (rank & 63))
        if not self.low[i]:
            self.mid[i >> 6] &= ~(1 << (i & 63))
            if not self.mid[i >> 6]:
                self.top &= ~(1 << (i >> 6))
        return bucket[0] if len(bucket) == 1 else np.sort(np.concatenate(bucket))


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every two tokens that make a third: a sorted table of them
        keys, merged = [], []
        find = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = find(token[:cut]), find(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        # tokens that are part of one with a lower rank: their merge can make a pair that goes before the rest of its bucket
        parts = np.maximum(self.keys >> 32, self.keys & 0xFFFFFFFF)
        self.early = frozenset(parts[self.merged < parts].tolist())

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of tokens a with tokens b, -1 where there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, numbers of ids) of pre-tokens."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        # nodes: each word's bytes and an end that merges with nothing; word number per node
        word = np.repeat(np.arange(len(words)), size + 1)
        end = np.cumsum(size + 1) - 1
        n = len(word)
        token = np.full(n, self.size, np.int64)
        inner = np.ones(n, bool)
        inner[end] = False
        token[inner] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        # a word that is a token is taken whole, as the library does
        whole = [(i, rank) for i, w in enumerate(words) if len(w) > 1 and (rank := self.ranks.get(w)) is not None]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = inner.copy()
        if whole:
            i = np.array([w[0] for w in whole])
            head = end[i] - size[i]
            taken = np.zeros(len(words), bool)
            taken[i] = True
            alive &= ~taken[word]
            alive[head] = True
            token[taken[word]] = self.size
            token[head] = [w[1] for w in whole]
            right[head], left[end[i]] = end[i], head
        waits = np.full(n, -1, np.int64)
        some = np.flatnonzero(alive[:-1])
        waits[some] = self.pairs(token[some], token[right[some]])
        queue = RankQueue(self.size)
        some = np.flatnonzero(waits >= 0)
        if len(some):
            queue.push_all(waits[some], some)
        now = np.zeros(n, bool)
        while (rank := queue.least()) >= 0:
            at = queue.pop(rank)
            if len(at) > BUCKET:  # the rest waits its turn as it is
                queue.push(rank, at[BUCKET:])
                at = at[:BUCKET]
            at = at[waits[at] == rank]  # the pairs of others have changed since
            if not len(at):
                continue
            take = np.ones(len(at), bool)
            over = right[at[:-1]] == at[1:]
            if over.any():  # of pairs that overlap in a row, each second one from the left
                run = np.ones(len(at), bool)
                run[1:] = ~over
                begin = np.flatnonzero(run)
                take = (np.arange(len(at)) - begin[np.cumsum(run) - 1]) % 2 == 0
            if rank in self.early and len(at) > 1:
                # a merge can make a pair of lower rank, which goes before its word's other merges
                own = at[take]
                now[right[own]] = True
                beside = np.where(now[left[own]], rank, token[left[own]])
                now[right[own]] = False
                made = np.stack([self.pairs(beside, np.full(len(own), rank)), self.pairs(np.full(len(own), rank), token[right[right[own]]])])
                first = own[((made >= 0) & (made < rank)).any(axis=0)]
                if len(first):
                    stop = np.full(len(words), n)
                    stop[word[first[::-1]]] = first[::-1]
                    later = at > stop[word[at]]
                    if later.any():
                        queue.push(rank, at[later])
                        take &= ~later
            at = at[take]
            gone = right[at]
            after = right[gone]
            token[at], right[at], left[after] = rank, after, at
            waits[gone] = -1
            alive[gone] = False
            now[at] = True
            before = left[at]
            before = before[~now[before]]
            now[at] = False
            new = np.concatenate([at, before[before >= 0]])
            waits[new] = ranks = self.pairs(token[new], token[right[new]])
            queue.push_all(ranks, new)
        return token[alive], np.bincount(word[alive], minlength=len(words))


class QueueEncoder(WordIds):
    def __init__(self, path: str, pattern: str, known_words: int = KNOWN_WORDS):
        import regex
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.classes = _classes()
        super().__init__(known_words)

    def word_starts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return split_words(cp, offsets, self.classes)

    def new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary.merge([w.encode() for w in words])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i]:offsets[i+1]] are row i's."""
        texts = pc.fill_null(column, "").to_pylist()
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(self.classes[cp] == UNKNOWN), side="right") - 1) if len(cp) else []
        ids, size = self.encode_words(joined, cp, offsets)
        if len(odd):
            cuts = np.concatenate([[0], np.cumsum(size)])
            parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for i in odd:
                parts[i] = self.new_words([m.group() for m in self.pattern.finditer(texts[i])])[0]
            ids, size = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.concatenate([[0], np.cumsum(size)])


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(x) for x in vocabulary.bytes], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes that each row's ids stand for."""
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.repeat(self.at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        return [raw[a:b] for a, b in zip(upto[offsets[:-1]].tolist(), upto[offsets[1:]].tolist(), strict=True)]


def vocabulary_file() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> QueueEncoder:
    """One per worker: what it has learned serves all of the worker's tasks."""
    return QueueEncoder(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``ids`` (array<int>) of every text."""
    prepare(docs.sparkSession)
    own = (path or vocabulary_file()[0], pattern or vocabulary_file()[1])

    def run(batches):
        for b in slices(batches, "text"):
            ids, off = encoder(*own).encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.ListArray.from_arrays(off.astype(np.int32), pa.array(ids.astype(np.int32)))],
                                             names=[*carry, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns but ``ids``, and ``decoded`` (binary), the bytes they stand for; null ids count as none."""
    prepare(encoded.sparkSession)
    own = (path or vocabulary_file()[0], pattern or vocabulary_file()[1])
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def run(batches):
        decoder = Decoder(encoder(*own).vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids = pc.fill_null(part.column("ids"), [])
                off = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                raw = decoder.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(raw, pa.binary())], names=[*rest, "decoded"])

    return encoded.select(*rest, "ids").mapInArrow(run, encoded.select(*rest).withColumn("decoded", F.lit(None).cast("binary")).schema)


def digest_columns(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: number and SHA-256 (little-endian unsigned 32-bit) of its ids, and the SHA-256 of the bytes they decode to.
    Encoding and decoding share a pass, so that ids needn't be kept."""
    prepare(docs.sparkSession)
    own = (path or vocabulary_file()[0], pattern or vocabulary_file()[1])

    def run(batches):
        enc = encoder(*own)
        decoder = Decoder(enc.vocabulary)
        for b in slices(batches, "text"):
            ids, off = enc.encode(b.column("text"))
            raw = memoryview(ids.astype("<u4").tobytes())
            back = decoder.decode(ids.astype(np.int64), off)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off), pa.int64()),
                 pa.array([hashlib.sha256(raw[4 * x: 4 * y]).hexdigest() for x, y in zip(off.tolist(), off[1:].tolist(), strict=False)]),
                 pa.array([hashlib.sha256(t).hexdigest() for t in back])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(table(spark, sf_dir, "documents"))
