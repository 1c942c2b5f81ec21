"""Byte-level BPE ids of whole Arrow text columns.

Splitting into words is vectorised over code points; each distinct word is encoded once per worker (by tiktoken, with the
same vocabulary as the tokenizers file) and found again by its 64-bit hash and its characters.  Texts outside the simple
scripts that the vectorised splitter covers are encoded whole.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tollgate.llm.textvec import _powers, mix

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Code points the splitter knows: Latin and general punctuation; white space as Unicode has it.
_WHITE = {*range(9, 14), 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
KNOWN_WORDS = 400_000


def _classes() -> np.ndarray:
    table = np.full(0x110000, UNKNOWN, np.uint8)
    for c in [*range(0x250), *range(0x2000, 0x2070)]:
        kind = unicodedata.category(chr(c))[0]
        table[c] = SPACE if c in _WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return table


def split_words(cp: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start positions of the vocabulary's pre-tokens: contractions, runs of one class with one blank before, white space."""
    n = len(cp)
    kind = classes[cp]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    head = head[:n]
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.ones(n, bool)  # last of its run
    last[:-1] = run[1:]
    ends_text = np.ones(n, bool)
    ends_text[:-1] = head[1:]
    # of white space before a word, the last character stands alone or, if a blank, joins the word
    lone = space & last & ~ends_text
    start = run | lone
    joined = np.zeros(n, bool)
    joined[1:] = (lone & (cp == 32))[:-1]
    start &= ~joined | head
    quotes = np.flatnonzero((cp == 39) & run & ~joined)
    if len(quotes):
        nxt = lambda k: np.where((quotes + k < n) & ~head[np.minimum(quotes + k, n - 1)], cp[np.minimum(quotes + k, n - 1)], 0)
        a, b = nxt(1), nxt(2)
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        two &= (a != 0) & (b != 0)
        for hit, size in ((quotes[one], 2), (quotes[two], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[after < n]
            # what follows starts anew unless it is a blank that was already told apart
            start[after] |= ~joined[after]
    return np.flatnonzero(start)


class WordIds:
    """Ids of texts, word by word; keeps the ids of words it has met.  Subclasses say where words start and encode new ones."""

    def __init__(self, known_words: int = KNOWN_WORDS):
        self.known_words = known_words
        self._forget()

    def word_starts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, numbers of ids) of words not met before."""
        raise NotImplementedError

    def _forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        # the words themselves: a hash is only where to look
        self.cp = np.zeros(0, np.uint32)
        self.cp_at = np.zeros(0, np.int64)
        self.cp_size = np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if not words:
            return
        ids, size = self.new_words(words)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        length = np.fromiter(map(len, words), np.int64, len(words))
        cp_at = len(self.cp) + np.cumsum(length) - length
        self.cp = np.concatenate([self.cp, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)])
        merged = np.concatenate([self.hash, hashes])
        order = np.argsort(merged, kind="stable")
        self.hash = merged[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.cp_at = np.concatenate([self.cp_at, cp_at])[order]
        self.cp_size = np.concatenate([self.cp_size, length])[order]

    def encode_words(self, joined: str, cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self.word_starts(cp, offsets)
        ends = np.append(starts[1:], len(cp))
        word = self.hashes(cp, starts, ends)
        distinct, first, back = np.unique(word, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > self.known_words:
            self._forget()
        place = np.searchsorted(self.hash, distinct)
        new = np.flatnonzero((place == len(self.hash)) | (self.hash[np.minimum(place, max(len(self.hash) - 1, 0))] != distinct)) \
            if len(self.hash) else np.arange(len(distinct))
        self._learn(distinct[new], [joined[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.hash, distinct)
        # equal hashes count only for equal characters: first occurrences against the known words, others against those
        differs = _differ(cp, starts[first], ends[first] - starts[first], self.cp, self.cp_at[place], self.cp_size[place])[back]
        differs |= _differ(cp, starts, ends - starts, cp, starts[first[back]], (ends - starts)[first[back]])
        size, at, flat = self.size[place][back], self.at[place][back], self.flat
        clash = np.flatnonzero(differs)
        if len(clash):  # each encoded for itself, and not kept
            own, own_size = self.new_words([joined[s:e] for s, e in zip(starts[clash].tolist(), ends[clash].tolist(), strict=True)])
            size[clash], at[clash] = own_size, len(flat) + np.cumsum(own_size) - own_size
            flat = np.concatenate([flat, own.astype(np.uint32)])
        upto = np.cumsum(size)
        ids = flat[np.repeat(at - (upto - size), size) + np.arange(upto[-1])]
        cuts = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return ids, np.diff(cuts)

    def hashes(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where to look for a word; words made on purpose can share one."""
        up, down = _powers(len(cp))
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _differ(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether spans of ``a`` hold other values than those of ``b`` beside them."""
    out = a_size != b_size
    rows = np.flatnonzero(~out & (a_size > 0) & ((a_at != b_at) | (a is not b)))
    size = a_size[rows]
    upto = np.cumsum(size)
    inside = np.arange(upto[-1] if len(rows) else 0) - np.repeat(upto - size, size)
    unequal = a[np.repeat(a_at[rows], size) + inside] != b[np.repeat(b_at[rows], size) + inside]
    if len(rows):
        out[rows] = np.logical_or.reduceat(unequal, upto - size)
    return out


class Encoder(WordIds):
    """Ids of texts under a vocabulary in tiktoken's form."""

    def __init__(self, path: str, pattern: str, known_words: int = KNOWN_WORDS):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        super().__init__(known_words)

    def word_starts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return split_words(cp, offsets, self.classes)

    def new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.bpe.encode_ordinary, words))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for w in ids for i in w), np.uint32, int(size.sum())), size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i]:offsets[i+1]] are row i's; nulls count as empty."""
        column = pc.fill_null(column, "")
        texts = column.to_pylist()
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(length)])
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(self.classes[cp] == UNKNOWN), side="right") - 1) if len(cp) else []
        ids, size = self.encode_words(joined, cp, offsets)
        if len(odd):
            whole = {int(i): np.array(self.bpe.encode_ordinary(texts[i]), np.uint32) for i in odd}
            cuts = np.concatenate([[0], np.cumsum(size)])
            ids = np.concatenate([whole.get(i, ids[cuts[i]: cuts[i + 1]]) for i in range(len(texts))])
            size = np.array([len(whole[i]) if i in whole else size[i] for i in range(len(texts))], np.int64)
        return ids, np.concatenate([[0], np.cumsum(size)])
