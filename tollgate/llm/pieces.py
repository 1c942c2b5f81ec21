"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Words (a run of blank marks and what follows; no piece crosses their borders) advance together, sorted by length, one
character at a time.  For every end position the substrings of all words are hashed and probed in the sorted hashes of the
pieces; of the candidates, the longest valid one is kept as backpointer.  The model file is of the merging kind (BPE), so a
step is valid, with log probability 0 and otherwise minus infinity, if the merges of the two adjoining pieces never join across their
border; a word has exactly one valid path, and it is what merging gives, so ids equal the library's.

Blanks become blank marks and a mark goes before the text; characters without a piece become bytes.  Defined cases: null
text counts as empty and has no ids; a blank mark in a text decodes to a blank, as the library does; an empty table gives no rows;
rows repeated whole are encoded each; texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.bpe import WordIds
from tollgate.llm.common import prepare, slices, table
from tollgate.llm.textvec import mix

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
FAR = np.inf
KNOWN_PAIRS = 1_000_000
KNOWN_WORDS = 800_000
CELLS = 1 << 16


def code_hash(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(np.uint64) + np.uint64(1))


def string_hash(text: str) -> int:
    h = 0
    for c in code_hash(np.array([ord(x) for x in text], np.uint64)).tolist():
        h = (h * int(_BASE) + c) & 0xFFFFFFFFFFFFFFFF
    return h


def merge(symbols: list[str], rank: dict[str, float]) -> list[tuple]:
    """Merging as the library does it: the best ranked adjoining pair first, the leftmost of equals.  Returns
    (string, left part, right part) trees' roots; the parts of a single symbol are None."""
    tree = [(s, None, None) for s in symbols]
    while len(tree) > 1:
        best = min(((rank.get(a[0] + b[0], FAR), i) for i, (a, b) in enumerate(zip(tree, tree[1:], strict=False))))
        if best[0] == FAR:
            break
        i = best[1]
        tree[i: i + 2] = [(tree[i][0] + tree[i + 1][0], tree[i][0], tree[i + 1][0])]
    return tree


class Pieces:
    """Arrays over piece ids; the last id stands for a character without a piece."""

    def __init__(self, model_file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = {names[i]: -sp.get_score(i) for i in normal}
        number = {names[i]: i for i in normal}
        self.unknown = n
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.hash = np.zeros(n + 1, np.uint64)
        self.length = np.ones(n + 1, np.int64)
        self.rank = np.full(n + 1, FAR)
        self.born = np.full(n + 1, -FAR)  # single characters are there from the start
        self.left = np.full(n + 1, -1, np.int64)
        self.right = np.full(n + 1, -1, np.int64)
        self.stable = np.zeros(n + 1, bool)
        self.stable[n] = True
        for i in normal:
            name = names[i]
            self.hash[i], self.length[i], self.rank[i] = string_hash(name), len(name), rank[name]
            roots = merge(list(name), rank)
            if len(roots) == 1:
                self.stable[i] = True
                if roots[0][1] is not None:
                    self.left[i], self.right[i] = number[roots[0][1]], number[roots[0][2]]
                    self.born[i] = rank[name]
        order = np.argsort(self.hash[normal])
        self.keys, self.ids = self.hash[normal][order], np.array(normal, np.int64)[order]
        self.longest = int(self.length[normal].max())
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.bytes = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging piece a's and then piece b's characters never joins across the border between them.

        It would if some part x at a's right edge and some part y at b's left edge made a piece that is merged while
        both are there: not after the merge that takes up x, which stands to the left and so wins
        ties, nor after the one that takes up y.
        """
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        x, until_x = a[at], np.full(len(at), FAR)
        while len(at):
            rows, y, until_y = np.arange(len(at)), b[at], np.full(len(at), FAR)
            while len(rows):
                joined = self.find(self.hash[x[rows]] * self.powers[np.minimum(self.length[y], self.longest)] + self.hash[y])
                time = np.maximum(np.maximum(self.rank[joined], self.born[x[rows]]), self.born[y])
                out[at[rows[(joined >= 0) & (time < until_x[rows]) & (time <= until_y)]]] = False
                on = (self.left[y] >= 0) & out[at[rows]]
                rows, until_y, y = rows[on], self.rank[y[on]], self.left[y[on]]
            on = (self.right[x] >= 0) & out[at]
            at, until_x, x = at[on], self.rank[x[on]], self.right[x[on]]
        return out


class PieceEncoder(WordIds):
    def __init__(self, pieces: Pieces, known_words: int = KNOWN_WORDS):
        super().__init__(known_words)
        self.p = pieces
        self.pairs, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)

    def word_starts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mark = cp == ord(MARK)
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        start[offsets[offsets < len(cp)]] = True
        return np.flatnonzero(start)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Pieces.apart``, each distinct pair once."""
        pair, back = np.unique(a * (self.p.unknown + 1) + b, return_inverse=True)
        if len(self.pairs) + len(pair) > KNOWN_PAIRS:
            self.pairs, self.valid = self.pairs[:0], self.valid[:0]
        at = np.searchsorted(self.pairs, pair)
        new = at == len(self.pairs)
        new[~new] = self.pairs[at[~new]] != pair[~new]
        if new.any():
            fresh = pair[new]
            merged = np.concatenate([self.pairs, fresh])
            valid = np.concatenate([self.valid, self.p.apart(fresh // (self.p.unknown + 1), fresh % (self.p.unknown + 1))])
            order = np.argsort(merged, kind="stable")
            self.pairs, self.valid = merged[order], valid[order]
            at = np.searchsorted(self.pairs, pair)
        return self.valid[at][back]

    def viterbi(self, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of words: rows of code points, padded on the right.  All rows advance together."""
        p, (n, width) = self.p, code.shape
        hashed = np.zeros((n, width + 1), np.uint64)
        c = code_hash(code)
        for j in range(width):
            hashed[:, j + 1] = hashed[:, j] * _BASE + c[:, j]
        last = np.full((n, width + 1), -1, np.int64)
        back = np.zeros((n, width + 1), np.int64)
        for j in range(1, width + 1):
            sizes = np.arange(1, min(j, p.longest) + 1)
            piece = p.find(hashed[:, j, None] - hashed[:, j - sizes] * p.powers[sizes])
            piece[:, 0] = np.where(piece[:, 0] < 0, p.unknown, piece[:, 0])
            ok = (piece >= 0) & p.stable[piece]
            r, k = np.nonzero(ok)
            before = last[r, j - sizes[k]]
            fine = (sizes[k] == j) | (before >= 0)
            r, k, before = r[fine], k[fine], before[fine]
            inner = sizes[k] < j
            valid = np.ones(len(r), bool)
            valid[inner] = self._apart(before[inner], piece[r[inner], k[inner]])
            best = np.zeros(n, np.int64)
            np.maximum.at(best, r[valid], sizes[k[valid]])
            got = best > 0
            back[:, j] = best
            last[got, j] = piece[got, best[got] - 1]
        steps, at, rows = [], length.copy(), np.arange(n)
        while len(rows := rows[at[rows] > 0]):
            steps.append((rows, last[rows, at[rows]], at[rows]))
            at[rows] -= np.maximum(back[rows, at[rows]], 1)
        row = np.concatenate([s[0] for s in steps])
        order = np.lexsort((np.concatenate([s[2] for s in steps]), row))
        return np.concatenate([s[1] for s in steps])[order], np.bincount(row, minlength=n)

    def new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(length) - length
        parts, i = [None] * len(words), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * length[order[j]] <= CELLS:
                j += 1
            rows = order[i:j]
            width = int(length[rows[-1]])
            inside = np.arange(width) < length[rows][:, None]
            code = np.where(inside, cp[np.minimum(start[rows][:, None] + np.arange(width), len(cp) - 1)], 0)
            ids, size = self.viterbi(code, length[rows])
            for w, x in zip(rows, np.split(ids, np.cumsum(size)[:-1]), strict=True):
                parts[w] = self._bytes(x, words[w]) if (x == self.p.unknown).any() else x
            i = j
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _bytes(self, ids: np.ndarray, word: str) -> np.ndarray:
        """The ids with characters that have no piece as bytes."""
        out, at = [], 0
        for i in ids.tolist():
            if i == self.p.unknown:
                out += self.p.byte_ids[list(word[at].encode("utf-8", "replace"))].tolist()
                at += 1
            else:
                out.append(i)
                at += int(self.p.length[i])
        return np.array(out, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i]:offsets[i+1]] are row i's."""
        texts = [MARK + t.replace(" ", MARK) if t else "" for t in pc.fill_null(column, "").to_pylist()]
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        ids, size = self.encode_words(joined, cp, offsets)
        return ids, np.concatenate([[0], np.cumsum(size)])


class PieceDecoder:
    def __init__(self, pieces: Pieces):
        self.size = np.array([len(x) for x in pieces.bytes], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces.bytes), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.repeat(self.at[ids] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[offsets]
        texts = (raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False))
        return [t[1:] if t.startswith(" ") else t for t in texts]


def model_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``ids`` (array<int>) of every text."""
    prepare(docs.sparkSession)
    pieces = Pieces(model or model_file())

    def run(batches):
        encoder = PieceEncoder(pieces)
        for b in slices(batches, "text"):
            ids, off = encoder.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.ListArray.from_arrays(off.astype(np.int32), pa.array(ids.astype(np.int32)))],
                                             names=[*carry, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """All columns but ``ids``, and ``text`` decoded from them."""
    prepare(encoded.sparkSession)
    pieces = Pieces(model or model_file())
    rest = [c for c in encoded.columns if c != "ids"]

    def run(batches):
        decoder = PieceDecoder(pieces)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids = pc.fill_null(part.column("ids"), [])
                off = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                text = decoder.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(text, pa.string())], names=[*rest, "text"])

    return encoded.mapInArrow(run, encoded.drop("ids", "text").withColumn("text", F.lit("")).schema)


def digest_columns(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: number and CRC-32 (little-endian unsigned 32-bit) of its ids, whether they decode to the text, and the
    SHA-256 of what they decode to.  Encoding and decoding share a pass, so that ids needn't be kept."""
    prepare(docs.sparkSession)
    pieces = Pieces(model or model_file())

    def run(batches):
        encoder, decoder = PieceEncoder(pieces), PieceDecoder(pieces)
        for b in slices(batches, "text"):
            ids, off = encoder.encode(b.column("text"))
            raw = ids.astype("<u4")
            back = decoder.decode(ids.astype(np.int64), off)
            same = [t == (u or "").replace(MARK, " ") for t, u in zip(back, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off), pa.int64()),
                 pa.array([zlib.crc32(raw[x:y].tobytes()) for x, y in zip(off, off[1:], strict=False)], pa.int64()), pa.array(same),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])], names=["doc_id", "n_ids", "ids_crc32", "round_trip", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(table(spark, sf_dir, "documents"))
