"""Document quality by a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features learns a lookup table for each feature, then one for each of the
feature pairs that help most.  A score is a sum of table entries through the logistic function.  Labels are learned
from a bounded sample of labelled rows that are not held out (``SAMPLE``); the sample's features, not
its texts, go to the driver, and the tables (some KB) go to the tasks.

Defined cases: null text counts as empty, an empty text is scored; an empty table gives no rows; a document labelled
more than once takes its smallest label, null labels teach nothing, and without labels of both kinds every score is the
share of good labels (1 if there is none); a text of any length is scored whole; rows repeated whole are scored each; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import prepare, slices, table
from tollgate.llm.textvec import SPACE, buffers, hashes, mix, words

#: Labelled rows to learn from, at most about so many, taken by a hash of doc_id.
SAMPLE = 16_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, L2 = 60, 40, 0.2, 3, 2.0

FEATURES = ("log_bytes", "words_per_line", "word_bytes", "word_spread", "upper", "digits", "symbols", "bangs", "bars",
            "repeats", "distinct", "top_word", "stops", "non_ascii", "capitals", "short_words", "distinct_lines", "longest_word")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"#$%&*<>{}@^~=_+\\/[]`")
_HIGH = _class(bytes(range(192, 256)))


def features(column: pa.Array) -> np.ndarray:
    """(rows, features) of a text column."""
    raw, off = buffers(column)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(np.float64)

    def per_row(per_byte: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(per_byte, dtype=np.float64)])[off])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first])

    starts, ends, first = words(raw, off)
    count = np.diff(first)
    some = np.maximum(count, 1).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    mean = per_word(length) / some
    spread = np.sqrt(np.maximum(per_word(length ** 2) / some - mean ** 2, 0))
    word = hashes(raw, starts, ends)
    row = np.repeat(np.arange(n), count)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    distinct, where, times = np.unique(mix(word + mix(row.astype(np.uint64))), return_index=True, return_counts=True)
    kinds = np.bincount(row[where], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row[where], times)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    newline = raw == 10
    lines = per_row(newline) + 1
    line_start = np.flatnonzero(newline) + 1
    line_start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], line_start[line_start < len(raw)]]))
    line_row = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.append(line_start[1:], len(raw))
    line = hashes(raw, line_start, line_end)
    _, line_at = np.unique(mix(line + mix(line_row.astype(np.uint64))), return_index=True)
    distinct_lines = np.bincount(line_row[line_at], minlength=n) / np.maximum(np.bincount(line_row, minlength=n), 1)
    letters = np.maximum(per_row(_LETTER[raw]), 1)
    capital = _UPPER[raw[starts]] if len(starts) else np.zeros(0)
    stop = np.isin(raw[ends - 1], [46, 63]) if len(ends) else np.zeros(0)
    return np.stack([
        np.log1p(np.diff(off)), count / lines, mean, spread, per_row(_UPPER[raw]) / letters, per_row(_DIGIT[raw]) / size,
        per_row(_SYMBOL[raw]) / some, per_row(raw == 33) / some, per_row(raw == 124) / some, per_word(same) / some,
        kinds / some, top / some, per_word(stop) / some, per_row(_HIGH[raw]) / size, per_word(capital) / some,
        per_word(length <= 3) / some, distinct_lines, longest / some ** 0.5,
    ], axis=1).astype(np.float32)


# ---- the model -------------------------------------------------------------------------------------------------------

class AdditiveModel:
    """Lookup tables over binned features and feature pairs.  ``edges[f]``: inner bin borders of feature f."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges = edges
        self.base = base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        """Bins for the pair tables: neighbouring ones together."""
        return np.stack([bins[:, f] * PAIR_BINS // (len(e) + 1) for f, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        coarse = self.coarse(bins)
        out = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            out += t[bins[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[:, f], coarse[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g, h):
    return g * g / (h + L2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree of a few leaves over ordered bins, each cut the best of all that are left."""
    cuts = [0, len(g)]
    upto_g, upto_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            lg, lh = upto_g[c] - upto_g[a], upto_h[c] - upto_h[a]
            rg, rh = upto_g[b] - upto_g[c], upto_h[b] - upto_h[c]
            gain = _gain(lg, lh) + _gain(rg, rh) - _gain(lg + rg, lh + rh)
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], int(c[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (upto_g[b] - upto_g[a]) / (upto_h[b] - upto_h[a] + L2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features once."""
    upto = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ug, uh = upto(g), upto(h)
    best, cut = 0.0, (1, 1)
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            gain = 0.0
            for a, b, c, d in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
                gain += _gain(ug[b, d] - ug[a, d] - ug[b, c] + ug[a, c], uh[b, d] - uh[a, d] - uh[b, c] + uh[a, c])
            if gain > best:
                best, cut = gain, (i, j)
    i, j = cut
    out = np.zeros_like(g)
    for a, b, c, d in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
        out[a:b, c:d] = g[a:b, c:d].sum() / (h[a:b, c:d].sum() + L2)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost round after round, one feature after the other, then the pairs."""
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        return AdditiveModel([np.zeros(0)] * x.shape[1], float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model = AdditiveModel(edges, float(np.log(y.mean() / (1 - y.mean()))))
    bins = model.bins(x)
    coarse = model.coarse(bins)
    raw = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, f], g, len(t)), np.bincount(bins[:, f], h, len(t)), LEAVES)
            t += step
            raw += step[bins[:, f]]
    g, h = slopes()
    grid = lambda v, f, k: np.bincount(coarse[:, f] * PAIR_BINS + coarse[:, k], v, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)
    gains = sorted(((_quadrants(grid(g, f, k), grid(h, f, k))[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k) for _, f, k in gains[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, k), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _quadrants(grid(g, f, k), grid(h, f, k))[1]
            t += step
            raw += step[coarse[:, f], coarse[:, k]]
    return model


# ---- Spark -------------------------------------------------------------------------------------------------------------

def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, size: int) -> DataFrame:
    """(text, label) of about ``size`` usable labelled documents at most, picked by a hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    total = known.count()
    scale = 1 << 30
    if total > size:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(scale)) < int(scale * size / total))
    # at most about ``size`` pairs of numbers: small enough to send to every task
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> AdditiveModel:
    spark = docs.sparkSession
    prepare(spark)
    sample = labelled_sample(docs, labels, "quality", remainder(4) != 2, size)

    def run(batches):
        for b in slices(batches, "text"):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))],
                                             names=["doc_id", "y", "x"])

    got = sample.select("doc_id", F.col("y").cast("int"), "text").mapInArrow(run, "doc_id long, y int, x array<float>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x.astype(np.float64), got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: AdditiveModel, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all, if not given; one called quality_score is replaced) and ``quality_score`` of every document."""
    prepare(docs.sparkSession)
    carry = [c for c in (carry if carry is not None else docs.columns) if c != "quality_score"]
    source = docs.select(*dict.fromkeys([*carry, "text"]))

    def run(batches):
        for b in slices(batches, "text"):
            s = model.score(features(b.column("text")).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(s, pa.float64())], names=[*carry, "quality_score"])

    schema = docs.select(*carry).withColumn("quality_score", F.lit(0.0)).schema
    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text"):
            yield b.filter(pa.array(model.score(features(b.column("text")).astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"),
                                               (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
