"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystrom landmarks.

A sentence is read as windows: its words (letters only, lower case; what isn't a letter is dropped, and single letters in a row make one
word) and its phrases, runs of two to ``WORDS`` adjoining words.  A window, within boundary marks, is described by its ordered letter
triples, a gap costing ``DECAY`` a letter.  Windows of labelled sentences that tell the classes apart are the landmarks; a
window's feature vector is its kernel with them, whitened by the landmarks' own kernel, and a linear support vector machine is trained on
it, one for words and, if phrases tell something that none of their words does, one for phrases.  A sentence counts as its worst window and a
document as its worst sentence, so the witnesses of toxic sentences and the hardest windows of clean ones are picked anew each round.
As kernel, whitening and machine are linear in the triples, they fold into one table of triple weights, and all windows over a
letter share its triples' sums.

Defined cases: null text counts as empty, an empty text is scored (as clean); an empty table gives no rows; a text of any length is read
whole, a window of over ``LONG`` letters in overlapping parts if it is one word, else not at all; a document labelled more than once
takes its smallest label; without labels of both kinds every score is the share of toxic ones (0 if there is none); rows repeated whole
are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import prepare, slices, table
from tollgate.llm.quality import labelled_sample, remainder
from tollgate.llm.textvec import _powers, mix

#: Labelled documents to learn from, at most about so many, taken by a hash of doc_id.
SAMPLE = 4_000
THRESHOLD = 0.5
DECAY, SPAN = 0.5, 5
#: Landmarks; rounds; hardest clean windows that are added in a round.
LANDMARKS, ROUNDS, HARD = 384, 4, 4000
LONG, STEP = 32, 16
#: Adjoining words in a window at most.
WORDS = 3

#: Letters by code; 0 is no letter, 1 and 2 mark the borders of a word, 3 is any letter not listed.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüßœ"
SIZE = len(ALPHABET) + 4


def _letter_codes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    spans = np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)
    out[: len(spans)][spans] = 3
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = 4 + i
    return out


#: Stops and ends of lines, which end a sentence.
_STOPS = [ord(c) for c in ".!?\n\r…。！？"]
_CODES: list[np.ndarray] = []


def codes() -> np.ndarray:
    if not _CODES:
        _CODES.append(_letter_codes())
    return _CODES[0]


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, row): letter codes of all words of a text column, words as spans of them, and their rows."""
    return sentences(column)[:4]


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``letters`` and, per word, whether the next one belongs to the same sentence."""
    texts = pc.utf8_lower(pc.fill_null(column, "")).to_pylist()
    joined = "\n".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    kind = codes()[cp]
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    at = np.flatnonzero(kind)
    group = np.cumsum(space)[at]  # letters with no white space between belong together
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(at) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at)) if len(starts) else starts
    row = np.searchsorted(np.cumsum(length), at[starts], side="right")
    one = (ends - starts) == 1
    glued = np.zeros(len(starts), bool)
    glued[1:] = one[1:] & one[:-1] & (row[1:] == row[:-1])
    starts, row = starts[~glued], row[~glued]
    ends = np.append(starts[1:], len(at)) if len(starts) else starts
    # a sentence ends with its text, and where a stop or a line's end lies between two words
    stops = np.cumsum(np.isin(cp, _STOPS))
    goes_on = np.zeros(len(starts), bool)
    if len(starts):
        goes_on[:-1] = (row[1:] == row[:-1]) & (stops[at[starts[1:]]] == stops[at[ends[:-1] - 1]])
    return kind[at], starts, ends, row, goes_on


def phrases(starts, ends, goes_on, most: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, last word) of the runs of 2 to ``most`` adjoining words of a sentence, of at most ``LONG`` letters, by their number."""
    out = []
    for n in range(2, most + 1):
        run = np.ones(max(0, len(starts) - n + 1), bool)
        for k in range(n - 1):
            run &= goes_on[k: k + len(run)]
        run &= ends[len(starts) - len(run):] - starts[: len(run)] <= LONG
        out.append((np.flatnonzero(run), np.flatnonzero(run) + n - 1))
    return out


def windows(starts, ends, row):
    """Words over ``LONG`` letters as overlapping windows, so that the work a letter stays bounded."""
    size = ends - starts
    if not (size > LONG).any():
        return starts, ends, row
    n = np.where(size > LONG, -(-(size - LONG) // STEP) + 1, 1)
    which = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    s = np.where(n[which] > 1, np.minimum(starts[which] + k * STEP, ends[which] - LONG), starts[which])
    e = np.where(n[which] > 1, s + LONG, ends[which])
    return s, e, row[which]


def word_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes_in_parts(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    """``word_hashes`` of spans in order of their starts, some at a time, to hold less at once."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), size):
        s, e = starts[a: a + size], ends[a: a + size]
        out[a: a + size] = word_hashes(code[s[0]: e.max()], s - s[0], e - s[0])
    return out


def triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, k, weight) of the ordered triples of ``length`` positions that span at most ``SPAN``; unit norm."""
    got = [(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = (np.array(x, np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
    w = DECAY ** (k - i - 2.0)
    return i, j, k, w / np.sqrt(max((w * w).sum(), 1e-9))


def by_length(code, starts, ends, chunk: int = 4096):
    """(word numbers, matrix of letter codes with boundary marks), words of one length together."""
    size = ends - starts
    for n in np.unique(size):
        every = np.flatnonzero(size == n)
        for a in range(0, len(every), chunk):
            which = every[a: a + chunk]
            m = np.empty((len(which), n + 2), np.int64)
            m[:, 0], m[:, -1] = 1, 2
            m[:, 1:-1] = code[starts[which][:, None] + np.arange(n)]
            yield which, m


def weigh(code, starts, ends, weights: np.ndarray) -> np.ndarray:
    """Sum of the triple weights of each word (the machine's decision without its bias)."""
    out = np.zeros(len(starts), np.float32)
    for which, m in by_length(code, starts, ends):
        i, j, k, w = triples(m.shape[1])
        out[which] = weights[(m[:, i] * SIZE + m[:, j]) * SIZE + m[:, k]] @ w
    return out


def window_values(code, starts, ends, weights: np.ndarray, part: int = 1 << 17) -> np.ndarray:
    """``weigh`` for spans in order of their starts that may overlap: each letter's triples are added up once for all of them."""
    out = np.empty(len(starts), np.float32)
    for a in range(0, len(starts), part):
        s, e = starts[a: a + part], ends[a: a + part]
        out[a: a + part] = _window_values(code[s[0]: e.max()], s - s[0], e - s[0], weights)
    return out


def _window_values(code, starts, ends, weights: np.ndarray) -> np.ndarray:
    m = np.concatenate([code, np.zeros(SPAN, code.dtype)]).astype(np.int64)
    n = len(code)
    w = lambda x, y, z: weights[(x * SIZE + y) * SIZE + z].astype(np.float64)
    at = lambda k: m[k: k + n]
    # triples that begin at a letter, by the letter they may reach
    to2 = w(at(0), at(1), at(2))
    to3 = to2 + DECAY * (w(at(0), at(1), at(3)) + w(at(0), at(2), at(3)))
    to4 = to3 + DECAY ** 2 * (w(at(0), at(1), at(4)) + w(at(0), at(2), at(4)) + w(at(0), at(3), at(4)))
    upto = np.concatenate([[0.0], np.cumsum(to4)])
    size = ends - starts
    out = np.zeros(len(starts))
    big = np.flatnonzero(size >= 4)
    a, b = starts[big], ends[big]
    f = [m[a + k] for k in range(4)]
    z = [m[b - k] for k in range(1, 5)]  # the last letters, last first
    front = w(1, f[0], f[1]) + DECAY * (w(1, f[0], f[2]) + w(1, f[1], f[2])) + DECAY ** 2 * (w(1, f[0], f[3]) + w(1, f[1], f[3]) + w(1, f[2], f[3]))
    back = w(z[1], z[0], 2) + DECAY * (w(z[2], z[1], 2) + w(z[2], z[0], 2)) + DECAY ** 2 * (w(z[3], z[2], 2) + w(z[3], z[1], 2) + w(z[3], z[0], 2))
    norm = np.array([1.0] * 4 + [1 / np.sqrt(_squares(k + 2)) for k in range(4, LONG + 1)])
    out[big] = (upto[b - 4] - upto[a] + to3[b - 4] + to2[b - 3] + front + back) * norm[size[big]]
    small = np.flatnonzero(size < 4)
    if len(small):  # few kinds
        letter = [np.where(size[small] > k, m[starts[small] + k], 0) for k in range(3)]
        _, first, same = np.unique((letter[0] * SIZE + letter[1]) * SIZE + letter[2], return_index=True, return_inverse=True)
        out[small] = weigh(code, starts[small][first], ends[small][first], weights)[same]
    return out


def _squares(length: int) -> float:
    """Sum of the squared weights of a window's triples, before they are brought to unit norm."""
    return float(sum(max(0, length - d) * (d - 1) * DECAY ** (2 * (d - 2)) for d in range(2, SPAN)))


def kernel(code, starts, ends, marks: list[np.ndarray]) -> np.ndarray:
    """(words, landmarks) kernel values.  marks: landmarks as dense triple vectors' sparse parts (codes, weights)."""
    wide = np.zeros((SIZE ** 3, 0), np.float32)
    used = np.unique(np.concatenate([c for c, _ in marks]))
    place = np.zeros(SIZE ** 3, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    wide = np.zeros((len(used) + 1, len(marks)), np.float32)
    for n, (c, w) in enumerate(marks):
        np.add.at(wide[:, n], place[c], w)
    out = np.zeros((len(starts), len(marks)), np.float32)
    for which, m in by_length(code, starts, ends, 256):
        i, j, k, w = triples(m.shape[1])
        at = place[(m[:, i] * SIZE + m[:, j]) * SIZE + m[:, k]]
        out[which] = np.einsum("nt,ntm->nm", np.broadcast_to(w.astype(np.float32), at.shape), wide[at], optimize=True)
    return out


def landmark(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.concatenate([[1], code.astype(np.int64), [2]])
    i, j, k, w = triples(len(m))
    return (m[i] * SIZE + m[j]) * SIZE + m[k], w.astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, reg: float = 1e-4, steps: int = 25) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * reg
    ridge[-1, -1] = 1e-8
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a, c = x[inside], cost[inside]
        new = np.linalg.solve(a.T @ (a * c[:, None]) + ridge, a.T @ (c * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


Machine = tuple[np.ndarray, float]  # triple weights and bias


class ToxicityModel:
    """The machines of words and of phrases (either may be None), and the logistic curve from a document's worst window to its score."""

    def __init__(self, words: Machine | None, phrases: Machine | None, slope: float, shift: float):
        self.words, self.phrases, self.slope, self.shift = words, phrases, slope, shift

    def curve(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def constant(share: float) -> ToxicityModel:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return ToxicityModel(None, None, 0.0, float(np.log(share / (1 - share))))


EMPTY = -4.0  # the worst window of a text without words


def raise_worst(worst, code, starts, ends, row, goes_on, model: ToxicityModel) -> None:
    """``worst`` of each row, raised to the decisions on its windows."""
    if model.words is not None:
        s, e, r = windows(starts, ends, row)
        np.maximum.at(worst, r, window_values(code, s, e, model.words[0]) + np.float32(model.words[1]))
    if model.phrases is not None:
        for first, last in phrases(starts, ends, goes_on):
            np.maximum.at(worst, row[first], window_values(code, starts[first], ends[last], model.phrases[0]) + np.float32(model.phrases[1]))


class Scorer:
    """The worst window of each row."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def worst(self, column: pa.Array) -> np.ndarray:
        code, starts, ends, row, goes_on = sentences(column)
        out = np.full(len(column), EMPTY, np.float32)
        if len(starts):
            raise_worst(out, code, starts, ends, row, goes_on, self.model)
        return out


def fit_texts(column: pa.Array, y: np.ndarray) -> ToxicityModel:
    return fit(*sentences(column), y)


def fit(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, goes_on: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Train on labelled documents (y: 1 toxic, 0 not), given in a defined order: ``sentences`` of them."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    telling = np.zeros(len(starts), bool)
    words = _fit_words(code, starts, ends, row, y, telling) if len(starts) else None
    of_phrases = _fit_phrases(code, starts, ends, row, goes_on, y, telling) if len(starts) else None
    model = ToxicityModel(words, of_phrases, 0.0, 0.0)
    if words is None and of_phrases is None:
        return constant(float(y.mean()))
    worst = np.full(len(y), EMPTY)
    raise_worst(worst, code, starts, ends, row, goes_on, model)
    model.slope, model.shift = _logistic(worst, y)
    return model


def _telling(bad: np.ndarray, good: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Windows held by so many texts, nearly all toxic, that luck doesn't explain it: the chance that all are toxic, against the number
    of windows that could be so lucky."""
    share = max(y.mean(), 1e-3)
    return (good <= bad // 50) & (bad * -np.log(share) > np.log(max(1, len(bad))) + 2)


def _machine(code, ws, we, marks_at, witness, hard) -> Machine:
    """The machine that tells the witnesses from the hard windows, folded into a table of triple weights."""
    marks = [landmark(code[ws[i]: we[i]]) for i in marks_at]
    whiten = kernel(code, ws[marks_at], we[marks_at], marks).astype(np.float64)
    values, vectors = np.linalg.eigh((whiten + whiten.T) / 2)
    keep = values > 1e-4
    half = vectors[:, keep] / np.sqrt(values[keep])
    chosen = np.concatenate([witness, hard])
    x = kernel(code, ws[chosen], we[chosen], marks).astype(np.float64) @ half
    target = np.concatenate([np.ones(len(witness)), -np.ones(len(hard))])
    cost = np.concatenate([np.full(len(witness), 1.0 / len(witness)), np.full(len(hard), 1.0 / len(hard))])
    w = svm(x, target, cost)
    weights = np.zeros(SIZE ** 3, np.float64)
    for a, (c, v) in zip(half @ w[:-1], marks, strict=True):
        np.add.at(weights, c, a * v)
    return weights.astype(np.float32), float(w[-1])


def _fit_words(code, starts, ends, row, y, told_words) -> Machine | None:
    """The machine of words; marks the telling ones in ``told_words``."""
    s, e, r = windows(starts, ends, row)
    distinct, first, back = np.unique(hashes_in_parts(code, s, e), return_index=True, return_inverse=True)
    ws, we = s[first], e[first]
    # texts of each class that hold each word; copies, which mostly share their smallest word hash, count as one text
    pairs = np.unique(back.astype(np.int64) * len(y) + r)
    word, doc = pairs // len(y), pairs % len(y)
    least = np.full(len(y), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc, distinct[word])
    texts = np.unique(least, return_inverse=True)[1]
    copies = np.unique(word * (2 * len(y)) + texts[doc] * 2 + (y[doc] == 1))
    in_word, in_bad = copies // (2 * len(y)), copies % 2
    bad = np.bincount(in_word, in_bad, len(distinct))
    good = np.bincount(in_word, 1 - in_bad, len(distinct))
    sure = _telling(bad, good, y)
    np.logical_or.at(told_words, np.searchsorted(starts, s, side="right") - 1, sure[back])
    if not sure.any():
        sure = (good == 0) & (bad == bad[good == 0].max(initial=0)) & (bad > 0)
    of_good = np.flatnonzero((good > 0) & ~sure)
    if not sure.any() or not len(of_good):
        return None
    frequent = of_good[np.lexsort((distinct[of_good], -good[of_good]))]
    telling = np.flatnonzero(sure)
    telling = telling[np.lexsort((distinct[telling], -bad[telling]))]
    witness, hard = telling, frequent[:HARD]
    told = np.zeros(len(y), bool)
    told[doc[sure[word]]] = True
    marks_at = np.concatenate([_spread(telling, LANDMARKS // 2), _spread(frequent[:HARD], LANDMARKS // 2)])
    for _ in range(ROUNDS):
        weights, bias = _machine(code, ws, we, marks_at, witness, hard)
        value = weigh(code, ws, we, weights) + bias
        worst = np.full(len(y), EMPTY)
        np.maximum.at(worst, doc, value[word])
        # next round: also the worst words of toxic documents that have no telling word, and the worst words of clean ones
        fresh = word[(y[doc] == 1) & ~told[doc] & (value[word] >= worst[doc]) & (good[word] == 0) & (value[word] > 0)]
        witness = np.unique(np.concatenate([telling, fresh]))
        confused = of_good[np.lexsort((distinct[of_good], -value[of_good]))]
        hard = np.unique(np.concatenate([hard, confused[:HARD]]))
        weak = telling[np.lexsort((distinct[telling], value[telling]))]
        marks_at = np.unique(np.concatenate([_spread(telling, LANDMARKS // 4), weak[: LANDMARKS // 4], confused[: LANDMARKS // 4],
                                             _spread(frequent[:HARD], LANDMARKS // 4)]))
    return weights, bias


def _fit_phrases(code, starts, ends, row, goes_on, y, told_words) -> Machine | None:
    """The machine of phrases, if some tell the classes apart without a telling word in them."""
    first, last = (np.concatenate(x) for x in zip(*phrases(starts, ends, goes_on), strict=True))
    words_told = np.concatenate([[0], np.cumsum(told_words)])
    own = words_told[last + 1] == words_told[first]
    first, last = first[own], last[own]
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    if not len(first):
        return None
    ws, we, r = starts[first], ends[last], row[first]
    key = hashes_in_parts(code, ws, we)
    toxic = y[r] == 1
    # only phrases of toxic documents can tell anything; clean documents are asked for those
    distinct, at = np.unique(key[toxic], return_index=True)
    at = np.flatnonzero(toxic)[at]
    if not len(distinct):
        return None
    place = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
    known = distinct[place] == key
    pairs = np.unique(place[known].astype(np.int64) * len(y) + r[known])
    # copies of a text count once: documents of the same phrases
    phrase, doc = pairs // len(y), pairs % len(y)
    text = np.full(len(y), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(text, r, key)
    text = np.unique(text, return_inverse=True)[1]
    copies = np.unique(phrase * (2 * len(y)) + text[doc] * 2 + (y[doc] == 1))
    bad = np.bincount(copies // (2 * len(y)), copies % 2, len(distinct))
    good = np.bincount(copies // (2 * len(y)), 1 - copies % 2, len(distinct))
    sure = _telling(bad, good, y)
    clean = np.flatnonzero(~toxic)
    if not sure.any() or not len(clean):
        return None
    telling = at[sure][np.lexsort((distinct[sure], -bad[sure]))]
    clean = clean[~(known[clean] & sure[place[clean]])]
    hard = _spread(clean, HARD)
    marks_at = np.concatenate([_spread(telling, LANDMARKS // 2), _spread(hard, LANDMARKS // 2)])
    for _ in range(ROUNDS):
        weights, bias = _machine(code, ws, we, marks_at, telling, hard)
        value = window_values(code, ws, we, weights)
        worst = clean[np.argsort(-value[clean], kind="stable")]
        confused = worst[np.sort(np.unique(key[worst], return_index=True)[1])][:HARD]
        hard = np.unique(np.concatenate([hard, confused]))
        weak = telling[np.argsort(value[telling], kind="stable")]
        marks_at = np.unique(np.concatenate([_spread(telling, LANDMARKS // 4), weak[: LANDMARKS // 4], confused[: LANDMARKS // 4], _spread(hard, LANDMARKS // 4)]))
    return weights, bias


def _spread(items: np.ndarray, n: int) -> np.ndarray:
    return items[:: max(1, len(items) // n)][:n]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve, by Newton steps on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (t - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> ToxicityModel:
    """The letters of the bounded sample's documents are what is sent to the driver."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", remainder(5) != 0, size)

    def run(batches):
        for b in slices(batches, "text"):
            code, starts, ends, row, goes_on = sentences(b.column("text"))
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            spans = [(int(starts[x]), int(ends[y - 1])) if y > x else (0, 0) for x, y in zip(cuts, cuts[1:], strict=False)]
            parts = [[a[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)] for a in ((ends - starts).astype(np.int32), goes_on)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y").cast(pa.int32()), pa.array([code[x:y].tobytes() for x, y in spans], pa.binary()),
                                              *(pa.array(p, pa.binary()) for p in parts)], names=["doc_id", "y", "codes", "sizes", "goes_on"])

    got = sample.select("doc_id", F.col("y").cast("int"), "text").mapInArrow(run, "doc_id long, y int, codes binary, sizes binary, goes_on binary").toArrow().sort_by("doc_id")
    raw = lambda name, kind: [np.frombuffer(x, kind) for x in got[name].to_pylist()]
    each = raw("sizes", np.int32)
    sizes = np.concatenate([np.zeros(0, np.int32), *each]).astype(np.int64)
    ends = np.cumsum(sizes)
    return fit(np.concatenate([np.zeros(0, np.uint8), *raw("codes", np.uint8)]), ends - sizes, ends, np.repeat(np.arange(len(each)), [len(x) for x in each]),
               np.concatenate([np.zeros(0, bool), *raw("goes_on", bool)]), got["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all, if not given; one called toxicity_score is replaced) and ``toxicity_score`` of every document."""
    prepare(docs.sparkSession)
    carry = [c for c in (carry if carry is not None else docs.columns) if c != "toxicity_score"]

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches, "text"):
            s = model.curve(scorer.worst(b.column("text")).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(s, pa.float64())], names=[*carry, "toxicity_score"])

    schema = docs.select(*carry).withColumn("toxicity_score", F.lit(0.0)).schema
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"),
                                               (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))
