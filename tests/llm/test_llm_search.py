"""Importance resampling, lexical search, rank-queue BPE: brute force, SQL and the library; words whose hashes collide."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import empty, odd, odd_rows, table, words

from tollgate.llm import bpe_queue, grams, importance, lexical, ngram_join, packing, pieces
from tollgate.llm.bpe import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


# ---- the table of n-grams ------------------------------------------------------------------------------------------------

TEXTS = ["Hello, wOrld 12 x", "", None, "ab", "é ü.foo", "end", "a" * 40 + " b " + "c" * 300, "x y x y x y x y", "Ünï-日本語 x{}~ Z"]


def test_kept_words():
    raw, starts, ends, first = grams.kept_words(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert [raw[a:b].tobytes().decode() for a, b in zip(starts[first[i]: first[i + 1]], ends[first[i]: first[i + 1]], strict=True)] == terms(t)


def test_span_hashes():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, sizes = rng.integers(0, 4600, 3000), rng.integers(0, 400, 3000)
    sizes[:2000] %= 40
    lane = grams.lanes(raw)
    spans = [raw[a: a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
    assert grams.xxh64(raw, lane, starts, sizes, 9).tolist() == [xxhash.xxh64_intdigest(s, 9) for s in spans]
    assert grams.crc32(raw, lane, starts, sizes).tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("hashed", [grams.xxh64, lambda raw, lane, starts, sizes: (sizes % 3).astype(np.uint64)])
def test_table_tells_ngrams_apart(hashed):
    """Also where nearly all keys are equal: bytes decide."""
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "b", "ab", "a" * 9, "a" * 8 + "b", "c" * 70, "c" * 69 + "d"]) for _ in range(300))
    raw, starts, ends, _ = grams.kept_words(pa.array([text]))
    t = grams.GramTable(raw, starts, ends - starts, hashed)
    spans = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    owners = [spans[t.owner[s]] for s in t.slot]
    assert owners == spans
    assert {spans[t.owner[s]]: int(t.count[s]) for s in t.used} == collections.Counter(spans)


def test_chunks_hold_every_ngram():
    got = collections.Counter()
    for row, t in grams.gram_chunks(grams.kept_words(pa.array(TEXTS)), 3, chunk=2):
        got.update((int(r), t.raw[t.starts[t.owner[s]]: t.starts[t.owner[s]] + t.sizes[t.owner[s]]].tobytes().decode()) for r, s in zip(row, t.slot, strict=True))
    want = collections.Counter()
    for i, t in enumerate(TEXTS):
        w = terms(t)
        want.update((i, " ".join(w[k: k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert got == want


# ---- op11 ------------------------------------------------------------------------------------------------------------------

def resampled(docs, target):
    """op11 row by row: sorted (doc_id, n_features, weight, score, rank)."""
    def buckets(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[k: k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    own = [buckets(t) for _, t in docs]
    s, t = collections.Counter(b for x in own for b in x), collections.Counter(b for x in target for b in buckets(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for (i, text), x in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100], start=1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_importance_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = resampled(docs, target)
    assert _rows(importance.query(spark, SF)) == want
    assert sum(r[4] is not None for r in want) == 5 * sum(len(terms(t)) >= 20 for _, t in docs) // 100 > 0


def test_importance_odd(spark):
    rng = random.Random(3)
    rows = odd_rows() + [(100 + k, words(rng, 30, 40)) for k in range(90)]
    target = [words(rng, 50, 40), None, ""]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert _rows(importance.importance(table(spark, rows), items)) == resampled(rows, target)
    assert _rows(importance.importance(table(spark, rows), items.limit(0))) == resampled(rows, [])
    assert importance.importance(empty(spark), items).count() == 0
    drawn = importance.resample(table(spark, rows), items, percent=50)
    assert drawn.columns == table(spark, rows).columns
    ids = {r[0] for r in _rows(importance.importance(table(spark, rows), items, percent=50)) if r[4] is not None}
    assert {r.doc_id for r in drawn.collect()} == ids


# ---- op12 ------------------------------------------------------------------------------------------------------------------

def ranked(docs, items, k=10):
    """op12 row by row: (item's place, rank, doc_id, score)."""
    counts = [collections.Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        own = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scored = []
        for j, c in enumerate(counts):
            if n[j]:
                m = 100 - 90 + (90 * n[j] * big_n) // big_l
                s = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in own.items() if c[t])
                if s > 0:
                    scored.append((-s, docs[j][0] is None, docs[j][0] or 0, docs[j][0]))
        out += [(place, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def test_search_query_is_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(lexical.SQL).fetchall())
    got = lexical.query(spark, SF).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


@pytest.mark.parametrize("shard,block", [(1 << 21, 1 << 22), (50, 1 << 22), (300, 40_000)])
def test_search_odd(spark, shard, block):
    """Shards of few postings, items in blocks: the same answers."""
    rng = random.Random(4)
    rows = odd_rows() + [(100 + k, words(rng, rng.randrange(1, 60), 30)) for k in range(150)]
    rows += [(500 + k, "w1 w2 w3") for k in range(30)]  # ties beyond the tenth
    items = [(0, "w1 w2 w3"), (1, None), (2, ""), (3, "W1, w1; w5 nothing-like-it"), (4, rows[4][1]), (5, "w9"), (3, "w7 w8"), (None, "w2")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.search(table(spark, rows).repartition(3), frame, shard=shard, block_bytes=block)
    want = ranked(rows, items)
    flat = lambda rs: sorted(((items[p][0], r, d, s) for p, r, d, s in rs), key=repr)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == flat(want)
    assert lexical.search(empty(spark), frame).count() == 0
    assert lexical.search(table(spark, rows), frame.limit(0)).count() == 0


def test_reading_stops_when_settled():
    rng = np.random.default_rng(2)
    for n, k, top in ((40, 3, 5), (500, 10, 1000), (2000, 10, 10), (2000, 10, 10**9), (7, 10, 3)):
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 8)):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            impact = np.sort(rng.integers(1, top + 1, len(docs)))[::-1]
            lists.append((docs, impact.astype(np.int64)))
            total[docs] += impact
        order = rng.permutation(n)
        best = sorted(range(n), key=lambda d: (-total[d], order[d]))[:k]
        for step in (1, 3, 64):
            assert lexical.nra(lists, order, k, step) == [(d, int(total[d])) for d in best if total[d] > 0]


def test_reading_does_not_go_to_the_end():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice) and at.start:
                Counted.read = max(Counted.read, min(at.stop, len(self)))
            return np.asarray(self)[at]
    n = 100_000
    impact = np.concatenate([np.full(10, 10**6), np.ones(n - 10, np.int64)])
    docs = np.arange(n).view(Counted)
    assert lexical.nra([(docs, impact)], np.arange(n)) == [(d, 10**6) for d in range(10)]
    assert Counted.read < 1000


# ---- op13 ------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return bpe_queue.Vocabulary(bpe_queue.vocabulary_file()[0])


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=bpe_queue.vocabulary_file()[1], mergeable_ranks=vocabulary.ranks, special_tokens={})


def _merges(word, ranks):
    """The definition: least rank first, leftmost of equal ones."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i: i + 2] = [parts[i] + parts[i + 1]]


def _split(ids, size):
    at = np.concatenate([[0], np.cumsum(size)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_merges_of_made_vocabularies(tmp_path):
    """Vocabularies in which merges make pairs of lower rank."""
    for seed in range(25):
        rng = random.Random(seed)
        more = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)})
        rng.shuffle(more)
        ranks = {bytes([b]): b for b in range(256)} | {m: 256 + i for i, m in enumerate(more)}
        path = tmp_path / f"{seed}.tiktoken"
        path.write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()))
        own = bpe_queue.Vocabulary(str(path))
        todo = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 80))) for _ in range(100)]
        assert own.early and _split(*own.merge(todo)) == [_merges(w, ranks) if w else [] for w in todo]


def test_pretokens_as_the_library(vocabulary, library):
    rng = random.Random(1)
    early, every = [vocabulary.bytes[e] for e in vocabulary.early], list(vocabulary.ranks)
    todo = [b"".join(rng.choice(early if rng.random() < 0.6 else every) for _ in range(rng.randrange(1, 6))) for _ in range(4000)]
    todo += [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(500)] + [rng.choice(early) * rng.randrange(1, 400) for _ in range(50)]
    todo += [b"a" * 40_000, bytes(rng.choice(b"abcdef") for _ in range(20_000))]
    assert _split(*vocabulary.merge(todo)) == [library._core_bpe.encode_single_piece(w) for w in todo]


def _digests(texts, library):
    out = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_byte_bpe_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe_queue.query(spark, SF).collect()), key=repr) == _digests(docs, library)


def test_byte_bpe_odd(spark, library):
    rows = odd_rows() + [(50, "x" * 30_000), (51, "日本" * 3000), (52, "  a\n\n b 's don't 123   é́"), (53, "<|endoftext|> \x00\x7f")]
    assert sorted(map(tuple, bpe_queue.digest_columns(table(spark, rows)).collect()), key=repr) == _digests(rows, library)
    back = bpe_queue.decode(bpe_queue.encode(table(spark, rows), carry=("doc_id", "text", "row")))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect()) and back.count() == len(rows)
    assert bpe_queue.digest_columns(empty(spark)).count() == 0


# ---- words whose hashes collide ----------------------------------------------------------------------------------------------

def opposite(n):
    """A Thue-Morse word and its complement: sums of powers modulo 2**64 are equal from 1,024 letters on, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_colliding_words_keep_their_ids(n, library):
    import sentencepiece
    a, b = opposite(n)
    col = pa.array([a, b, f"{b} {a} {b}", f"x {a}"])
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    for make, want in ((lambda: Encoder(*packing.vocabulary()), library.encode_ordinary), (lambda: bpe_queue.QueueEncoder(*bpe_queue.vocabulary_file()), library.encode_ordinary),
                       (lambda: pieces.PieceEncoder(pieces.Pieces(pieces.model_file())), lambda t: model.encode(t))):
        encoder = make()
        for part in (col, pa.array([b]), pa.array([a])):  # met in one slice, and known from an earlier one
            ids, off = encoder.encode(part)
            assert _split(ids, np.diff(off)) == [want(t) for t in part.to_pylist()]


def test_equal_hashes_of_all_words(library):
    encoder = Encoder(*packing.vocabulary())
    encoder.hashes = lambda cp, starts, ends: np.zeros(len(starts), np.uint64)
    texts = ["some words and words again", "", "other words", "some"]
    for _ in range(2):
        ids, off = encoder.encode(pa.array(texts))
        assert _split(ids, np.diff(off)) == [library.encode_ordinary(t) for t in texts]


def test_colliding_texts_are_no_copies(spark):
    a, b = opposite(2048)
    rows = [(1, a), (2, b), (3, a), (4, "a few other words here")]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.jaccard_join(table(spark, rows)).collect()}
    assert got == {1: (1, 1, 2), 3: (1, 1, 2), 2: (2, 0, 1), 4: (4, 0, 1)}
