"""Exact dedup, line dedup, n-gram join against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import empty, odd, odd_rows, table, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tollgate.llm import exact_dedup, line_dedup, ngram_join
from tollgate.llm.components import components
from tollgate.llm.cuckoo import CuckooIndex


# ---- exact dedup ---------------------------------------------------------------------------------------------------------

def _keys(values):
    return np.array([[int.from_bytes(hashlib.sha256(str(v).encode()).digest()[8 * i: 8 * i + 8], "big") for i in range(4)] for v in values],
                    np.uint64).reshape(-1, 4)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.lists(st.integers(0, 300), unique=True, min_size=1, max_size=60)), max_size=12))
def test_cuckoo_index_is_a_set(steps):
    index, live = CuckooIndex(8), set()
    for insert, values in steps:
        if insert:
            index.insert(_keys(values))
            live |= set(values)
        else:
            assert index.delete(_keys(values)).tolist() == [v in live for v in values]
            live -= set(values)
        assert (index.find(_keys(range(301))) >= 0).tolist() == [v in live for v in range(301)]


def test_cuckoo_overflow_resizes_from_stored_keys():
    index = CuckooIndex(4, max_kicks=8)
    index.insert(_keys(range(5000)))
    assert index.resizes > 0 and (index.find(_keys(range(5000))) >= 0).all() and (index.find(_keys(range(5000, 6000))) < 0).all()


def test_fingerprint_hits_are_verified():
    index = CuckooIndex(64)
    a = _keys([1])
    b = a.copy()
    b[0, 2] += np.uint64(1)  # the same fingerprint and buckets, another digest
    index.insert(a)
    assert index.find(b)[0] < 0


def _brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    first, size = {}, collections.Counter(norm)
    for n, (i, _) in enumerate(rows):
        rank = (i is None, i or 0)
        if norm[n] not in first or rank < first[norm[n]]:
            first[norm[n]] = rank
    return sorted(((i, None if first[t][0] else first[t][1], size[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=repr)


def test_exact_dedup(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, f"text  {rng.randrange(30)}\n") for i in range(200)]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == _brute_exact(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_index_updates(spark):
    docs = table(spark, [(i, f"t{i % 5}") for i in range(20)])
    hashed = exact_dedup.digests(docs)
    index = exact_dedup.build_index(hashed, 20)
    gone = index.where("keep_id in (0, 1)").select("digest")
    new = exact_dedup.digests(table(spark, [(50, "t1"), (51, "t9"), (52, "t2")]))
    after = {r.keep_id: r.group_size for r in exact_dedup.update_index(index, new, gone).collect()}
    assert after == {2: 5, 3: 4, 4: 4, 50: 1, 51: 1}


# ---- line dedup ----------------------------------------------------------------------------------------------------------

def test_patience_aligns_in_order():
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 1, 6]
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 6)]
    assert line_dedup.common_lines([0, 7, 0], [0, 8, 0]) == set()  # blank lines alone are no block


def test_repeated_and_moved_passages_go():
    assert line_dedup.common_lines([8, 1, 2, 9, 1, 2, 7], [5, 1, 2, 6]) == {1, 2, 4, 5}  # twice in the later one
    assert line_dedup.common_lines([8, 1, 2, 9], [1, 2, 5, 1, 2]) == {1, 2}  # twice in the earlier one
    assert line_dedup.common_lines([3, 0, 4, 9, 1, 2, 7], [1, 2, 6, 3, 0, 4]) == {0, 1, 2, 4, 5}  # in another order
    assert line_dedup.common_lines([8, 1, 0, 9, 0, 2], [1, 6, 2, 0]) == {1, 5}  # blanks of its own stay


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=25), st.lists(st.integers(0, 12), max_size=25))
def test_patience_pairs_are_a_common_subsequence(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)


def _brute_lines(rows):
    """What is left of each (doc_id, text)."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    heads, left = {}, {}
    clean = lambda t: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")]
    for n in order:
        i, t = rows[n][0], rows[n][1] or ""
        heads.setdefault(t, i)
    texts = [t for t in sorted(heads, key=lambda t: (heads[t] is None, heads[t] or 0))]
    owner, count = {}, collections.Counter()
    # ties of owners by doc_id don't occur between different texts with shared lines here
    for t in texts:
        for x in set(clean(t)) - {""}:
            owner.setdefault(x, t)
            count[x] += 1
    for i, t in rows:
        t = t or ""
        lines = clean(t)
        if heads[t] != i:
            left[i, t] = "" if any(lines) else t
            continue
        shared = collections.defaultdict(list)
        for x in set(lines) - {""}:
            if owner[x] != t:
                shared[owner[x]].append(x)
        gone = set()
        number = {x: n + 1 for n, x in enumerate(sorted(set(lines) | {y for o in shared for y in clean(o)}))}
        number[""] = 0
        for o, xs in shared.items():
            if min(count[x] for x in xs) <= line_dedup.RARE or len(xs) >= line_dedup.LINES or sum(map(len, xs)) >= line_dedup.CHARS:
                gone |= line_dedup.common_lines([number[x] for x in lines], [number[x] for x in clean(o)])
        left[i, t] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) if gone else t
    return left


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [words(rng, 8) for _ in range(60)]
    rows = odd_rows() + [(100 + i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else words(rng, 6) for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    rows += [(400 + i, "the very common line\n" + words(rng, 10)) for i in range(150)]
    docs = table(spark, rows)
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_removed"]
    want = _brute_lines(rows)
    got = collections.Counter((r.doc_id, r.text or "", r.n_lines) for r in out.collect())
    assert got == collections.Counter((i, want[i, t or ""], (t or "").count("\n") + 1) for i, t in rows)
    # a line that over 100 texts hold is no reason to align, and clean documents stay whole
    assert all(r.text.startswith("the very common line\n") for r in out.where("doc_id >= 400").collect())
    assert line_dedup.line_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("rare", [3, None])
def test_lines_left_by_their_definition(spark, rare):
    """Without the library's alignment: of a document's lines those go that an earlier document it is paired with holds."""
    rng = random.Random(11)
    pool = [words(rng, rng.choice([2, 6, 30])) for _ in range(40)]
    rows = []
    for i in range(60):
        own = [words(rng, 8) for _ in range(rng.randrange(1, 6))]
        some = rng.sample(pool, rng.randrange(0, 6))
        lines = own + some * rng.choice([1, 1, 2])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(table(spark, rows), rare=rare).collect()}
    lines = {i: t.split("\n") for i, t in rows}
    holds = collections.Counter(x for ls in lines.values() for x in set(ls))
    first = {x: min(i for i, ls in lines.items() if x in ls) for x in holds}
    big = lambda xs: len(xs) >= line_dedup.LINES or sum(map(len, xs)) >= line_dedup.CHARS
    for i, ls in lines.items():
        taken = {x for x in ls if first[x] < i}
        owners = collections.defaultdict(set)
        for x in taken:
            owners[first[x]].add(x)
        paired = {o for o, xs in owners.items() if rare is None or min(holds[x] for x in xs) <= rare or big(xs)}
        gone = {x for x in ls if any(x in lines[o] for o in paired)}
        if rare is not None and big(taken):
            gone |= {x for o, xs in owners.items() if o not in paired for x in xs if holds[x] > rare}
        assert got[i] == ([x for x in ls if x not in gone] or [""]), i


def test_line_dedup_hot_lines_of_several_owners(spark):
    """A block whose lines first occur in three documents goes however many texts hold it; a lone line of that kind stays."""
    rng = random.Random(3)
    block = ["first line of the block", "second line of the block", "third line of the block"]
    rows = [(i, words(rng, 9) + "\n" + block[i]) for i in range(3)]
    rows += [(10 + i, words(rng, 9) + f"\n{block[0]}\n\n{block[1]}\n{block[2]}\n" + words(rng, 9) + (f"\n{block[1]}" if i % 2 else "")) for i in range(120)]
    rows += [(300 + i, words(rng, 9) + "\n" + block[2]) for i in range(3)]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    for i, t in rows:
        want = [x for x in t.split("\n") if x not in block] if 10 <= i < 300 else t.split("\n")
        assert got[i] == want


# ---- n-gram join ---------------------------------------------------------------------------------------------------------

def _sets(rows):
    split = [[x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x] for _, t in rows]
    return [tuple(w) for w in split], [{tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]


def _brute_join(rows):
    seqs, sets = _sets(rows)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rank = lambda x: (rows[x][0] is None, rows[x][0] or 0)
    low = {}
    for x in range(n):
        low[find(x)] = min(low.get(find(x), x), x, key=rank)
    copies = collections.Counter(seqs)
    return sorted(((rows[x][0], rows[low[find(x)]][0] if sets[x] else rows[x][0], links[x], copies[seqs[x]]) for x in range(n)), key=repr)


def _near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_ngram_join(spark):
    rng = random.Random(3)
    rows = odd_rows()
    for base in range(6):
        text = words(rng, 120)
        rows += [(1000 + 100 * base + i, _near(rng, text, rng.randrange(6))) for i in range(25)]
    rows += [(5000 + i, words(rng, rng.randrange(1, 30), 60)) for i in range(100)]
    got = ngram_join.jaccard_join(table(spark, rows), block=8)  # small blocks: pairs within and across
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got.collect()), key=repr) == _brute_join(rows)
    assert ngram_join.jaccard_join(empty(spark)).count() == 0
    assert ngram_join.jaccard_join(table(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()[1][:3] == (2, 2, 0)


def test_posterior_limits():
    # the tail of the Beta posterior, by numeric integration
    for n, m in ngram_join.least_matches(0.8, 1e-4).items():
        x = (np.arange(200_000) + 0.5) / 200_000
        for k, enough in ((m, True), (m - 1, False)):
            if k >= 0:
                log = k * np.log(x) + (n - k) * np.log1p(-x)
                d = np.exp(log - log.max())
                assert (d[x >= 0.8].sum() / d.sum() >= 1e-4) == enough


@pytest.mark.parametrize("dense", [True, False])
def test_overlaps(dense):
    rng = np.random.default_rng(0)
    pool = 60 if dense else 5000
    sets = [np.unique(rng.integers(0, pool, 50).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    assert ngram_join.overlaps(sets, sets, i, j).tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)]


def test_shingles_of_long_and_short_rows():
    grams, at, k1, _ = ngram_join.shingle_sets(pa.array(["a b c d e f", "A b  C d e\tf", "a b", None, "b c d e f"]))
    assert np.diff(at).tolist() == [2, 2, 1, 0, 1]
    assert grams[1] == grams[5] and k1[0] == k1[1] and len(set(k1.tolist())) == 4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
