"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Shingles are five lower-cased words in a row (a shorter text is one shingle).  Texts of equal words are one class and are
compared once, with their number as weight.  Classes that share a MinHash band are candidates; bands only
hang them together, as stars, into groups, and groups are compared in blocks of a bounded size.  Within a pair of
blocks MinHash values are compared a step at a time; a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold (uniform prior) falls below ``TOLERANCE``.  What remains is verified on the
whole shingle sets.  Blocks return numbers of links and a spanning forest, never all pairs.

A pair at 0.8 shares none of 32 bands of 4 values with probability 5e-8, and is dropped by the posterior with
less than 1e-6; likelier pairs less often.

Defined cases: null text counts as empty; a text without words has no links and is a class of its own; an
empty table gives no rows; rows repeated whole are documents that link to each other; a null doc_id counts as the largest
and comes out null; a text of any length is compared by all of its shingles; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import grouped_arrow, prepare, scratch, slices, table
from tollgate.llm.components import components
from tollgate.llm.grams import lanes, xxh64
from tollgate.llm.textvec import SPACE, buffers, mix, shingles, words

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-7
BLOCK = 512
LAST = (1 << 63) - 1


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(seeds[:HASHES]) | np.uint64(1), mix(seeds[HASHES:])


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, offsets, key 1, key 2) of a text column; the keys are a digest of the sequence of words."""
    raw, off = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, first = words(raw, off)
    word = xxh64(raw, lanes(raw), starts, ends - starts)
    grams, at = shingles(word, first, WIDTH)
    # a text's words with one space between, as bytes
    keep = np.zeros(len(raw) + 1, bool)
    keep[:-1] = ~SPACE[raw]
    keep[ends] = True
    place = np.cumsum(keep) - 1
    joined = memoryview(np.where(SPACE[raw], 32, raw).astype(np.uint8)[keep[:-1]])
    a = place[starts[np.minimum(first[:-1], max(len(starts) - 1, 0))]] if len(starts) else np.zeros(len(first) - 1, np.int64)
    size = np.zeros(len(first) - 1, np.int64)
    some = np.flatnonzero(np.diff(first) > 0)
    last = first[some + 1] - 1
    size[some] = place[starts[last]] + (ends[last] - starts[last]) - a[some]
    key = np.frombuffer(b"".join(hashlib.blake2b(joined[x: x + n], digest_size=16).digest() for x, n in zip(a.tolist(), size.tolist(), strict=True)), np.int64)
    return grams, at, key[0::2].copy(), key[1::2].copy()


def signatures(grams: np.ndarray, at: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """(rows, HASHES) MinHash values (uint32); rows without shingles hold the largest value."""
    n = len(at) - 1
    out = np.full((n, HASHES), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    a, b = _coefficients()
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(at[full + 1], at[full[i]] + chunk, side="right")))
        rows = full[i:j]
        x = grams[at[rows[0]]: at[rows[-1] + 1]]
        cuts = at[rows] - at[rows[0]]
        for k in range(HASHES):
            out[rows, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), cuts)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of the bands, which include their number."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For 16, 32, ... compared values: the fewest matches at which P(similarity >= threshold) reaches the tolerance.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) posterior, whose upper tail at t is the
    probability of at most m successes in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def likely_pairs(a: np.ndarray, b: np.ndarray, same: bool, limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks that the posterior doesn't rule out (i < j within one block)."""
    found_i, found_j = [], []
    for lo in range(0, len(a), 64):
        part = a[lo: lo + 64]
        match = (part[:, None, :STEP] == b[None, :, :STEP]).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(match >= limits[STEP])
        m = match[i, j].astype(np.int64)
        i = i + lo
        if same:
            keep = i < j
            i, j, m = i[keep], j[keep], m[keep]
        for n in range(2 * STEP, HASHES + 1, STEP):
            m = m + (a[i, n - STEP: n] == b[j, n - STEP: n]).sum(axis=1)
            keep = m >= limits[n]
            i, j, m = i[keep], j[keep], m[keep]
        found_i.append(i)
        found_j.append(j)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs of sorted distinct shingle sets."""
    if not len(i):
        return np.zeros(0, np.int64)
    sizes_b = np.array([len(x) for x in b])
    ua, ub = np.unique(i), np.unique(j)
    every, back = np.unique(np.concatenate([*(a[x] for x in ua), *(b[x] for x in ub)]), return_inverse=True)
    dense = 2.0 * len(ua) * len(ub) * len(every) / 4e9
    direct = sizes_b[j].sum() * 5e-8 + 1e-5 * len(ua)
    if dense < direct:
        rows = np.concatenate([np.full(len(s[x]), n) for s, u in ((a, ua), (b, ub)) for n, x in enumerate(u)])
        cut = sum(len(a[x]) for x in ua)
        hits = np.zeros((len(ua), len(ub)), np.float64)
        for lo in range(0, len(every), 4096):
            width = min(4096, len(every) - lo)
            m = []
            for part, r, n in ((back[:cut], rows[:cut], len(ua)), (back[cut:], rows[cut:], len(ub))):
                inside = (part >= lo) & (part < lo + width)
                x = np.zeros((n, width), np.float32)
                x[r[inside], part[inside] - lo] = 1
                m.append(x)
            hits += m[0] @ m[1].T
        return np.rint(hits[np.searchsorted(ua, i), np.searchsorted(ub, j)]).astype(np.int64)
    out = np.empty(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        mine = a[i[own[0]]]
        flat = np.concatenate([b[x] for x in j[own]])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        out[own] = np.add.reduceat(mine[at] == flat, np.cumsum(sizes_b[j[own]]) - sizes_b[j[own]])
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Some of the edges that connect what all of them do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _join_blocks(threshold: float, limits: dict[int, int]):
    def fn(group: pa.Table) -> pa.Table | None:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        blk, cid, weight = group["blk"].to_numpy(), group["cid"].to_numpy(), group["m"].to_numpy()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        if not len(left) or not len(right):
            return None
        i, j = likely_pairs(sig[left], sig[right], bi == bj, limits)
        a, b = [sets[x] for x in left], [sets[x] for x in right]
        shared = overlaps(a, b, i, j)
        size = np.array([len(x) for x in sets])
        hit = shared / (size[left[i]] + size[right[j]] - shared) >= threshold if len(i) else np.zeros(0, bool)
        u, v = left[i[hit]], right[j[hit]]
        if not len(u):
            return None
        links = np.bincount(u, weight[v], len(cid)) + np.bincount(v, weight[u], len(cid))
        some = np.flatnonzero(links)
        edges = _forest(cid[u], cid[v])
        return pa.table({"u": np.concatenate([cid[some], np.array([e[0] for e in edges], np.int64)]),
                         "v": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
                         "n": pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(edges)], pa.int64())})
    return fn


def _prints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the keys of its words, its number of shingles (repeated ones counted) and its band keys."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text"):
            grams, at, k1, k2 = shingle_sets(b.column("text"))
            n = np.diff(at)
            bands = band_keys(signatures(grams, at))
            flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32), pa.array(bands[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(n), flat],
                                             names=["doc_id", "k1", "k2", "n", "bands"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


def _with_sets(members: DataFrame) -> DataFrame:
    """The members' MinHash values and sorted distinct shingles; a row whose words aren't its class's is another one's."""
    prepare(members.sparkSession)

    def run(batches):
        for b in slices(batches, "text"):
            grams, at, k1, k2 = shingle_sets(b.column("text"))
            own = np.flatnonzero((k1 == b.column("k1").to_numpy()) & (k2 == b.column("k2").to_numpy()))
            sig = signatures(grams, at)
            part = b.take(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("cid", "m", "comp", "blk", "nb")), pa.array([sig[x].tobytes() for x in own], pa.binary()),
                 pa.array([np.unique(grams[at[x]: at[x + 1]]).tobytes() for x in own], pa.binary())],
                names=["cid", "m", "comp", "blk", "nb", "sig", "grams"])

    return members.mapInArrow(run, "cid long, m long, comp long, blk int, nb int, sig binary, grams binary")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row: doc_id, class_id (smallest doc_id that links lead to), n_links (other rows at the threshold or over)
    and n_copies (rows of the same words)."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    prints = scratch(_prints(source), "prints")
    classes = scratch(prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("head"), F.count("*").alias("m"), F.max("n").alias("n"),
                                                     F.first("bands").alias("bands"))
                      .select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    rows = classes.select("cid", F.explode("bands").alias("band"))
    stars = rows.groupBy("band").agg(F.min("cid").alias("low"), F.count("*").alias("c")).where("c > 1").select("band", "low")
    edges = rows.join(stars, "band").where("cid != low").select(F.col("cid").alias("u"), F.col("low").alias("v")).distinct()
    groups = scratch(components(edges, "candidates"), "groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    members = groups.join(sizes, "root").join(classes.drop("bands"), groups["node"] == classes["cid"]).select(
        "cid", "head", "k1", "k2", "m", F.col("root").alias("comp"), F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int").alias("blk"), "nb")
    texts = source.join(members.hint("shuffle_hash"), source["doc_id"] == members["head"]).drop("head")
    sets = _with_sets(texts).dropDuplicates(["cid"])
    dealt = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "comp", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "cid", "m", "sig", "grams")
    joined = scratch(grouped_arrow(dealt, ["comp", "bi", "bj"], _join_blocks(threshold, least_matches(threshold, tolerance)), "u long, v long, n long"), "links")
    links = joined.where("n is not null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
    forest = scratch(components(joined.where("v is not null").select("u", "v"), "links"), "forest")
    linked = classes.drop("bands").join(links, "cid", "left").join(forest.withColumnRenamed("node", "cid"), "cid", "left")
    lowest = linked.where("root is not null").groupBy("root").agg(F.min("head").alias("low"))
    known = linked.join(lowest, "root", "left").select("k1", "k2", F.coalesce("low", "head").alias("class_id"), "m", "n",
                                                       F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    named = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    out = prints.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).withColumn(
        "class_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select(named("doc_id"), named("class_id"), F.when(F.col("n") == 0, 0).otherwise(F.col("m") - 1 + F.col("links")).cast("long").alias("n_links"),
                      F.col("m").alias("n_copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT min(doc_id) AS head, count(*) AS m, w FROM w GROUP BY w),
s AS (
  SELECT DISTINCT head, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g
  FROM (SELECT head, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM c WHERE len(w) > 0)),
n AS (SELECT head, count(*) AS n FROM s GROUP BY head),
p AS (SELECT a.head AS u, b.head AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.head <> b.head GROUP BY a.head, b.head),
l AS (SELECT u, v FROM p JOIN n x ON x.head = u JOIN n y ON y.head = v WHERE p.c / (x.n + y.n - p.c) >= {THRESHOLD}),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
k AS (
  SELECT c.head, c.w, c.m, coalesce((SELECT sum(o.m) FROM l JOIN c o ON o.head = l.v WHERE l.u = c.head), 0) AS links,
    least(c.head, coalesce((SELECT min(r.v) FROM r WHERE r.u = c.head), c.head)) AS class_id FROM c)
SELECT w.doc_id, CASE WHEN len(w.w) = 0 THEN w.doc_id ELSE k.class_id END AS class_id,
  CASE WHEN len(w.w) = 0 THEN 0 ELSE k.m - 1 + k.links END::BIGINT AS n_links, k.m AS n_copies
FROM w JOIN k ON w.w = k.w
"""
