"""Ranked lexical search by NRA: impact-sorted lists read in sequence, no random access.

A term's impact in a document is its weight times its damped frequency, all in whole numbers.  One pass over the documents keeps, per
document, its number of terms and the frequencies of those terms that the items ask for; document frequencies are summed from per-task
counts.  The search then streams that table: each shard of at most ``SHARD`` postings is turned into one list a term, sorted by
impact.  For an item the lists are read a step at a time.  A document's lower bound is the sum of its impacts read; the upper
bound adds, for the lists it was not yet met in, the impact these lists have come down to.  Reading stops when the k best are settled:
no other document, met or not, can reach them, ties included, and each of their own intervals has closed.  Shards return
k rows an item, of which the best k are the answer; nothing else is shuffled.

Items are taken in blocks whose texts hold at most ``BLOCK_BYTES`` (an item at least), so that what tasks get
of them is bounded however many there are; a document's pass is repeated per block.

Defined cases: null and empty texts have no terms, as documents they are not counted and as items find nothing; a null doc_id
sorts last; rows repeated whole are ranked each; items that repeat an item_id are answered each; empty tables give no rows; texts of any
length are worked off in chunks of words; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.common import prepare, scratch, slices, table
from tollgate.llm.grams import gram_chunks, kept_words

TOP = 10
SLICE = 1 << 20
SHARD = 1 << 21
STEP = 64
BLOCK_BYTES = 4 << 20
NONE = (1 << 63) - 1
HITS = "item int, doc_id long, row long, score long"


# ---- terms ------------------------------------------------------------------------------------------------------------

def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items, numbered (column ``item``), in parts of at most ``block_bytes`` of text or of a single item."""
    numbered = scratch(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")), "items")
    size = F.octet_length("text")
    # what an item adds to a block; longer ones have one of their own anyhow
    total = numbered.agg(F.sum(F.least(size, F.lit(block_bytes)))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        sizes = numbered.groupBy(block.alias("b")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c")).collect()
        if all(r.s <= block_bytes or r.c == 1 for r in sizes):
            return [numbered.where(block == r.b) for r in sorted(sizes)]
        n *= 2


def _terms_of(column: pa.Array) -> list[set[bytes]]:
    """The distinct terms of each text."""
    raw, starts, ends, first = kept_words(column)
    view = raw.tobytes()
    return [{view[a:b] for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)} for x, y in zip(first, first[1:], strict=False)]


def item_terms(block: DataFrame) -> tuple[list[tuple[int, object, list[int]]], list[bytes]]:
    """((item number, item_id, numbers of its terms), ...) and the terms themselves, of one block of bounded size."""
    rows = block.select("item", "item_id", "text").collect()
    terms = _terms_of(pa.array([r.text for r in rows], pa.string()))
    known = sorted(set().union(*terms))
    at = {t: i for i, t in enumerate(known)}
    return [(r.item, r.item_id, sorted(at[t] for t in own)) for r, own in zip(rows, terms, strict=True)], known


def forward(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(row, doc_id, n, term, tf): per document its number of terms, and the asked ones' numbers and frequencies."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(terms)  # bounded by the block

    def run(batches):
        at = {t: i for i, t in enumerate(shared.value)}
        for b in slices(batches, "text", SLICE):
            words = kept_words(b.column("text"))
            keys, counts = [], []
            for row, grams in gram_chunks(words, 1):
                own = grams.owner[grams.used]
                view = memoryview(grams.raw)
                number = np.full(len(grams.owner), -1, np.int64)
                number[grams.used] = [at.get(bytes(view[a: a + n]), -1) for a, n in zip(grams.starts[own].tolist(), grams.sizes[own].tolist(), strict=True)]
                term = number[grams.slot]
                asked = np.flatnonzero(term >= 0)
                k, c = np.unique(row[asked] * len(at) + term[asked], return_counts=True)
                keys.append(k)
                counts.append(c)
            # a text may reach over chunks
            key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            tf = np.bincount(back, np.concatenate([np.zeros(0, np.int64), *counts]), len(key)).astype(np.int64)
            width = max(1, len(at))
            off = np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(np.diff(words[3])), pa.ListArray.from_arrays(off, pa.array((key % width).astype(np.int32))),
                 pa.ListArray.from_arrays(off, pa.array(tf))], names=["row", "doc_id", "n", "term", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n long, term array<int>, tf array<long>")


def document_frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each asked term: a row a term leaves a task."""
    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column("term").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in postings.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


# ---- the reading --------------------------------------------------------------------------------------------------------

def nra(lists: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, k: int = TOP, step: int = STEP) -> list[tuple[int, int]]:
    """The k best (document, score), best first, of score over 0.

    ``lists``: per term (documents, impacts) by falling impact, a document once a list; ``order``: each document's place among ties.
    Only reads lists from the front, ``step`` entries further each round (twice as many the next time).
    """
    lists = [x for x in lists if len(x[0])]
    n = len(order)
    depth = 0
    lower = np.zeros(n, np.int64)
    met = np.zeros(n, bool)
    while True:
        end = depth + step
        for docs, impacts in lists:
            lower[docs[depth:end]] += impacts[depth:end]
            met[docs[depth:end]] = True
        depth, step = end, 2 * step
        # what each list can still bring: nothing if it is read to its end
        coming = [int(impacts[depth - 1]) if depth < len(docs) else 0 for docs, impacts in lists]
        most = sum(coming)
        seen = np.flatnonzero(met)
        open_ = np.full(n, most, np.int64)
        for (docs, _), c in zip(lists, coming, strict=True):
            if c:
                open_[docs[:depth]] -= c
        low = lower[seen]
        if len(seen) > k:
            floor = np.partition(low, len(seen) - k)[len(seen) - k]
            near = seen[low >= floor]
        else:
            floor, near = 0, seen
        best = near[np.lexsort((order[near], -lower[near]))][:k]
        if most == 0:
            break
        if len(best) == k and not open_[best].any() and most < lower[best[-1]]:
            rival = seen[lower[seen] + open_[seen] >= floor]
            rival = rival[~np.isin(rival, best)]
            last = best[-1]
            reach = lower[rival] + open_[rival]
            if not ((reach > lower[last]) | ((reach == lower[last]) & (order[rival] < order[last]))).any():
                break
    return [(int(d), int(lower[d])) for d in best if lower[d] > 0]


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Each posting's impact: frequency ``tf`` in a document of ``n`` terms, of a term of this weight."""
    wide = len(n) and 90 * int(n.max()) * n_docs >= 1 << 63
    m = 10 + ((90 * n.astype(object) * n_docs) // n_words if wide else (90 * n * n_docs) // n_words)
    return (weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))).astype(np.int64)


def _search_shard(batches: list[pa.RecordBatch], items: list[tuple[int, list[int]]], weight: np.ndarray, n_docs: int, n_words: int, k: int):
    both = pa.Table.from_batches(batches).combine_chunks()
    size = both["term"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(size)), size)
    term = both["term"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tf = both["tf"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids = both["doc_id"].fill_null(NONE).to_numpy(zero_copy_only=False)
    row = both["row"].to_numpy(zero_copy_only=False)
    impact = impacts(tf, both["n"].to_numpy(zero_copy_only=False)[doc], weight[term], n_docs, n_words)
    some = np.flatnonzero(impact > 0)
    some = some[np.lexsort((doc[some], -impact[some], term[some]))]
    doc, impact = doc[some], impact[some]
    cut = np.searchsorted(term[some], np.arange(len(weight) + 1))
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((row, ids))] = np.arange(len(ids))
    found = [(number, d, s) for number, terms in items
             for d, s in nra([(doc[cut[t]: cut[t + 1]], impact[cut[t]: cut[t + 1]]) for t in terms], place, k)]
    at = np.array([f[1] for f in found], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int32()), pa.array(ids[at], pa.int64(), mask=ids[at] == NONE), pa.array(row[at], pa.int64()),
         pa.array([f[2] for f in found], pa.int64())], names=["item", "doc_id", "row", "score"])


def search_block(docs: DataFrame, block: DataFrame, k: int = TOP, shard: int = SHARD) -> DataFrame:
    """The k best documents of each item of a block: (item_id, item, rank, doc_id, score)."""
    spark = docs.sparkSession
    asked, terms = item_terms(block)
    postings = scratch(forward(docs, terms), "postings")
    n_docs, n_words = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(postings, len(terms))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast(([(i, own) for i, (_, _, own) in enumerate(asked)], weight))

    def run(batches):
        items, w = shared.value
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += len(b.column("term").flatten()) + b.num_rows
            if size >= shard:
                yield _search_shard(held, items, w, n_docs, n_words, k)
                held, size = [], 0
        if held:
            yield _search_shard(held, items, w, n_docs, n_words, k)

    hits = postings.where("size(term) > 0").mapInArrow(run, HITS)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kind = block.schema["item_id"].dataType
    names = spark.createDataFrame([(i, name, item) for i, (item, name, _) in enumerate(asked)],
                                  "number int, item_id " + kind.simpleString() + ", source long")
    return ranked.join(names, ranked["item"] == names["number"]).select("item_id", F.col("source").alias("item"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item, rank, doc_id, score): each item's k best documents; ``item`` tells items of one item_id apart."""
    prepare(docs.sparkSession)
    found = [search_block(docs, block, k, shard) for block in item_blocks(items, block_bytes)]
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, item long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY r, doc_id, term),
q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (
  SELECT q.item_id, t.doc_id, t.r,
         sum(floor(1000 * ln((2 * c.nn + 2)::DOUBLE / (2 * f.df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * n.n * c.nn) // c.l))))::BIGINT AS score
  FROM q JOIN t ON t.term = q.term JOIN f ON f.term = q.term JOIN n ON n.r = t.r CROSS JOIN c
  GROUP BY q.item_id, t.doc_id, t.r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
