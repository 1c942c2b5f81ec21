"""Exact deduplication through a sharded cuckoo-filter index of text digests.

Texts are equal when identical after every run of ASCII white space became one space; null counts
as empty.  Only digests move: each task first folds its own batches to one row per digest (so a text
that a third of all rows share arrives as one row per batch), the shards are ranges of the digest, and a
shard's index streams those rows: a filter miss is a new digest, a hit is verified against the stored key.

Defined cases: an empty table gives no rows; empty texts are equal to each other; rows repeated
whole (same doc_id) count each, and exactly one of them is kept; a null doc_id sorts last; other columns
of the input are ignored; a text of any length is digested whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import n_parts, prepare, scratch, table
from tollgate.llm.cuckoo import CuckooIndex

WHITE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1
SHARD_ROWS = 1 << 18
INDEX = "digest binary, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of every row, computed in the JVM."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, " ")
    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))


def _keys(column: pa.Array) -> np.ndarray:
    """(n, 4) uint64 view of a binary column of 32-byte digests."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 4)


def _table(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    raw = np.ascontiguousarray(keys.astype(">u8")).tobytes()
    return pa.RecordBatch.from_arrays([
        pa.array([raw[i: i + 32] for i in range(0, len(raw), 32)], pa.binary()),
        pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(rows, pa.int64()), pa.array(counts, pa.int64()),
    ], names=["digest", "keep_id", "keep_row", "group_size"])


def _fold(keys, ids, rows, counts):
    """One entry per distinct digest: the smallest (id, row) and the summed count."""
    order = np.lexsort((rows, ids, keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
    keys, ids, rows, counts = keys[order], ids[order], rows[order], counts[order]
    lead = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[lead], ids[lead], rows[lead], np.add.reduceat(counts, lead)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _fold_batches(batches):
    for b in batches:
        if b.num_rows:
            yield _table(*_fold(_keys(b.column("digest")), _ids(b.column("doc_id")),
                                b.column("row").to_numpy(), np.ones(b.num_rows, np.int64)))


class ShardIndex:
    """A cuckoo index with, beside each stored digest, who stays and how many rows share it."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooIndex(capacity)
        self.ids = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def add(self, keys, ids, rows, counts) -> None:
        """Insert folded entries (digests distinct within the call); known digests add up."""
        at = self.filter.insert(keys)
        grown = len(self.filter.keys) - len(self.ids)
        self.ids = np.concatenate([self.ids, np.full(grown, LAST)])
        self.rows = np.concatenate([self.rows, np.full(grown, LAST)])
        self.counts = np.concatenate([self.counts, np.zeros(grown, np.int64)])
        better = (ids < self.ids[at]) | ((ids == self.ids[at]) & (rows < self.rows[at]))
        self.ids[at[better]], self.rows[at[better]] = ids[better], rows[better]
        self.counts[at] += counts

    def remove(self, keys) -> np.ndarray:
        return self.filter.delete(keys)

    def entries(self) -> pa.RecordBatch:
        live = np.flatnonzero(self.filter.live)
        return _table(self.filter.keys[live], self.ids[live], self.rows[live], self.counts[live])


def _index_shard(batches):
    index = ShardIndex()
    for b in batches:
        if b.num_rows:
            index.add(*_fold(_keys(b.column("digest")), _ids(b.column("keep_id")), b.column("keep_row").to_numpy(),
                             b.column("group_size").to_numpy()))
    yield index.entries()


def _shards(spark: SparkSession, rows: int) -> int:
    return max(n_parts(spark), -(-rows // SHARD_ROWS))


def build_index(hashed: DataFrame, rows: int) -> DataFrame:
    """Live digests with the row that stays and the number of rows: (digest, keep_id, keep_row, group_size)."""
    spark = hashed.sparkSession
    prepare(spark)
    folded = hashed.mapInArrow(_fold_batches, INDEX)
    return folded.repartition(_shards(spark, rows), "digest").mapInArrow(_index_shard, INDEX)


def update_index(index: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
    """The index after digests were deleted (``deletes``: digest) and then rows inserted (``inserts``: doc_id, row, digest).

    Deleting a digest that isn't live changes nothing; a deleted digest can be inserted anew.
    """
    spark = index.sparkSession
    prepare(spark)
    parts = index.select("*", F.lit(0).alias("step"))
    if deletes is not None:
        parts = parts.unionByName(deletes.select("digest").distinct().selectExpr(
            "digest", "cast(null as long) keep_id", "0L keep_row", "0L group_size", "1 step"))
    if inserts is not None:
        parts = parts.unionByName(inserts.mapInArrow(_fold_batches, INDEX).select("*", F.lit(2).alias("step")))

    def run(batches):
        shard = ShardIndex()
        for b in batches:
            step = b.column("step").to_numpy()
            for s in np.unique(step):
                part = b.filter(pa.array(step == s))
                got = _fold(_keys(part.column("digest")), _ids(part.column("keep_id")),
                            part.column("keep_row").to_numpy(), part.column("group_size").to_numpy())
                if s == 1:
                    shard.remove(got[0])
                else:
                    shard.add(*got)
        yield shard.entries()

    return parts.repartition(n_parts(spark), "digest").sortWithinPartitions("step").mapInArrow(run, INDEX)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = scratch(digests(docs), "digests")
    index = build_index(hashed, hashed.count())
    return hashed.join(index, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
