"""Target-distribution importance resampling over hashed n-grams.

Features are all runs of one to three words, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  A
bucket's gain is the log ratio of its smoothed shares in the target and in the documents.  A document's weight is the sum of its
features' gains; with a Gumbel variate that depends on its id only, the highest scores are a sample without
replacement whose chances are in proportion to the exponential of the weights.

In a task the n-grams of a chunk are interned in an open-addressed table (see ``grams``), whose slots hold bucket and count, so that
each distinct n-gram's CRC is taken once; occurrences gather their gains by slot.  Counts leave a task as one row a bucket.  Ranks come
from a range partitioning by score: place within the partition plus the sizes of those before, no window over all rows.

Defined cases: null and empty texts have no features and weight 0; a null doc_id draws the variate of the empty id and sorts
last; rows repeated whole count each, and tie-break by weight and features, then any order; an empty table gives no rows; without any
target text all gains come from the documents alone; a text of any length is worked off in chunks; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.common import n_parts, prepare, scratch, slices, table
from tollgate.llm.grams import gram_chunks, kept_words

BUCKETS = 10_000
MOST = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
SLICE = 1 << 20


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """(bucket, n): features of all texts by bucket; at most ``buckets`` rows."""
    prepare(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text", SLICE):
            for _, grams in gram_chunks(kept_words(b.column("text")), most):
                total += np.bincount(grams.crcs()[grams.used] % buckets, grams.count[grams.used], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> list[int]:
    """Every bucket's gain; ``buckets`` numbers are all that reaches the driver."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(bucket_counts(docs, buckets, most).withColumnRenamed("n", "s"), "bucket", "left") \
        .join(bucket_counts(target, buckets, most).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    rows = sorted(counted.select("bucket", "s", "t").collect())
    s, t = (np.array([r[k] for r in rows], np.float64) for k in (1, 2))
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel variate (long, rounded down) that depends on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: list[int], most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    prepare(docs.sparkSession)

    def run(batches):
        by_bucket = np.array(gain, np.float64)
        for b in slices(batches, "text", SLICE):
            words = kept_words(b.column("text"))
            features, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for row, grams in gram_chunks(words, most):
                per_slot = by_bucket[grams.crcs() % len(by_bucket)]
                features += np.bincount(row, minlength=b.num_rows)
                # whole numbers below 2**53: sums of doubles are exact
                weight += np.bincount(row, per_slot[grams.slot], b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(words[3])), pa.array(features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with ``rank`` for the drawn share of the documents of enough words."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    able = scored.where(F.col("n_words") >= least_words)
    # written once: which row goes to which range, and its place there, are then fixed
    placed = scratch(able.repartitionByRange(n_parts(spark), *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "resample-order")
    # a row a partition: the window over them is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    drawn = F.floor(placed.select(F.count(F.lit(1))).scalar() * percent / 100)
    rank = F.col("offset") + F.col("place") + 1
    out = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank).cast("long")).drop("part", "place", "offset")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest)


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
               buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and, if drawn, its rank."""
    scored = weighed(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scratch(scored, "resample-scores"), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, with all their columns; rows that share a doc_id go together."""
    drawn = importance(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
