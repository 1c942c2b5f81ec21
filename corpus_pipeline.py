"""From raw documents to packed training sequences.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet to the cluster's shared folder and rereads as the next stage's docs.  All but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars), extra columns of theirs are passed on.

1. quality     documents that the quality model rejects (score under 0.7) go
2. line_dedup  blocks of lines that an earlier document has go; a document that loses all its text goes
3. near_dup    of documents linked by five-word Jaccard similarity of 0.8 or more one row stays, of the smallest doc_id
4. secrets     secrets are replaced by a mark
5. packing     token sequences of at most 1024: a row per piece of a document

Defined cases are those of the operators.  Rows of a null doc_id are judged like others, in near_dup as the largest; there rows
are told apart although they repeat a doc_id or are repeated whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import line_dedup, ngram_join, packing, quality, secrets
from tollgate.llm.common import release_scratch, scratch, scratch_mark, table


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars``, where there is such a column, as the text now is."""
    return docs.select(*(F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`")
                         for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return _counted(left.where(~emptied), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows by an id of their own: doc_ids may repeat or be null.  The row as one struct, so that none of its names can clash
    rows = scratch(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "near-rows")
    joined = ngram_join.jaccard_join(rows.select(F.col("rid").alias("doc_id"), F.col("row")["text"].alias("text")))
    linked = joined.where("n_links > 0").select(F.col("doc_id").alias("rid"), "class_id")
    linked = scratch(linked.join(rows.select("rid", F.col("row")["doc_id"].alias("doc_id")), "rid"), "near-linked")
    least = linked.groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "rid")).alias("least"))
    gone = linked.select("rid").join(least.select(F.col("least.rid").alias("rid")), "rid", "left_anti")
    left = rows.join(gone.hint("shuffle_hash"), "rid", "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good), ("line_dedup", drop_shared_lines), ("near_dup", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: Boosted tables, patience alignment and packing can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release_scratch(spark, since=mark, keep=docs)
    return docs
