"""The audit log: projection (F26) and JSONL I/O.

The log holds metadata only: the projection is an explicit column list and
never carries prompt or completion text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import config, schemas
from tollgate.functions.money import logged


SPANS = "_spans"


def iso_timestamp(ts: Column) -> Column:
    """Python ``isoformat()`` of a naive timestamp: fraction dropped when it is zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def audit_projection(costed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """AuditEntry rows from costed gateway traffic (plus ``ts``/``event_id`` for ordering and the exact ``cost``)."""
    fallback_from = F.coalesce(F.col("provider_requested"), F.col("provider_used"))
    return costed.select(
        iso_timestamp(F.col("ts")).alias("timestamp"),
        F.col("event_id").cast("string").alias("request_id"),
        "team_id", "provider_requested", "provider_used", "model_used",
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"),
        logged(F.col("cost")).alias("estimated_cost_usd"),
        F.coalesce(F.split(F.col("pii_csv"), ","), F.array().cast("array<string>")).alias("pii_entities_redacted"),
        F.col("pii_redaction_count").cast("int").alias("pii_redaction_count"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.col("fallback_triggered"),
        F.when(F.col("fallback_triggered"), F.concat(F.lit("Fell back from "), fallback_from,
                                                     F.lit(": unknown error"))).alias("fallback_reason"),
        F.col("status"),
        F.when(F.col("status") == "error", F.lit("All providers failed")).alias("error_message"),
        F.col("ts"), F.col("event_id"), F.col("cost"), *keep,
    )


def audit_only(df: DataFrame) -> DataFrame:
    """Exactly the 16 AuditEntry columns, in order."""
    return df.select(*schemas.AUDIT_COLUMNS)


def log_entries(audit: DataFrame) -> DataFrame:
    """An entry as it is written: its ingest sequence first, then the 16 columns; ``day`` is for the folders."""
    return audit.select(F.col("event_id").alias("seq"), *schemas.AUDIT_COLUMNS, F.substring("timestamp", 1, 10).alias("day"))


def clustered(entries: DataFrame, files_per_day: int = 1) -> DataFrame:
    """Entries (with ``day``) dealt so that a day is written by ``files_per_day`` tasks, not by all of them."""
    salt = F.pmod(F.xxhash64("request_id"), F.lit(files_per_day))
    return entries.repartition("day", salt)


def write_jsonl(df: DataFrame, path: str, mode: str = "append", files_per_day: int = 1) -> None:
    """One JSON object per line, partitioned by UTC day so readers prune files; a few files a day."""
    clustered(log_entries(df), files_per_day).write.mode(mode).partitionBy("day").option("compression", "none").json(path)
    write_spans(log_entries(df).select("day", "seq"), path, mode)


def read_jsonl(spark, path: str, quarantine: bool = False) -> DataFrame:
    """Read with the declared schema; malformed lines are dropped (or kept aside).

    ``quarantine=True`` keeps every line and adds ``_corrupt_record`` for the bad ones.
    Blank lines are skipped by the JSON reader itself.
    """
    reader = spark.read.schema(schemas.AUDIT)
    if quarantine:
        # a new StructType: StructType.add would mutate the shared schema in place
        sch = T.StructType(list(schemas.AUDIT.fields) + [T.StructField("_corrupt_record", T.StringType())])
        return spark.read.schema(sch).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return reader.option("mode", "DROPMALFORMED").json(path)


def siem_envelope(df: DataFrame) -> DataFrame:
    """The webhook body, one JSON document per entry."""
    return audit_only(df).select(
        F.to_json(F.struct(F.struct(*schemas.AUDIT_COLUMNS).alias("event"),
                           F.lit(config.SIEM_SOURCETYPE).alias("sourcetype"))).alias("body"))


def to_log_lines(audit: DataFrame, corrupt: Column | None = None) -> DataFrame:
    """Serialized log lines (``seq``, ``line``) in ingest order; ``corrupt`` marks rows written truncated
    (a partially flushed line), to exercise the reader's malformed-line handling."""
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), *schemas.AUDIT_COLUMNS))
    if corrupt is not None:
        line = F.when(corrupt, F.substring(line, 1, F.length(line) / 2)).otherwise(line)
    return audit.select(F.col("event_id").alias("seq"), F.substring("timestamp", 1, 10).alias("day"),
                        line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """S1 for pre-serialized lines: plain text, one line per entry, partitioned by day."""
    lines.select("day", "line").repartition("day").write.mode("append").partitionBy("day").text(path)
    write_spans(lines.select("day", "seq"), path)


def write_spans(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Beside the log, in a folder that readers of the log skip: per day the sequences written, a row a day and write."""
    entries.groupBy("day").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("seq").alias("n")).coalesce(1).write.mode(mode).parquet(f"{path}/{SPANS}")


def read_lines(spark, path: str, days: list[str] | None = None) -> DataFrame:
    """(seq, line) of a log on disk (or of some of its days), as S1 writes it: the sequence stands at the start of a line, so a
    half-written one has it too."""
    lines = spark.read.text(path if days is None else [f"{path}/day={d}" for d in days]).select(F.col("value").alias("line"))
    return lines.select(F.regexp_extract("line", '^\\{"seq":([0-9]+),', 1).try_cast("bigint").alias("seq"), "line").where("line != ''")


def write_siem(entries: DataFrame, path: str, mode: str = "append") -> None:
    """S4 as a sink: one webhook body a line, for a forwarder to post."""
    siem_envelope(entries).write.mode(mode).text(path)



def newest_lines(spark, path: str, limit: int = 100) -> DataFrame:
    """S3's input: the lines of as few days as surely hold the newest ``limit``, read backward from the newest day.

    Days need not follow the sequence: a day is left out only if the log's own record of what was written says that all of its
    sequences lie below the ``limit`` newest of the days read.  A log without that record is read whole.
    """
    if not exists(spark, f"{path}/{SPANS}"):
        return read_lines(spark, path)
    spans = spark.read.parquet(f"{path}/{SPANS}").groupBy("day").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    rows = spans.where("n > 0").orderBy(F.desc("high")).collect()  # a row a day
    held, taken = 0, 0
    while taken < len(rows) and held < limit:
        held += rows[taken]["n"]
        taken += 1
    read, rest = rows[:taken], rows[taken:]
    least = min((r["low"] for r in read), default=0)
    if any(r["high"] > least for r in rest):
        # other days reach among these: how far down do the newest go?
        seqs = read_lines(spark, path, [r["day"] for r in read]).select("seq").orderBy(F.desc("seq")).limit(limit)
        last = seqs.agg(F.min("seq")).first()[0]
        read += [r for r in rest if r["high"] > last]
    return read_lines(spark, path, [r["day"] for r in read]) if read else read_lines(spark, path)


def exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def recent_entries(lines: DataFrame, limit: int = 100) -> DataFrame:
    """S3: the newest ``limit`` lines by ingest sequence, parsed; malformed ones are dropped
    after the cut (so fewer than ``limit`` may come back), newest first.

    The cut is a top-k (TakeOrderedAndProject): no global sort of the log.
    """
    if limit < 1:
        raise ValueError("limit must be >= 1")
    newest = lines.orderBy(F.desc("seq")).limit(limit)
    ok = F.try_parse_json("line").isNotNull()
    parsed = newest.select("seq", F.when(ok, F.from_json("line", schemas.AUDIT)).alias("e"))
    return parsed.where(F.col("e").isNotNull()).select("seq", "e.*").orderBy(F.desc("seq"))
