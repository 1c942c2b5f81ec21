"""Structured Streaming forms of the gateway's online path.

Every stream reads files incrementally, writes under a checkpointed location in the shared folder (file sinks, or folders that
an epoch overwrites when it is replayed: exactly-once either way), and can run continuously or, as in the registered queries,
with ``trigger(availableNow=True)`` over what is there.  Files needn't be in time order: no row is dropped for being late.
``max_files`` bounds the files of a micro-batch; None takes all there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate import config, schemas
from tollgate.functions import money, pii
from tollgate.operators import breaker, pricing, reports
from tollgate.session import shared_path, ship_package
from tollgate.sources import audit_io, traffic
from tollgate.streaming import admission
from tollgate.streaming.id_index import IdIndex
from tollgate.streaming.ordered import OrderedStream
from tollgate.streaming.session import utc


def read_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Incremental read of one table's files (the file source needs a directory or a glob)."""
    ship_package(spark)  # steps run in executor Python workers
    path = f"{sf_dir.rstrip('/')}/{name}.parque[t]"
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def run_to_files(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "append") -> str:
    """Run a stream to completion over the available input into a file sink; return the sink path."""
    spark = df.sparkSession
    base = shared_path(spark, f"stream-{name}")
    with utc(spark):
        q = (df.writeStream.format(fmt).outputMode(mode).option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return f"{base}/out"


def run_foreach_batch(df: DataFrame, name: str, fn, mode: str = "complete") -> str:
    spark = df.sparkSession
    base = shared_path(spark, f"stream-{name}")
    target = f"{base}/table"
    with utc(spark):
        q = (df.writeStream.outputMode(mode).foreachBatch(lambda b, epoch: fn(b, epoch, target))
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return target


# -- T1 ------------------------------------------------------------------------------

def stream_redact(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """F8 on a stream of documents; stateless, same column functions as the batch job."""
    docs = read_stream(spark, sf_dir, "documents", max_files).select("doc_id", "text")
    out = pii.redact_steps(docs, "text").select(
        "doc_id", F.col("pii_text").alias("redacted_text"), F.col("pii_count").alias("redaction_count"),
        F.array_join("pii_entities", ",").alias("entities_found"))
    return spark.read.parquet(run_to_files(out, "redact"))


# -- T2 ------------------------------------------------------------------------------

def stream_daily_usage(spark: SparkSession, sf_dir: str, delay: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """Spend and count per team and calendar day, kept current by every micro-batch.

    A batch adds its own sums per team and day (a few rows, in a folder of its epoch); the table is their total, so rows of any
    age count.  A day is ``closed`` once the newest event is ``delay`` past its end; rows that come later still add to it.
    """
    def add(batch: DataFrame, epoch: int, target: str) -> None:
        costed = pricing.with_cost(traffic.gw_audit(batch))
        done = F.col("status") == "success"
        costed.groupBy("team_id", money.day_key(F.col("ts")).alias("day")).agg(
            F.sum(F.when(done, F.col("cost"))).cast(money.COST_T).alias("cost"), F.count_if(done).alias("n_requests"), F.max("ts").alias("newest"),
        ).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    with utc(spark):
        parts = spark.read.parquet(run_foreach_batch(read_stream(spark, sf_dir, "events", max_files), "daily-usage", add, mode="append"))
        newest = parts.select(F.max("newest")).scalar()
        day_end = F.date_add("day", 1).cast("timestamp_ntz")
        return (parts.groupBy("team_id", "day").agg(F.sum("cost").cast(money.COST_T).alias("cost"), F.sum("n_requests").alias("n_requests"))
                .where("n_requests > 0")
                .select("team_id", "day", money.usd(F.col("cost")).alias("cost_usd"), "n_requests",
                        (day_end <= newest.cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")).alias("closed")))


# -- T3 ------------------------------------------------------------------------------

def admission_input(events: DataFrame) -> DataFrame:
    costed = pricing.with_cost(traffic.gw_audit(events))
    return costed.select("team_id", "ts", "event_id", "est_cost",
                         F.when(F.col("status") == "error", F.lit(0).cast(schemas.COST)).otherwise(F.col("cost")).alias("cost"))


def stream_budget_admission(spark: SparkSession, sf_dir: str, settings: config.GatewaySettings = config.DEFAULT_SETTINGS,
                            delay_s: float = 3600, max_files: int | None = None) -> DataFrame:
    """W2 online.  Every request is decided; equals W2 when no request comes over ``delay_s`` late."""
    with utc(spark):
        stream = admission_input(read_stream(spark, sf_dir, "events", max_files))
        out = admission.AdmissionStream(spark, delay_s, settings).run(stream)
        return out.select("event_id", "team_id", "ts", money.usd(F.col("est_cost")).alias("estimated_cost_usd"), money.usd(F.col("cost")).alias("cost_usd"),
                          "allowed", "denied_by", "reason", money.usd(F.col("du_before")).alias("daily_used_before_usd"),
                          money.usd(F.col("mu_before")).alias("monthly_used_before_usd"), "late")


# -- T4 ------------------------------------------------------------------------------

def breaker_step(threshold: int, cooldown_s: int):
    """W3 over released attempts, from the state that earlier releases left.  Late attempts can't change what was already
    reported: they are in the side table only.

    A breaker whose cooldown ends is reported without waiting for another attempt: by a row of outcome 'closed' at trip + cooldown, as soon
    as event time has passed it.  The state remembers the trip whose end was reported.
    """
    def step(rows: DataFrame, state: DataFrame | None, now: float) -> tuple[DataFrame, DataFrame]:
        fresh = rows.where(~F.col("late"))
        out = breaker.breaker_states(fresh, threshold, cooldown_s, opening=state, closings=True)
        final = breaker.breaker_final(fresh, threshold, cooldown_s, opening=state)
        if state is None:
            final = final.withColumn("reported", F.lit(None).cast("long"))
            told = final.select("provider", "reported").limit(0)
        else:
            told = state.select("provider", "reported")
            final = final.join(told, "provider", "left")
        over = (F.col("failures") >= threshold) & (F.col("last_t") + cooldown_s < F.lit(now)) & ~F.coalesce(F.col("reported") == F.col("last_t"), F.lit(False))
        ended = out.where("closed_at is not null").select("provider", (F.col("closed_at") - cooldown_s).alias("trip")).join(told, "provider", "left") \
            .where(~F.coalesce(F.col("reported") == F.col("trip"), F.lit(False))).select("provider", "trip")
        ended = ended.unionByName(final.where(over).select("provider", F.col("last_t").alias("trip")))
        closed = ended.select("provider", F.lit(None).cast("long").alias("attempt_id"), (F.col("trip") + cooldown_s).alias("attempt_s"), F.lit("closed").alias("outcome"),
                              F.lit(0).cast("long").alias("failures_after"), F.lit(None).cast("long").alias("tripped_at_after"), F.lit(False).alias("trip_set"), F.lit(True).alias("expired"))
        final = final.withColumn("reported", F.when(over, F.col("last_t")).otherwise(F.col("reported")))
        return out.drop("closed_at").unionByName(closed), final
    return step


def breaker_stream(spark: SparkSession, delay_s: float = 3600, threshold: int = config.BREAKER_FAILURE_THRESHOLD,
                   cooldown_s: int = config.BREAKER_COOLDOWN_SECONDS) -> OrderedStream:
    return OrderedStream(spark, "breaker", "attempt_s", delay_s, breaker_step(threshold, cooldown_s))


def breaker_input(events: DataFrame) -> DataFrame:
    return traffic.gw_attempts(events).where(F.col("outcome").isin("ok", "error")).select("provider", "attempt_id", "attempt_s", "outcome")


def stream_breaker(spark: SparkSession, sf_dir: str, threshold: int = config.BREAKER_FAILURE_THRESHOLD,
                   cooldown_s: int = config.BREAKER_COOLDOWN_SECONDS, delay_s: float = 3600, max_files: int | None = None) -> DataFrame:
    """T4: W3 online, every attempt and every end of a cooldown (outcome 'closed'); the attempts equal W3 when none comes over
    ``delay_s`` late."""
    return breaker_stream(spark, delay_s, threshold, cooldown_s).run(breaker_input(read_stream(spark, sf_dir, "events", max_files)))


# -- T5 ------------------------------------------------------------------------------

def audit_sink_paths(target: str) -> tuple[str, str, str]:
    """(JSON lines of the log, bodies for the SIEM webhook, index of the entries written)."""
    return f"{target}/log", f"{target}/siem", f"{target}/written"


def append_audit(audit: DataFrame, epoch: int, target: str) -> None:
    """Append one batch's entries to the log and, as envelopes, to the SIEM outbox: every request once, whatever was
    delivered twice and however late.

    Entries already written are found by request id among those of the same days, in the index beside the log.  The batch goes to
    folders of its epoch, which a replay overwrites.
    """
    spark = audit.sparkSession
    log, siem, written = audit_sink_paths(target)
    index = IdIndex(spark, written)
    entries = audit_io.log_entries(audit).dropDuplicates(["request_id"])
    places = index.places(entries, "day", "request_id")
    seen = index.known(places, epoch)
    if seen is not None:
        entries = entries.join(seen.withColumnRenamed("id", "request_id"), ["day", "request_id"], "left_anti")
    audit_io.clustered(entries).write.mode("overwrite").partitionBy("day").json(f"{log}/epoch={epoch}")
    own = spark.read.schema(schemas.AUDIT).json(f"{log}/epoch={epoch}")
    audit_io.write_siem(own, f"{siem}/epoch={epoch}", mode="overwrite")
    index.add(own.withColumn("day", F.substring("timestamp", 1, 10)), "day", "request_id", epoch)
    index.compact(places, epoch)


def stream_audit_sink(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """T5: the audit log (and the SIEM outbox beside it) as an exactly-once sink; returns the log read back."""
    with utc(spark):
        def write(batch: DataFrame, epoch: int, target: str) -> None:
            append_audit(audit_io.audit_projection(pricing.with_cost(traffic.gw_audit(batch))), epoch, target)

        target = run_foreach_batch(read_stream(spark, sf_dir, "events", max_files), "audit-sink", write, mode="append")
    return spark.read.schema(schemas.AUDIT).json(audit_sink_paths(target)[0]).select(*schemas.AUDIT_COLUMNS)


# -- T6 ------------------------------------------------------------------------------

def stream_kpi(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Dashboard KPIs kept current: complete-mode aggregate, each batch overwrites one small table."""
    audit = audit_io.audit_projection(pricing.with_cost(traffic.gw_audit(read_stream(spark, sf_dir, "events", max_files))))
    kpi = reports.kpi_summary(audit)

    def overwrite(batch: DataFrame, epoch: int, target: str) -> None:
        batch.write.mode("overwrite").parquet(target)

    return spark.read.parquet(run_foreach_batch(kpi, "kpi", overwrite))


def stream_latency_histogram(spark: SparkSession, sf_dir: str, places: int = 1, bins: int = 30, max_files: int | None = None) -> DataFrame:
    """A7 kept current: a batch adds its own counts per latency (cut to ``places``) in a folder of its epoch; the histogram is drawn from
    their total."""
    def add(batch: DataFrame, epoch: int, target: str) -> None:
        reports.latency_counts(traffic.gw_audit(batch), places).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    target = run_foreach_batch(read_stream(spark, sf_dir, "events", max_files), "latency", add, mode="append")
    return reports.nice_histogram(spark.read.parquet(target).select("x", "n"), bins)
