"""Budget admission online, with each team's spend and held rows in Spark's own state store.

A team's newest request, or a heartbeat of it, decides how far its rows are released; no row is dropped.  Heartbeats are files of a second
source, so an idle team's last requests can be released without a new one (``release``).  Only the touched teams' state is read and
written in a micro-batch, and what is done with leaves it, so neither grows with history.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate import config
from tollgate.functions.money import COST_T
from tollgate.operators import budget, fold
from tollgate.operators.prefix import order_key
from tollgate.session import shared_path, ship_package
from tollgate.streaming import admission_state
from tollgate.streaming.session import utc

WHOLE = "decimal(38,0)"
SOURCE = ", ".join(["team_id string, t long, event_id long", *(f"{c} {WHOLE}" for c in admission_state.AMOUNTS), "release boolean"])
DAY_S = 86_400


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB, checkpointed to the shared folder; the caller's provider is restored."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


class AdmissionStream:
    """``delay_s``: how long a team's rows wait for earlier ones; ``keep_s``: how long after its end a month's spend is kept for late
    requests.  ``limits``: a table of budgets, or the settings' own."""

    def __init__(self, spark: SparkSession, delay_s: float = 3600, settings: config.GatewaySettings = config.DEFAULT_SETTINGS, limits: DataFrame | None = None,
                 keep_s: float = 31 * DAY_S):
        self.spark, self.settings, self.limits = spark, settings, limits
        self.processor = admission_state.Admission(int(delay_s * 1e6), int(keep_s * 1e6))
        self.base = shared_path(spark, "stream-budget-admission")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/ticks")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def _source(self, requests: DataFrame) -> DataFrame:
        rows = budget.with_limits(requests.select("team_id", "ts", "event_id", "est_cost", "cost"), self.settings, self.limits)
        # money as whole numbers of its last place: the digits without the point
        whole = lambda c: F.regexp_replace(F.col(c).cast(COST_T).cast("string"), r"\.", "").cast(WHOLE).alias(c)
        # the state's key schema may not change between runs, so the team is nullable whatever the input says
        team = F.nullif("team_id", F.lit("\0")).alias("team_id")
        rows = rows.select(team, F.when(F.col("ts").isNotNull(), order_key(rows, "ts")).alias("t"), "event_id", *map(whole, admission_state.AMOUNTS), F.lit(False).alias("release"))
        return rows.unionByName(self.spark.readStream.schema(SOURCE).parquet(f"{self.base}/ticks"))

    def advance(self, requests: DataFrame) -> None:
        """Works off all input there is; rows that may still be overtaken stay held."""
        for module in (admission_state, fold):
            cloudpickle.register_pickle_by_value(module)
        ship_package(self.spark)
        with utc(self.spark), rocksdb(self.spark):
            out = self._source(requests).groupBy("team_id").transformWithStateInPandas(self.processor, admission_state.OUT, "Append", "None")
            q = (out.writeStream.format("parquet").outputMode("append").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/checkpoint")
                 .trigger(availableNow=True).start())
            q.awaitTermination()

    def release(self, requests: DataFrame) -> None:
        """Decides all held rows of all teams met so far: there is no more to come before them."""
        teams = self.spark.read.schema(admission_state.OUT).parquet(f"{self.base}/out").where("event_id is null").select("team_id").distinct()
        nothing = [F.lit(None).cast(k).alias(c) for c, k in (("t", "long"), ("event_id", "long"), *((c, WHOLE) for c in admission_state.AMOUNTS))]
        teams.select("team_id", *nothing, F.lit(True).alias("release")).write.mode("append").parquet(f"{self.base}/ticks")
        self.advance(requests)

    def results(self) -> DataFrame:
        """Every decided request, as W2 has them, with ``late``; of months that were done with, denied as 'expired'."""
        out = self.spark.read.schema(admission_state.OUT).parquet(f"{self.base}/out").where("event_id is not null")
        ts = F.when(F.col("t") != admission_state.NEVER, F.timestamp_micros("t").cast("timestamp_ntz"))
        told = budget.explain(out.withColumn("ts", ts), ("late", "expired"))
        return told.withColumns({"denied_by": F.when(F.col("expired"), "expired").otherwise(F.col("denied_by")),
                                 "reason": F.when(F.col("expired"), "Budget period closed.").otherwise(F.col("reason"))}).drop("expired")

    def run(self, requests: DataFrame) -> DataFrame:
        """All of the input there is, to the end."""
        self.advance(requests)
        self.release(requests)
        return self.results()

    def late_rows(self) -> DataFrame:
        return self.results().where("late")
