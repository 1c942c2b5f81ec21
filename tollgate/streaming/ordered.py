"""In-order processing of out-of-order streams, with tables as state.

Files of a large table needn't be in time order.  Each micro-batch's rows are put beside those still held back, and the ones
older than the newest event time less ``delay`` are released, in order, to a batch operator that also gets the state which
earlier releases left.  Rows that come after their time was released are late: the step gets them too, they are written
to a side table, and none is ever dropped.  At the end of the input what is held back is released.

Every epoch writes its own folder (out, state, held, late), overwriting it if the epoch is replayed, so results are
exactly-once across restarts, and the work of a step is distributed like the batch operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.session import shared_path
from tollgate.streaming.session import utc

Step = Callable[[DataFrame, DataFrame | None, float], tuple[DataFrame, DataFrame]]


class OrderedStream:
    """``step(rows, state, now)`` returns (results, new state).  ``rows`` have a boolean ``late`` column; ``key``: the order key, a
    timestamp or number; ``delay`` in the same unit (seconds for timestamps); ``now``: all rows before it are released."""

    def __init__(self, spark: SparkSession, name: str, key: str, delay: float, step: Step):
        self.spark, self.key, self.delay, self.step = spark, key, delay, step
        self.base = shared_path(spark, f"stream-{name}")

    def _at(self, table: str, epoch: int) -> str:
        return f"{self.base}/{table}/epoch={epoch}"

    def _read(self, table: str, epoch: int) -> DataFrame | None:
        return self.spark.read.parquet(self._at(table, epoch)) if epoch >= 0 else None

    def _write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._at(table, epoch))

    def _drop(self, table: str, epoch: int) -> None:
        if epoch >= 0:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self._at(table, epoch))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _number(self, c: Column, kind: str) -> Column:
        if kind == "timestamp_ntz":
            return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{self.key}`)") / F.lit(1e6)
        return F.unix_micros(c) / F.lit(1e6) if kind == "timestamp" else c.cast("double")

    def _epoch(self, batch: DataFrame | None, epoch: int, flush: bool = False) -> None:
        held = self._read("held", epoch - 1)
        mark, seen = self.spark.read.parquet(self._at("mark", epoch - 1)).select("mark", "seen").first() if epoch else (float("-inf"), float("-inf"))
        time = lambda df: self._number(F.col(self.key), dict(df.dtypes)[self.key])
        if batch is not None:
            self._write(batch.withColumn("late", time(batch) < F.lit(mark)), "in", epoch)
            new = self._read("in", epoch)
            rows = new if held is None else new.unionByName(held)
        else:
            rows = held
        newest = rows.select(F.max(time(rows))).first()[0]
        seen = seen if newest is None else max(seen, newest)
        to = float("inf") if flush else max(mark, seen - self.delay)
        ready = rows.where(F.col("late") | (time(rows) < F.lit(to)))
        results, state = self.step(ready, self._read("state", epoch - 1), min(to, seen))
        self._write(results, "out", epoch)
        self._write(state, "state", epoch)
        self._write(rows.where(~F.col("late") & (time(rows) >= F.lit(to))), "held", epoch)
        self._write(rows.where("late"), "late", epoch)
        self._write(self.spark.range(1).select(F.lit(to).cast("double").alias("mark"), F.lit(seen).cast("double").alias("seen")), "mark", epoch)
        # a replay of this epoch needs the last one's tables; those before it are done with
        for table in ("in", "held", "state", "mark"):
            self._drop(table, epoch - 2)
        self.last = epoch

    def run(self, stream: DataFrame) -> DataFrame:
        """All of the input there is, to the end; returns the results."""
        self.last = -1
        with utc(self.spark):
            q = (stream.writeStream.foreachBatch(lambda b, epoch: self._epoch(b, epoch))
                 .option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start())
            q.awaitTermination()
            if self.last < 0:  # no file at all
                empty = self.spark.createDataFrame([], stream.schema)
                self._epoch(empty, 0)
            self._epoch(None, self.last + 1, flush=True)
        return self.spark.read.parquet(f"{self.base}/out").drop("epoch")

    def late_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/late").drop("epoch")
