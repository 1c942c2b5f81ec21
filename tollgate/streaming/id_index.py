"""Index of the ids that a sink has written: folders by day, hash bucket and epoch.

A micro-batch looks up only the buckets of its own days that its ids fall into, whatever else was ever written.  Once a bucket
holds many epochs' folders, those of finished epochs become one.  An epoch that is replayed overwrites its own folders; ids that
stand in an old folder and in the compacted one beside it count once, so a stop between the steps does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4
#: Folders of a bucket beyond which the finished ones become one.
FOLDERS = 8

Place = tuple[str, int]


class IdIndex:
    """``path``: a shared folder.  Entries are (day, id), ids as text, days as yyyy-MM-dd."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, folders: int = FOLDERS):
        self.spark, self.path, self.buckets, self.folders = spark, path, buckets, folders

    def bucket(self, of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int")

    def _at(self, place: Place) -> str:
        return f"{self.path}/day={place[0]}/bucket={place[1]}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self, place: Place) -> list[int]:
        at, fs = self._fs(self._at(place))
        return [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("epoch=")] if fs.exists(at) else []

    def places(self, entries: DataFrame, day: str, of: str) -> list[Place]:
        """Where a batch's ids belong: at most its days times the buckets."""
        return [(r[0], r[1]) for r in entries.select(day, self.bucket(F.col(of))).distinct().collect()]

    def known(self, places: list[Place], before: int) -> DataFrame | None:
        """(day, id) written by epochs before ``before``, of these places only."""
        there = [self._at(p) for p in places if any(e < before for e in self._epochs(p))]
        if not there:
            return None
        read = self.spark.read.schema("id string, day string, bucket int, epoch int").option("basePath", self.path).parquet(*there)
        return read.where(F.col("epoch") < before).select("day", "id")

    def add(self, entries: DataFrame, day: str, of: str, epoch: int) -> None:
        self._write(entries.select(F.col(of).cast("string").alias("id"), F.col(day).alias("day"), self.bucket(F.col(of)).alias("bucket"), F.lit(epoch).alias("epoch")))

    def _write(self, ids: DataFrame) -> None:
        ids.repartition("day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "bucket", "epoch").parquet(self.path)

    def compact(self, places: list[Place], epoch: int) -> None:
        """The folders of epochs before ``epoch`` become one (of a negative number, so that it is before every epoch)."""
        old = {p: [e for e in self._epochs(p) if e < epoch] for p in places}
        many = {p: e for p, e in old.items() if len(e) >= self.folders}
        if not many:
            return
        gone = [f"{self._at(p)}/epoch={e}" for p, es in many.items() for e in es if e != -epoch]
        read = self.spark.read.schema("id string, day string, bucket int, epoch int").option("basePath", self.path).parquet(*gone)
        self._write(read.select("id", "day", "bucket").distinct().withColumn("epoch", F.lit(-epoch)))
        for path in gone:
            at, fs = self._fs(path)
            fs.delete(at, True)
