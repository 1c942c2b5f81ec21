"""Session settings of streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def utc(spark: SparkSession):
    """Event time is UTC (day windows); the caller's zone is restored afterwards.
    Sink values (dates, naive timestamps) do not depend on the zone they are read under."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
