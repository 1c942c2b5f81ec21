"""Distributed running sums against plain windows (hot keys, tied timestamps, many partitions)."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tollgate.operators.prefix import keyed_running_sums, running_sum, with_chunk
from tollgate.operators.reports import latency_histogram


def _rows(seed, n=800):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        team = rng.choices(["hot", "a", "b", "c"], [8, 1, 1, 1])[0]
        ts = rng.randint(0, 50)  # many ties: the id breaks them
        out.append((i, team, ts % 3, ts, Decimal(rng.randint(0, 10 ** 6)) / Decimal(10 ** 6)))
    return out


@pytest.mark.parametrize("seed,parts", [(1, 2), (2, 7), (3, 33)])
def test_running_sum_matches_window(spark, seed, parts):
    df = spark.createDataFrame(_rows(seed), "id long, team string, grp int, ts long, v decimal(20,12)")
    got = {r["id"]: r["run"] for r in running_sum(df, "v", ["ts", "id"], "run", parts).collect()}
    w = Window.orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["id"]: r["run"] for r in df.withColumn("run", F.sum("v").over(w)).collect()}
    assert got == want


@pytest.mark.parametrize("seed,parts", [(4, 3), (5, 11), (6, 40)])
def test_keyed_running_sums_match_windows(spark, seed, parts):
    df = spark.createDataFrame(_rows(seed), "id long, team string, grp int, ts long, v decimal(20,12)").withColumn("w", F.col("v") * 2)
    out = keyed_running_sums(df, ["v", "w"], ["ts", "id"], {"t": ["team"], "g": ["team", "grp"]}, parts)
    got = {r["id"]: (r["v_t"], r["v_g"], r["w_t"], r["w_g"]) for r in out.collect()}
    before = lambda *k: Window.partitionBy(*k).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.select("id", *[F.coalesce(F.sum(v).over(before(*k)), F.lit(Decimal(0))).alias(n)
                            for n, v, k in (("a", "v", ["team"]), ("b", "v", ["team", "grp"]), ("c", "w", ["team"]), ("d", "w", ["team", "grp"]))])
    assert got == {r["id"]: (r["a"], r["b"], r["c"], r["d"]) for r in ref.collect()}


def test_an_instant_with_a_third_of_all_rows_is_cut(spark):
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ts long")
    sizes = [r["count"] for r in with_chunk(df, ["ts", "id"], 5).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 2 * 3000 / 10
    # a pure function of the row: computed again, the same chunks
    a, b = (sorted(map(tuple, with_chunk(df.repartition(k), ["ts", "id"], 5).select("id", "_chunk").collect())) for k in (3, 3))
    assert a == b


def test_running_sum_has_one_row_level_exchange_and_no_checkpoint(spark):
    df = spark.createDataFrame(_rows(9), "id long, team string, grp int, ts long, v decimal(20,12)")
    before = set(_shared_files(spark))
    out = running_sum(df, "v", ["ts", "id"], "run", 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_chunk") == 2  # the rows, and one row per task and chunk for the totals
    out.collect()
    assert set(_shared_files(spark)) == before


def _shared_files(spark):
    import os
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs]


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "latency_ms double")
    rows = latency_histogram(df).collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(0, 2)]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(0, 31)], "latency_ms double")
    rows = {r["bin"]: r["count"] for r in latency_histogram(df, bins=30).collect()}
    assert sum(rows.values()) == 31 and max(rows) == 29 and rows[29] == 2


def test_spread_deals_only_when_told(spark):
    from tollgate.session import spread
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one) is one
    assert spread(one, 8).rdd.getNumPartitions() == 8
