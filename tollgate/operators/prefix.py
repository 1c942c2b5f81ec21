"""Distributed running sums (W1, W2) over deterministic chunks.

A window with an ORDER BY and no PARTITION BY sends every row to one task.  Instead rows are cut into chunks along the
order: the borders are quantiles of the order key, found by one aggregate, and an instant that holds more than a chunk's share is
cut again by the tie-break key.  A row's chunk is a pure function of the row and the borders, so every branch of
a plan and every retry sees the same chunks and nothing needs a checkpoint.  Chunks are summed (partial aggregation, one
row per chunk), those few rows prefix-summed, and the offsets added to running sums inside chunks: one row-level exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.session import default_partitions, ship_package

Bounds = list[tuple[int, int]]
LEAST = -(1 << 63)


def order_key(df: DataFrame, name: str) -> Column:
    """A time or integer column as a long that sorts alike; nulls first."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        key = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    else:
        key = F.unix_micros(F.col(name)) if kind == "timestamp" else F.col(name).cast("long")
    return F.coalesce(key, F.lit(LEAST + 1))


def chunk_bounds(df: DataFrame, first: str, second: str, chunks: int) -> Bounds:
    """Borders (first, second) of about equal chunks, ascending; at most ``chunks`` - 1 pairs go to the driver.

    Two passes at most: quantiles of ``first``, then, for all instants together that are several of these, quantiles of ``second``.
    """
    if chunks < 2:
        return []
    key = order_key(df, first)
    shares = [i / chunks for i in range(1, chunks)]
    found = df.select(F.percentile_approx(key, shares, F.lit(max(10_000, 20 * chunks)))).first()[0] or []
    at, times = np.unique(np.array(found, np.int64), return_counts=True)
    bounds = {(int(k), LEAST) for k in at}
    hot = {int(k): int(m) for k, m in zip(at, times, strict=True) if m > 1}
    if hot:
        # one fine grid for all of them; each takes as many of its borders as it has shares
        grid = 4 * max(hot.values())
        steps = [i / grid for i in range(1, grid)]
        keyed = df.select(key.alias("_k"), order_key(df, second).alias("_i"))
        wanted = df.sparkSession.createDataFrame(list(hot.items()), "_k long, _m int")  # fewer than the chunks
        ids = keyed.join(F.broadcast(wanted), "_k").groupBy("_k", "_m").agg(F.percentile_approx("_i", steps, F.lit(max(10_000, 20 * grid))).alias("_q"))
        own = F.transform(F.sequence(F.lit(1), F.col("_m") - 1), lambda i: F.element_at("_q", F.round(i * grid / F.col("_m")).cast("int")))
        for k, q in ids.select("_k", own).collect():
            bounds |= {(k, int(i)) for i in q}
    return sorted(bounds)


def chunk_of(first: Column, second: Column, bounds: Bounds) -> Column:
    """Number of borders at or before (first, second)."""
    if not bounds:
        return F.lit(0)
    keys = np.array([b[0] for b in bounds], np.int64)
    ties = np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def place(k: pd.Series, t: pd.Series) -> pd.Series:
        k, t = k.to_numpy(np.int64), t.to_numpy(np.int64)
        out, low = np.searchsorted(keys, k, side="right"), np.searchsorted(keys, k, side="left")
        split = np.flatnonzero(out - low > 1)
        for h in np.unique(k[split]).tolist():  # instants with borders of their own
            rows = split[k[split] == h]
            lo, hi = int(low[rows[0]]), int(out[rows[0]])
            out[rows] = lo + np.searchsorted(ties[lo:hi], t[rows], side="right")
        return pd.Series(out.astype(np.int32))

    return place(first, second)


def with_chunk(df: DataFrame, order: Sequence[str], partitions: int | None = None, per_partition: int = 2, of: DataFrame | None = None) -> DataFrame:
    """``_chunk`` (int) along ``order``, a time or integer column and an integer tie-break.  The borders are those ``of`` a plainer table of
    the same rows, where there is one."""
    ship_package(df.sparkSession)
    first, second = order
    bounds = chunk_bounds(df if of is None else of, first, second, per_partition * (partitions or default_partitions(df.sparkSession)))
    return df.withColumn("_chunk", chunk_of(order_key(df, first), order_key(df, second), bounds))


def running_sum(df: DataFrame, value: str, order: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum over all rows in ``order``."""
    chunked = with_chunk(df, order, partitions)
    local_w = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunked.withColumn("_local", F.sum(value).over(local_w))
    # a row per chunk at most: a single-partition window over them is cheap and bounded
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy("_chunk").agg(F.sum(value).alias("_tot"))
    offsets = totals.select("_chunk", F.sum("_tot").over(before).alias("_off"))
    zero = F.lit(0).cast(local.schema[value].dataType)
    return (local.join(F.broadcast(offsets), "_chunk", "left")
            .withColumn(out, F.coalesce("_off", zero) + F.col("_local"))
            .drop("_chunk", "_local", "_off"))


def keyed_running_sums(df: DataFrame, values: Sequence[str], order: Sequence[str], keys: dict[str, Sequence[str]],
                       partitions: int | None = None) -> DataFrame:
    """Running sums *before* each row of each value within nested keys, skew-safe: columns ``{value}_{name}``.

    ``keys`` maps a name to key columns, every key a subset of the longest.  Chunks cut along the order only, so a key that
    holds a third of all rows is spread over many; per (chunk, key) totals (chunks x keys rows) are prefix-summed and joined back.
    """
    chunked = with_chunk(df, order, partitions)
    # hash on the chunk alone satisfies every (chunk, key...) window below: one exchange for all of them
    out = chunked.repartition("_chunk")
    finest = max(keys.values(), key=len)
    if not all(set(k) <= set(finest) for k in keys.values()):
        raise ValueError("every key must be a subset of the longest key")
    for name, key in keys.items():
        w = Window.partitionBy("_chunk", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        for v in values:
            out = out.withColumn(f"_l_{v}_{name}", F.sum(v).over(w))
    totals = chunked.groupBy("_chunk", *finest).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    for name, key in sorted(keys.items(), key=lambda kv: len(kv[1])):
        w = Window.partitionBy(*key).orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
        for v in values:
            totals = totals.withColumn(f"_o_{v}_{name}", F.sum(f"_t_{v}").over(w))
    out = out.join(totals.drop(*[f"_t_{v}" for v in values]), ["_chunk", *finest], "left")
    for name in keys:
        for v in values:
            zero = F.lit(0).cast(df.schema[v].dataType)
            out = out.withColumn(f"{v}_{name}", F.coalesce(f"_o_{v}_{name}", zero) + F.coalesce(f"_l_{v}_{name}", zero)).drop(f"_o_{v}_{name}", f"_l_{v}_{name}")
    return out.drop("_chunk")
