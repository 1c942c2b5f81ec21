"""Helpers the operators share: table access, scratch tables, grouped Arrow maps."""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tollgate.session import shared_path, ship_package

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared checkpoint folder and read it back.

    Cuts lineage, so a lost executor replays one step only, and fixes whatever a
    recomputation could change.  ``release_scratch`` removes the files.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """Where the list of scratch tables now ends, for ``release_scratch(since=...)``."""
    return len(_SCRATCH)


def release_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the scratch tables made after the mark ``since``, but for the one that ``keep`` reads; call it once
    what was built on them is written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = set(keep.inputFiles()) if keep is not None else set()
    for entry in _SCRATCH[since:]:
        name = entry[1].rsplit("/", 1)[-1]
        if any(f"/{name}/" in f for f in kept):
            continue
        _SCRATCH.remove(entry)
        p = jvm.org.apache.hadoop.fs.Path(entry[1])
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _release_at_exit() -> None:
    for spark, _ in _SCRATCH[-1:]:
        try:
            release_scratch(spark)
        except Exception:  # the JVM may be gone already; the folder then outlives the application
            pass


def prepare(spark: SparkSession) -> None:
    """Make the package importable in executor Python workers."""
    ship_package(spark)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (text) holds about ``limit`` bytes in each slice (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by ``keys`` (they may span batches), one table per group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = [0, *(i for i in _changes(cols)), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _changes(cols) -> list[int]:
    import numpy as np
    n = len(cols[0])
    differs = np.zeros(max(n - 1, 0), dtype=bool)
    for c in cols:
        differs |= c[1:] != c[:-1]
    return (np.flatnonzero(differs) + 1).tolist()


def grouped_arrow(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str,
                  parts: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``fn`` over each whole group of ``keys``: one shuffle, a sort within partitions, groups streamed in turn."""
    spark = df.sparkSession
    prepare(spark)
    dealt = df.repartition(parts or n_parts(spark), *keys).sortWithinPartitions(*keys, *(order or []))

    def run(batches):
        for group in by_key(batches, keys):
            out = fn(group)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return dealt.mapInArrow(run, schema)
