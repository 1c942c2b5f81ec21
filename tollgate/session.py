"""Session construction and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tollgate",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session.  On a cluster the submitter's configuration wins."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode with nothing configured (tests) do we pick a folder ourselves;
    on a cluster a missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares "
                           "(checkpoints, audit logs and stream state are written there)")
    local = tempfile.mkdtemp(prefix="tollgate-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def default_partitions(spark: SparkSession) -> int:
    """Tasks for a shuffle that feeds Python: the configured number, every core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a scan's rows evenly over ``partitions`` tasks; None (the default) leaves the scan's own splits.

    Wanted where a table is a single file with one row group, which one task would read whole.
    """
    return df if partitions is None else df.repartition(partitions)


def cores_if_few(df: DataFrame) -> int | None:
    """The number of cores where a scan has fewer splits than that (a small table in one file), else None: for ``spread``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if df._jdf.rdd().getNumPartitions() < cores else None


_SHARED: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp dir); see ``release_shared``."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tollgate/{name}-{uuid.uuid4().hex}"
    _SHARED.append((spark, path))
    return path


def release_shared(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders that jobs of this process made in the shared location, but for those under ``keep``: intermediate
    tables, and sinks and logs of queries whose results have been used."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in list(_SHARED):
        if not entry[1].startswith(keep or ("\0",)):
            _SHARED.remove(entry)
            path = jvm.org.apache.hadoop.fs.Path(entry[1])
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, so a lost executor doesn't replay the
    plan, and an iteration's tables are computed once.  ``release_shared`` removes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tollgate`` importable in executor Python workers (once per application).

    Python folds (mapInPandas, pandas UDFs, stateful stream functions) are
    pickled by reference to this package; ``addPyFile`` ships a zip of it
    with the job, so workers need no installation and no particular cwd.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import tollgate
    pkg = os.path.dirname(os.path.abspath(tollgate.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tollgate-pyfiles-"), "tollgate.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
