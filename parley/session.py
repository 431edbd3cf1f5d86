"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings worth having on any cluster.  AQE coalesces small shuffles, splits
#: skewed join partitions and turns a join into a broadcast only when the
#: measured size of a side is under the threshold, so no operator here needs
#: (or uses) a broadcast hint.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # no stack capture per column expression: long expressions build several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "parley", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or get) a session with :data:`RECOMMENDED` applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for ``purpose`` below ``spark.checkpoint.dir``.

    The cluster names a folder that all executors share in that setting.  Only a
    local session, whose executors are the driver itself, may go without: a
    temporary folder is set up for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.mkdtemp(prefix="parley-"), "checkpoints")
        os.makedirs(root, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system it is on; a missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Shuffle files of a finished write are of no more use; without this they stay until the driver collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders written by :func:`materialize` that have not been released, by application.
_WRITTEN: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Delete what :func:`materialize` has written so far; for when the results that read it are written."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        remove_dir(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned; for when what was made from them is written."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written", None)
        kept = _WRITTEN.get(spark.sparkContext.applicationId, [])
        if path in kept:
            kept.remove(path)
            remove_dir(spark, path)


def materialize(df: DataFrame, purpose: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe against lost executors.

    ``by`` names columns whose values get a folder each.  Results read these tables
    when they run, so the folders stay until :func:`discard` or :func:`release`.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, partitionBy=list(by))
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    if by:  # folder columns come last
        out = out.select(*df.columns)
    out._written = path
    return out
