"""Shared-folder tables: how plans cut lineage and survive lost executors.

Intermediate tables are Parquet files below ``spark.checkpoint.dir``, which the driver and all
executors can reach. They are removed when the application ends, or by :func:`release`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, local mode gets a temporary one.

    On a cluster an unset folder is an error: a machine-local folder would be lost or unseen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="veilwright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unique folder name below the shared folder."""
    path = f"{shared_root(spark)}/veilwright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made[path] = spark
    return path


def spread(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes but much work: adaptive execution, which goes by bytes, would merge them into one task."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(paths: list[str] | None = None) -> None:
    """Remove what :func:`scratch` named (all of it when the process ends)."""
    for path in list(_made) if paths is None else paths:
        spark = _made.pop(path, None)
        try:
            if spark is not None:
                drop(spark, path)
        except Exception:  # the session may have ended; the folder then belongs to the cluster's cleaner
            pass


@contextmanager
def temporary() -> Iterator[None]:
    """Tables named inside go at the end, so a chain of steps holds only those of the running one."""
    before = set(_made)
    try:
        yield
    finally:
        release([p for p in _made if p not in before])
