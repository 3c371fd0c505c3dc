"""Scanning files as they arrive. All order is inside a file, so the scan keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions.text import decoded
from veilwright.operators.groups import group_findings, replacement_map
from veilwright.options import ScanOptions
from veilwright.plans.scan import scan

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as the file source writes it before the names of its files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file (its place below ``folder``), text of each new file.

    Spark's file source leaves out names that begin with a dot or an underscore; :func:`veilwright.plans.scan.scan_path` has them.
    """
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)
    root = _qualified(spark, folder)
    return rows.select(F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path")).alias("file"), decoded(F.col("content")).alias("text"))


def stream_findings(spark: SparkSession, folder: str, options: ScanOptions) -> DataFrame:
    """Findings of each new file."""
    return scan(stream_texts(spark, folder), options)


def write_maps(findings: DataFrame, salt: str, out: str, checkpoint: str):
    """A review table a batch (the index is that of the batch), as Parquet below ``out``; a replayed batch overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        replacement_map(group_findings(batch), salt).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return findings.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
